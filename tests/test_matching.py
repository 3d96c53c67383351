"""Matching, minimizers, bands and localisation against plain versions."""

import random

import numpy as np
import pytest

from strandloom.operators import matching, sequences, similarity
from strandloom.operators.cluster import connected_components
from strandloom.operators.selection import cluster_representatives


def kuhn(edges):
    by = {}
    for u, c in edges:
        by.setdefault(u, []).append(c)
    held = {}

    def augment(u, seen):
        for c in by[u]:
            if c not in seen:
                seen.add(c)
                if c not in held or augment(held[c], seen):
                    held[c] = u
                    return True
        return False

    return sum(augment(u, set()) for u in sorted(by))


@pytest.mark.parametrize("seed", [1, 2])
def test_matching_is_largest(spark, seed):
    rnd = random.Random(seed)
    edges = [(f"u{rnd.randrange(30)}", rnd.randrange(25)) for _ in range(55)]
    # A chain that greedy choices can only solve by one long flip.
    edges += [(f"v{i}", 100 + i) for i in range(6)] + [(f"v{i}", 101 + i) for i in range(6)] + [("v9", 100)]
    got = matching.maximum_matching(spark.createDataFrame([*edges, (None, 1), ("u1", None)], "unit string, cluster long"), "unit", "cluster").collect()
    assert {tuple(r) for r in got} <= set(edges)
    assert len({r.unit for r in got}) == len({r.cluster for r in got}) == len(got) == kuhn(edges)


def test_matched_representatives_cover_more_than_greedy(spark):
    # Cluster 1 offers a and b, cluster 2 a and c, cluster 3 c alone; one offers none.
    rows = [(1, "a", 10), (1, "b", 11), (1, "b", 9), (2, "a", 20), (2, "c", 21), (3, "c", 30), (4, None, 41), (4, None, 40), (5, "a", 50), (None, "z", 1), (6, "q", None)]
    df = spark.createDataFrame(rows, "cluster long, unit string, id long")
    got = {r.cluster: (r.id, r.unit) for r in matching.matched_representatives(df, cluster="cluster", unit="unit", id_col="id").collect()}
    assert got[1] == (9, "b") and got[4] == (40, None) and set(got) == {1, 2, 3, 4, 5}
    assert {u for _, u in got.values()} == {"a", "b", "c", None}
    matched = matching.maximum_matching(df, "unit", "cluster")
    cover = {r.unit: (r.n_clusters, r.covered) for r in matching.unit_coverage(df, matched, cluster="cluster", unit="unit").collect()}
    assert cover == {"a": (3, True), "b": (1, True), "c": (2, True), "q": (1, True)}
    two = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 3), (3, "a", 4), (3, "b", 5), (4, "b", 6), (1, "c", 7), (3, "d", 8)], "cluster long, unit string, id long")
    best = {r.unit for r in matching.matched_representatives(two, cluster="cluster", unit="unit", id_col="id").collect()}
    greedy = {r.unit for r in cluster_representatives(two, cluster="cluster", unit="unit", id_col="id").collect()}
    assert best == {"a", "b", "c", "d"} >= greedy
    assert matching.matched_representatives(df.limit(0), cluster="cluster", unit="unit", id_col="id").count() == 0


def shared(items, hosts, k):
    mers = lambda s: {s[i : i + k] for i in range(len(s) - k + 1)}
    return {(i, h): n for i, a in items for h, b in hosts if (n := len(mers(a) & mers(b)))}


@pytest.mark.parametrize(("k", "most"), [(12, 5000), (12, 3), (20, 4), (2, 50)])
def test_shared_stretches_equal_a_join_on_all(spark, k, most):
    rnd = random.Random(k)
    base = "".join(rnd.choice("ACGT") for _ in range(400))
    piece = lambda: "".join(base[(p := rnd.randrange(380)) : p + rnd.randrange(40)] if rnd.random() < 0.5 else rnd.choice("ACGT") * rnd.randrange(30) for _ in range(4))
    common = base[:60]  # in every host and every second item
    items = [(i, piece() + (common if i % 2 else "")) for i in range(14)] + [(90, ""), (91, "AC"), (92, None)]
    hosts = [(100 + i, piece() + common + piece()) for i in range(20)] + [(190, "")]
    a = spark.createDataFrame([(*r, 1) for r in items], "item long, seq string, mer int")
    b = spark.createDataFrame([(*r, 1) for r in hosts], "host long, seq string, mer int")
    got = sequences.shared_kmer_hosts(a, b, k=k, item_id="item", host_id="host", most=most)
    assert {(r.item, r.host): r.n_shared for r in got.collect()} == shared([x for x in items if x[1]], hosts, k)


def test_no_join_key_holds_more_than_its_part(spark):
    from pyspark.sql import functions as F

    a = spark.range(1000).select(F.lit("hot").alias("mer"), F.col("id").alias("i")).unionByName(spark.createDataFrame([("x", 1), (None, 2)], "mer string, i long"))
    b = spark.range(90).select(F.lit("hot").alias("mer"), F.col("id").alias("h")).unionByName(spark.createDataFrame([("x", 5), (None, 6)], "mer string, h long"))
    got = sequences.dealt_join(a, b, "mer", 50)
    assert got.count() == got.distinct().count() == 1000 * 90 + 1
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_a" in plan and "_b" in plan


def test_minimizers_are_few():
    rnd = random.Random(3)
    seq = "".join(rnd.choice("ACGT") for _ in range(20_000))
    at = sequences._window_minima(seq, 32, 16)
    assert len(at) < 0.14 * len(seq) and max(np.diff(at)) <= 17


def test_bounds_reach_over_short_flanks(spark):
    rnd = random.Random(4)
    seq = "".join(rnd.choice("ACGT") for _ in range(300))
    contigs = spark.createDataFrame([(1, seq), (2, seq[::-1])], "contig long, seq string")
    # Short ends of 5 and 6 letters around two long segments, elided stretches between.
    parts = [(seq[100:105], 0), (seq[108:140], 8), (seq[150:180], 50), (seq[184:190], 84)]
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    segments = spark.createDataFrame([(7, s, o) for s, o in parts] + [(8, turn(s), 90 - o - len(s)) for s, o in parts] + [(9, seq[2:7], 0), (9, seq[1:30], 8)], "leader long, seq string, offset int")
    got = {r.leader: r for r in sequences.localise(contigs, segments, k=14, contig_id="contig", leader_id="leader").collect()}
    assert [(got[i].strand, got[i].start0, got[i].end0) for i in (7, 8)] == [(1, 100, 190), (-1, 100, 190)]
    assert 9 not in got  # the nominal start would lie before the contig


def vectors(seed, n, copies):
    rnd = np.random.default_rng(seed)
    rows = rnd.integers(0, 4, (n, 64))
    rows[rnd.random(rows.shape) < 0.05] = -1
    for i in range(copies):
        rows[n - 1 - i] = rows[i % 20]
        rows[n - 1 - i][rnd.integers(0, 64, rnd.integers(0, 5))] = rnd.integers(-1, 4)
    return [(int(i), [int(x) for x in r]) for i, r in enumerate(rows)]


def test_bands_lose_no_link(spark, monkeypatch):
    rows = vectors(1, 300, 120)
    df = spark.createDataFrame(rows, "id long, codes array<int>")
    groups = lambda links: {(r.node, r.component) for r in connected_components(links).collect()}
    options = dict(id_col="id", codes="codes", identity=0.95, coverage=0.85)
    every = groups(similarity.similarity_links(df, n_blocks=2, **options).unionByName(df.selectExpr("id AS a", "id AS b")))
    assert groups(similarity.similarity_links(df, **options)) == every and len({c for _, c in every}) < 200
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 8)  # every crowded band is dealt out
    assert groups(similarity.similarity_links(df, **options)) == every


def test_hubs_lose_no_link(spark, monkeypatch):
    """All pairs of blocks met, also those of one component."""
    rng = np.random.default_rng(5)
    near = rng.integers(0, 4, 64)
    rows = [(i, [int(x) for x in np.where(rng.random(64) < 0.55, near, rng.integers(0, 4, 64))]) for i in range(150)]  # mostly one component
    rows += [(1000 + i, c) for i, c in vectors(6, 120, 60)] + [(2000 + i, [-1] * 64) for i in range(4)]
    df = spark.createDataFrame(rows, "id long, codes array<int>")
    groups = lambda links: {(r.node, r.component) for r in connected_components(links).collect()}
    options = dict(id_col="id", codes="codes", identity=0.55, coverage=0.7)
    every = groups(similarity.similarity_links(df, n_blocks=2, **options))
    assert 3 < len({c for _, c in every}) and len({n for n, c in every if c == min(c for _, c in every)}) > 60
    monkeypatch.setattr(similarity, "HUBS", (8, 16, 1000))
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 64)
    compared = spark.sparkContext.accumulator(0)
    scores = similarity._scores

    def counted(a, b, levels):
        compared.add(len(a) * len(b))
        return scores(a, b, levels)

    monkeypatch.setattr(similarity, "_scores", counted)
    assert groups(similarity.similarity_links(df, **options)) == every
    compared.value = 0
    one = df.where("id < 1000").crossJoin(spark.range(4).withColumnRenamed("id", "r")).selectExpr("id * 4 + r AS id", "codes")
    assert {n for n, _ in groups(similarity.similarity_links(one, **options))} == {4 * n + r for n, c in every if n < 1000 for r in range(4)} | {4 * n + r for n in range(150) for r in range(4)}
    assert 0 < compared.value < 600 * 600 / 3  # all pairs of blocks are over half of the square


def test_bands_compare_few_pairs(spark):
    n = 3000
    df = spark.createDataFrame(vectors(2, n, 60), "id long, codes array<int>")
    width = similarity.band_width(64, 0.95, 0.85)
    keys = similarity._banded(df, "id", "codes", 64, width).groupBy("key").count().selectExpr("sum(count * (count - 1) / 2) AS pairs").first()
    assert width == 5 and keys["pairs"] < 0.05 * n * n / 2


@pytest.mark.parametrize("block", [2000, 8])
def test_nearest_in_bands_is_the_nearest(spark, monkeypatch, block):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", block)
    df = spark.createDataFrame(vectors(3, 240, 100), "id long, codes array<int>")
    test, train = df.where("id % 4 = 0"), df.where("id % 4 <> 0")
    options = dict(id_col="id", codes="codes", coverage=0.85)
    plain = {tuple(r) for r in similarity.nearest_across(test, train, n_blocks=2, **options).collect()}
    assert {tuple(r) for r in similarity.nearest_across(test, train, floor=0.95, **options).collect()} == plain
    assert sum(x >= 0.95 for _, x in plain) > 10 < sum(x < 0.95 for _, x in plain)
