"""Queries that used to move or repeat more than their input: plans without it, same results."""

import pytest
from pyspark.sql import functions as F

from strandloom.operators import sequences, structure


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("made", [sequences.gc_matched, sequences.mono_shuffle])
def test_decoys_move_no_letter(spark, made):
    """Letters were exploded and shuffled by id, some hundred bytes for each."""
    df = spark.createDataFrame([(1, "ACGGT" * 30), (2, "aG\U0001f600C"), (3, ""), (4, None)], "id long, seq string")
    got = made(df, id_col="id", seq_col="seq", seed="s")
    assert "Aggregate" not in plan(got) and "Generate" not in plan(got)
    rows = {r.id: r.decoy for r in got.collect()}
    assert sorted(rows) == [1, 2] and len(rows[1]) == 150 and len(rows[2]) == 4
    if made is sequences.mono_shuffle:
        assert sorted(rows[1]) == sorted("ACGGT" * 30) and rows[1] != "ACGGT" * 30 and sorted(rows[2]) == sorted("aG\U0001f600C")


def test_brackets_and_projected_pairs_stay_in_their_row(spark):
    """A row per letter was shuffled twice, and pairs were joined with all columns twice."""
    text = spark.createDataFrame([(1, "((.))"), (2, ")(()"), (3, ""), (4, None), (5, "\U0001f600(.)")], "id long, s string")
    got = structure.pair_table(text, id_col="id", structure="s")
    assert "Window" not in plan(got) and "Exchange" not in physical(got)
    assert sorted((r.id, r.i, r.j) for r in got.collect()) == [(1, 1, 5), (1, 2, 4), (2, 3, 4), (5, 2, 4)]
    rows = spark.createDataFrame([(1, "A-CG-U", [(1, 6), (1, 2), (4, 9)]), (2, "", [(1, 2)]), (3, "AC", []), (4, "AC", None)], "id long, aligned string, p array<struct<i:int,j:int>>")
    got = structure.project_row_pairs(rows, id_col="id", aligned="aligned", pairs="p")
    assert "Exchange" not in physical(got)
    assert sorted(((r.id, r.i, r.j, r.kept) for r in got.collect()), key=str) == sorted([(1, 1, 4, True), (1, 1, 1, False), (1, 3, None, False), (2, None, None, False)], key=str)


def test_an_attribute_is_read_once(spark):
    """Fragments were read again for each key and use; a plan held some 100 decoders."""
    from strandloom.sources import scans

    df = spark.createDataFrame([("ID=a%3Bb;x=1,2;x=3%20;y=p=q+r",)], "c string")
    got = df.select(scans.gff3_attributes(F.col("c")).alias("m"))
    assert physical(got).count("raise_error") <= 5
    assert got.first().m == {"ID": ["a;b"], "x": ["1", "2", "3 "], "y": ["p=q+r"]}


def test_words_are_counted_in_their_row(spark):
    """A row per window was shuffled."""
    df = spark.createDataFrame([(1, "AACAANAC"), (2, ""), (3, "A"), (4, None)], "id long, s string")
    got = sequences.kmer_frequencies(df, id_col="id", seq_col="s", k=2)
    assert "Exchange" not in physical(got)
    assert sorted((r.id, r.kmer, r.n, r.freq) for r in got.collect()) == [(1, "AA", 2, 0.4), (1, "AC", 2, 0.4), (1, "CA", 1, 0.2)]
    wide = sequences.kmer_frequencies(df, id_col="id", seq_col="s", k=32)
    assert wide.count() == 0


def test_control_starts_are_not_listed(spark):
    """Every start of a sequence was put into an array."""
    df = spark.createDataFrame([(i, "ACGT" * 5, lo, lo + 2) for i in range(400) for lo in (1, 2, 9, 18)], "id long, seq string, lo int, hi int")
    got = sequences.ablation_pairs(df, seed="s", id_col="id")
    assert "sequence(" not in plan(got)
    starts = [r.control_lo for r in got.join(df.where("lo = 9"), "id").where("length(ablated) = 17").collect()]
    assert len(starts) == 1600 and set(starts) <= set(range(1, 19))


def test_alignment_cells_are_read_where_they_lie(spark):
    """Pieces were shuffled by row, then whole rows by file."""
    from strandloom.sources import scans

    text = "# STOCKHOLM 1.0\na   AC\nb   A-\n#=GC SS_cons   ..\n#=GF x y\n\na   GG  \r\nb   CC\n#=GC SS_cons   <>\n//\n"
    got = scans.parse_stockholm(spark.createDataFrame([("f", text), ("g", "//"), ("h", None)], "file string, content string"))
    assert "Exchange" not in physical(got)
    assert sorted(map(tuple, got.collect())) == [("f", "#=GC SS_cons", "..<>"), ("f", "a", "ACGG"), ("f", "b", "A-CC")]


def test_shared_words_are_not_joined(spark):
    """Minimizers of seven letters, equal by chance, were joined: more rows than pairs of sequences."""
    rows = spark.createDataFrame([(i, "ACGT" * 4 + "GATTACA"[i % 5 :]) for i in range(12)], "item long, seq string")
    got = sequences.shared_kmer_hosts(rows, rows.withColumnRenamed("item", "host"), k=12, item_id="item", host_id="host", most=5)
    assert "Join" not in plan(got)
    mers = {r.item: {r.seq[p : p + 12] for p in range(len(r.seq) - 11)} for r in rows.collect()}
    assert {(r.item, r.host): r.n_shared for r in got.collect()} == {(i, h): len(a & b) for i, a in mers.items() for h, b in mers.items() if a & b}


def test_blocks_are_written_once(spark):
    """Sequences were shuffled to every block of the other side."""
    rows = spark.createDataFrame([(i, "ACGT" * 4 + "GATTACA"[i % 5 :]) for i in range(60)], "item long, seq string")
    got = sequences.shared_kmer_hosts(rows, rows.withColumnRenamed("item", "host"), k=12, item_id="item", host_id="host", most=5)
    assert "Generate" not in plan(got) and "CartesianProduct" in physical(got)
    mers = {r.item: {r.seq[p : p + 12] for p in range(len(r.seq) - 11)} for r in rows.collect()}
    assert {(r.item, r.host): r.n_shared for r in got.collect()} == {(i, h): len(a & b) for i, a in mers.items() for h, b in mers.items() if a & b}


def test_edges_are_made_once(spark):
    """What made the edges ran again for the nodes that are alone."""
    from strandloom.operators.cluster import connected_components

    seen = spark.sparkContext.accumulator(0)

    def made(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame([(1, 2), (3, 2), (4, 4), (2, 2), (5, None)], "a long, b long").mapInArrow(made, "a long, b long")
    got = {tuple(r) for r in connected_components(edges).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)} and seen.value == 5


def test_chance_seeds_stay_in_their_block(spark):
    """Every seed met by chance was shuffled with its contig's letters."""
    import random

    import numpy as np

    rnd = random.Random(7)
    contigs = ["".join(rnd.choice("ACG") for _ in range(300)) for _ in range(6)]
    segments = [contigs[i][50:70] for i in range(6)] + [contigs[0][10:18] + "TTTTTTTTTTTT", contigs[1][280:300], contigs[2][:9] + "T" + contigs[2][10:20]]
    s, b, place = sequences._seed_starts(contigs, segments, 6, 0.15)
    assert {(int(i), int(j), int(p)) for i, j, p in zip(s, b, place, strict=True)} >= {*((i, i, 50) for i in range(6)), (7, 1, 280), (8, 2, 0)} and 6 not in s
    hashes = sequences._word_hashes(np.frombuffer(b"ACGTACGTAC", np.uint8), 7)
    assert len(hashes) == 4 and hashes[0] not in hashes[1:] and (sequences._word_hashes(np.frombuffer(b"CGTACGTA", np.uint8), 7) == hashes[1:3]).all()


def test_equal_vectors_meet_once(spark, monkeypatch):
    """Every copy of a vector met all copies of all vectors it shared a band with."""
    import numpy as np

    from strandloom.operators import similarity
    from strandloom.operators.cluster import connected_components

    rng = np.random.default_rng(8)
    base = [[int(x) for x in r] for r in rng.integers(0, 4, (60, 64))]
    near = [[*b[:60], -1, *b[61:]] for b in base[:9]]
    void = [-1] * 30 + [1] * 34
    rows = [(i * 10 + j, b) for i, b in enumerate(base) for j in range(8)] + [(5000 + i, b) for i, b in enumerate(near)] + [(9000, void), (9001, void)]
    df = spark.createDataFrame(rows, "id long, codes array<int>")
    compared = spark.sparkContext.accumulator(0)
    scores = similarity._scores

    def counted(a, b, levels):
        compared.add(len(a) * len(b))
        return scores(a, b, levels)

    monkeypatch.setattr(similarity, "_scores", counted)
    got = {(r.node, r.component) for r in connected_components(similarity.similarity_links(df, id_col="id", codes="codes", identity=0.8, coverage=0.95)).collect()}
    want = {(i * 10 + j, i * 10) for i in range(60) for j in range(8)} | {(5000 + i, i * 10) for i in range(9)} | {(9000, 9000), (9001, 9001)}
    assert got == want and compared.value < 4 * 69 * 69


def test_replicates_share_one_sort(spark):
    """Every replicate had rows of its own, and its draws were made in one task."""
    from strandloom.operators import metrics

    rows = [(i % 7, (i * 37 % 11) / 3, int(i * 13 % 5 < 2)) for i in range(300)] + [(9, None, 1), (9, None, 0), (2, float("nan"), 0), (2, float("nan"), 1), (5, 0.1, None)]
    df = spark.createDataFrame(rows, "block long, score double, y int")
    w = metrics.block_bootstrap_weights(df, block="block", replicates=40, seed="s")
    assert "REPARTITION_BY_COL" not in physical(w)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = metrics._replicate_aurocs(df, score="score", label="y", block="block", replicates=40, seed="s")
        assert "Generate" not in physical(got).split("MapInPandas")[0]
        got = {r.rep: r.auroc for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {r.rep: r.auroc for r in metrics.auroc(df.join(w, "block"), score="score", label="y", by=["rep"], weight="weight").collect()}
