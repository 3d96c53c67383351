"""Sizing of control draws by hand."""

import pytest

from strandloom.operators import sizing


def lengths(spark, *x):
    return spark.createDataFrame([(i, v) for i, v in enumerate(x)], "id long, length long")


def test_spans_by_hand(spark):
    r = sizing.span_matchedness(lengths(spark, 10, 20, 30, 40, None), lengths(spark, 20, 20, 40, 60), length="length").first()
    assert (r.control_n, r.control_median, r.candidate_median, r.n_inside, r.share_inside) == (4, 25.0, 30.0, 3, 0.75)
    assert r.ks == 0.25 and r.median_ratio == pytest.approx(25 / 30)
    for a, b in (([], [1]), ([1], []), ([0, 0], [1])):
        with pytest.raises(ValueError):
            sizing.span_matchedness(lengths(spark, *a), lengths(spark, *b), length="length")


def test_overlap_by_hand(spark):
    records = spark.createDataFrame([(1,), (1,), (2,), (9,), (None,)], "taxon long")
    searched = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "c"), (None, "d"), (4, None)], "taxon long, assembly string")
    own = spark.createDataFrame([("a",), ("a",), ("x",), (None,)], "assembly string")
    r = sizing.substrate_overlap(records, own, searched, taxon="taxon", assembly="assembly").first()
    assert (r.n_records, r.n_genomes, r.n_searched_taxa, r.n_with_taxon, r.n_taxa, r.n_routable, r.n_taxa_searched) == (5, 4, 4, 4, 3, 3, 2)
    assert (r.n_candidate_assemblies, r.n_self_hits, r.share_routable) == (2, 1, 0.6)
    assert sizing.substrate_overlap(records.limit(0), own, searched, taxon="taxon", assembly="assembly").first().share_routable == 0


def test_draws_and_power_by_hand(spark):
    rows = spark.createDataFrame([("o1", 1), ("o1", 2), ("o1", 3), ("o2", 4), ("o2", 4), (None, 5)], "stratum string, cluster long")
    got = {r.k: (r.strata, r.quota, r.strata_with_quota, r.clusters, r.one_per_cluster) for r in sizing.draw_feasibility(rows, stratum="stratum", cluster="cluster", draws=[1, 4, 6]).collect()}
    assert got == {1: (2, 0, 2, 5, True), 4: (2, 2, 1, 5, True), 6: (2, 3, 1, 5, False)}
    p = {(r.k, r.anchor): r for r in sizing.effective_power(spark, draws=[100, 1], shares={"third": 1 / 3, "none": 0.0}).collect()}
    assert p[100, "third"].effective_n == 33 and p[100, "third"].width_at_90 < p[100, "third"].width_at_50 and p[1, "none"].width_at_50 is None
