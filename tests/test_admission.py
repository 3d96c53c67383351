"""Admission reports by hand."""

import pytest
from pyspark.sql import functions as F

from strandloom.operators import admission, evidence


def test_first_rule_refuses(spark):
    rows = spark.createDataFrame([("a", 1, None), ("a", None, 5), ("b", 9, 9), ("b", 1, 9)], "g string, x int, y int")
    got = admission.refusal_census(rows, [("no_x", F.expr("x IS NULL")), ("small", F.expr("x < 5"))], kept="ok", by=["g"])
    assert {(r.g, r.refusal): r.n for r in got.collect()} == {("a", "small"): 1, ("a", "no_x"): 1, ("b", "ok"): 1, ("b", "small"): 1}
    every, census = admission.assemble_pools({"p": (rows, [("small", F.expr("x < 5"))]), "q": (rows.limit(0), [])})
    assert every.count() == 4 and {(r["pool"], r["refusal"]): r["n"] for r in census.collect()} == {("p", "small"): 2, ("p", "kept"): 2}
    with pytest.raises(ValueError, match="no pool"):
        admission.assemble_pools({})


def test_copies_are_carved_out_first(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None), (5, None)], "id int, h string")
    got = {r.id: r.reason for r in admission.heldout_carve(rows, [("third", F.expr("id = 3")), ("second", F.expr("id = 2"))], digest="h").collect()}
    assert got == {1: "duplicate_digest", 2: "duplicate_digest", 3: "third", 4: "query", 5: "query"}


@pytest.mark.parametrize("bad", [("maybe", 0.9), ("passed", 1.2), ("passed", float("nan")), ("passed", 0.1), ("failed", 0.9), ("failed", None), (None, 0.5)])
def test_evidence_that_does_not_hold_together(spark, bad):
    good = [("passed", 0.6), ("failed", 0.59), ("unavailable", None)]
    frame = lambda rows: spark.createDataFrame(rows, "status string, posterior double")
    assert [r.derived for r in admission.checked_evidence(frame(good), status="status", posterior="posterior", at_least=0.6).collect()] == [True, False, None]
    with pytest.raises(Exception, match="does not hold together"):
        admission.checked_evidence(frame([*good, bad]), status="status", posterior="posterior", at_least=0.6).collect()


def test_rates_causes_and_thresholds(spark):
    arms = spark.createDataFrame([("a", True), ("a", False), ("a", None), ("b", None)], "arm string, v boolean")
    assert {r.arm: (r.n, r.decided, r.passed, r.rate) for r in admission.false_pass_rates(arms, arm="arm", verdict="v").collect()} == {"a": (3, 2, 1, 0.5), "b": (1, 0, 0, None)}
    causes = spark.createDataFrame([("x;y",), ("x",), ("",), (None,)], "reason string")
    assert {r.cause: r.n for r in admission.spared_causes(causes).collect()} == {"x": 2, "y": 1}
    t = {r.threshold: r for r in admission.threshold_sensitivity(spark.createDataFrame([(1, 5), (2, 7)], "id long, s int"), id_col="id", score="s", thresholds=[1, 2, 6]).collect()}
    assert (t[6].spared, t[6].mined) == (1, 1) and t[1].fingerprint == t[2].fingerprint != t[6].fingerprint
    g = spark.createDataFrame([("widget x", 10), ("widget", 400), ("other", 1), (None, None)], "product string, distance int")
    assert [r.status for r in evidence.synteny_status(g, rules=[("r", "widget")], wanted=["r"], within=300).collect()] == [True, False, False, None]


def test_windows_of_genomes(spark):
    g = spark.createDataFrame([("a", "A" * 200), ("a", "A" * 10), ("b", "")], "k string, seq string")
    got = {r.k: r.genomes for r in admission.window_census(g, seq_col="seq", by=["k"], window=128, stride=64).collect()}
    assert got == {"a": 2, "b": 1}
