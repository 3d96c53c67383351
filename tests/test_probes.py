"""Calibration by kernels, grouped probes and junctions against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import metrics, probe


def kernel(p, y, h):
    """Leave-one-out estimate of every row, weights relative to the largest."""
    eps = 1e-12
    q = np.clip(p, eps, 1 - eps)
    out = []
    for i in range(len(p)):
        w = p[i] / h * np.log(q) + (1 - p[i]) / h * np.log(1 - q)
        w = np.delete(w, i)
        w = np.exp(w - w.max())
        out.append((w * np.delete(y, i)).sum() / w.sum())
    return np.array(out)


@pytest.mark.parametrize("tile", [1000, 7])
def test_kernel_estimate_is_exact(spark, monkeypatch, tile):
    monkeypatch.setattr(metrics, "TILE", tile)
    rnd = np.random.default_rng(4)
    p = np.concatenate([rnd.beta(0.3, 0.6, 150), rnd.integers(0, 5, 40) / 40, [0.0, 1.0, 1.0, 1e-9], rnd.random(60) * 1e-3 + 0.7])
    y = (rnd.random(len(p)) < p).astype(int)
    df = spark.createDataFrame([(float(a), int(b), "u") for a, b in zip(p, y, strict=True)], "p double, y int, h string")
    grid = [0.002, 0.01, 0.1, 1.0]
    got = {r.h: r for r in metrics.kernel_calibration(df.drop("h"), p="p", label="y", bandwidths=grid).collect()}
    for h in grid:
        g = kernel(p, y, h)
        c = np.clip(g, 1e-12, 1 - 1e-12)
        assert got[h].ece == pytest.approx(np.abs(g - p).mean(), abs=1e-9)
        assert got[h].log_likelihood == pytest.approx(np.where(y == 1, np.log(c), np.log(1 - c)).sum(), abs=1e-6)


def test_kernel_estimate_by_group_and_tiles_out_of_reach(spark, monkeypatch):
    monkeypatch.setattr(metrics, "TILE", 5)
    rnd = np.random.default_rng(5)
    rows = [(u, float(a), int(rnd.random() < a)) for u in "ab" for a in np.concatenate([rnd.random(20) * 0.01, 0.99 + rnd.random(20) * 0.01])] + [("lone", 0.5, 1)]
    df = spark.createDataFrame(rows, "unit string, p double, y int")
    got = {r.unit: r.ece for r in metrics.kernel_calibration(df, p="p", label="y", bandwidths=[0.002], by=["unit"]).collect()}
    for u in "ab":
        p, y = (np.array([r[k] for r in rows if r[0] == u]) for k in (1, 2))
        assert got[u] == pytest.approx(np.abs(kernel(p, y, 0.002) - p).mean(), abs=1e-9)
    assert got.get("lone") is None
    assert metrics.kernel_calibration(df.limit(0), p="p", label="y", bandwidths=[0.1]).count() == 0


def test_poisson_weights_agree_with_drawn_blocks(spark):
    sums = spark.createDataFrame([(i, float(i % 7), 10.0) for i in range(400)], "block long, a double, b double")
    ends = []
    for draw in (metrics.block_bootstrap_weights, metrics.poisson_weights):
        w = draw(sums, block="block", replicates=300, seed="s")
        ends.append(metrics.bootstrap_ratio(sums, w, block="block", numerator="a", denominator="b").first())
    assert ends[0].point == ends[1].point
    assert abs(ends[0].lo - ends[1].lo) < 0.004 and abs(ends[0].hi - ends[1].hi) < 0.004
    w = metrics.poisson_weights(sums, block="block", replicates=300, seed="s")
    plan = w._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
    counts = np.array([r.weight for r in w.collect()])
    assert abs(counts.sum() / 120_000 - 1) < 0.01 and abs((counts == 1).sum() / 120_000 - math.exp(-1)) < 0.01
    assert metrics.block_bootstrap_weights(sums, block="block", replicates=2, seed="s").agg(F.sum("weight")).first()[0] == 800


def test_groups_of_copies_stay_on_one_side(spark):
    rnd = np.random.default_rng(6)
    base = rnd.normal(size=(60, 32))
    rows = [(i * 10 + j, [float(x) for x in base[i] + rnd.normal(size=32) * 0.002], i % 2) for i in rnd.permutation(60).tolist() for j in range(4)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, y int")
    groups = probe.similarity_groups(df, id_col="id", embedding="embedding")
    assert {(r.id // 10, r.group) for r in groups.collect()} == {(i, i * 10) for i in range(60)}
    sides = probe.grouped_split(groups, group="group", share=0.4, seed="s").groupBy("group").agg(F.count_distinct("test").alias("n"), F.bool_or("test").alias("t")).collect()
    assert all(r.n == 1 for r in sides) and 10 < sum(r.t for r in sides) < 40
    assert probe.similarity_groups(df.limit(0), id_col="id", embedding="embedding").count() == 0


def test_planted_leakage_shows_only_without_groups(spark):
    """A random label of each group: copies on both sides give it away."""
    rnd = np.random.default_rng(7)
    base, label = rnd.normal(size=(40, 64)), rnd.integers(0, 2, 40)
    rows = [(i * 10 + j, [float(x) for x in base[i] + rnd.normal(size=64) * 0.01], int(label[i]), i) for i in range(40) for j in range(6)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, y int, group long")
    verdicts = []
    for held in (df.withColumn("test", F.col("id") % 10 >= 4), probe.grouped_split(df, group="group", share=0.4, seed="s")):
        scores = probe.probe_scores(held).join(df.select("id", "group"), "id")
        r = probe.probe_verdict(metrics.auroc_interval(scores, score="score", label="y", block="group", replicates=100, seed="s")).first()
        verdicts.append((r.verdict, r.auroc))
    assert verdicts[0][0] == "PASS" and verdicts[0][1] > 0.95
    assert verdicts[1][0] != "PASS" and verdicts[1][1] < 0.75


def test_verdict_by_the_lower_end(spark):
    nan = float("nan")
    rows = [(0.9, 0.6), (0.9, 0.5), (0.6, None), (0.5, 0.4), (0.3, 0.2), (None, 0.9), (nan, 0.9), (0.7, nan)]
    got = [r.verdict for r in probe.probe_verdict(spark.createDataFrame(rows, "auroc double, lo double")).collect()]
    assert got == ["PASS", "borderline", "borderline", "FAIL", "FAIL", "FAIL", "FAIL", "borderline"]


ARM = "pair long, host_id long, phase int, insert_len int, lo int, hi int, sequence string"


def arms(rnd, n, insert, first=0):
    """Hosts, and pairs of them with an insert in place of twenty letters and with other
    background in the same place."""
    text = lambda k: "".join(rnd.choice("ACGT") for _ in range(k))
    hosts = [(first + i, text(80)) for i in range(n)]
    decoy = [(first + i, first + i, 0, 20, 30, 50, h[:30] + insert(rnd) + h[50:]) for i, h in hosts for i in [i - first]]
    control = [(first + i, first + i, 0, 20, 30, 50, h[:30] + text(20) + h[50:]) for i, h in hosts for i in [i - first]]
    return hosts, decoy, control


def test_arms_that_do_not_match(spark):
    hosts, decoy, control = arms(random.Random(1), 6, lambda r: "G" * 20)
    d, h = spark.createDataFrame(decoy, ARM), spark.createDataFrame(hosts, "host_id long, sequence string")
    check = lambda rows: probe.arm_mismatches(d, spark.createDataFrame(rows, ARM), h).first().asDict()
    ok = check(control)
    assert ok["arms_matched"] and ok["n_pairs"] == 6 and sum(v for k, v in ok.items() if k.startswith("n_") and k != "n_pairs") == 0
    change = lambda **new: [(*(new.get(k, v) for k, v in zip(ARM.replace(",", "").split()[::2], control[0], strict=True)),), *control[1:]]
    cases = {
        "n_geometry_mismatch": change(phase=1), "n_length_mismatch": change(sequence=control[0][6] + "A"), "n_flank_mismatch": change(sequence="N" + control[0][6][1:]),
        "n_identical_inside": change(sequence=decoy[0][6]), "n_control_unspliced": change(sequence=hosts[0][1]), "n_unpaired": control[1:],
    }
    for name, rows in cases.items():
        got = check(rows)
        assert not got["arms_matched"] and got[name] == 1, (name, got)
    assert not probe.arm_mismatches(d.limit(0), d.limit(0), h).first().arms_matched
    assert probe.arm_mismatches(d, spark.createDataFrame(control, ARM), h.where("host_id <> 2")).first().n_host_unresolved == 1


def test_junction_clauses(spark):
    rnd = random.Random(2)
    hosts, decoy, paired = arms(rnd, 60, lambda r: "GCGCGGCCGCGGGCCGCGCC")
    _, _, control = arms(rnd, 60, lambda r: "A" * 20, first=1000)
    windows = lambda a: spark.createDataFrame([(a + i, "".join(rnd.choice("ACGT") for _ in range(80))) for i in range(60)], "id long, sequence string")
    frame = lambda rows: spark.createDataFrame(rows, ARM)
    h = spark.createDataFrame(hosts, "host_id long, sequence string")
    plain, null = windows(0), windows(100)
    r = probe.junction_measurement(plain, null, frame(control), frame(decoy), frame(paired), h, k=2, folds=3, seed="j").first()
    assert r.measured and r.arms_matched and r.probe_can_discriminate and r.junction_within_null_band and r.decoy_beats_junction
    # A junction that shows: controls with a tell-tale insert; decoys that are like them.
    _, _, marked = arms(rnd, 60, lambda r: "", first=2000)
    marked = [(*x[:6], x[6][:30] + "T" * 20 + x[6][50:]) for x in marked]
    r = probe.junction_measurement(plain, null, frame(marked), frame(decoy), frame(paired), h, k=2, folds=3, seed="j").first()
    assert not r.junction_within_null_band
    r = probe.junction_measurement(plain, null, frame([]), frame(decoy), frame(paired), h, k=2, folds=3, seed="j").first()
    assert not (r.measured or r.probe_can_discriminate or r.junction_within_null_band or r.decoy_beats_junction)
    for bad in (lambda: probe.junction_measurement(plain, plain, frame(control), frame(decoy), frame(paired), h, k=2, folds=3, seed="j"), lambda: probe.junction_measurement(plain, null, frame(paired), frame(decoy), frame(paired), h, k=2, folds=3, seed="j")):
        with pytest.raises(ValueError, match="both"):
            bad()
