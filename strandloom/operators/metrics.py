"""Evaluation: confusions, ranking metrics, calibration, bootstrap.

Undefined rates are null, never 0. Ranking metrics first collapse equal scores,
so the running sums are over distinct scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.posterior import sigmoid
from strandloom.operators.calling import runs
from strandloom.operators.statistics import global_rank, rank_in_group, running_sums
from strandloom.session import cut


def exact_run_detection(df: DataFrame, *, length: int, contig: str = "contig") -> DataFrame:
    """Contigs whose truth is exactly one run of ``length`` positions, and how
    many calls equal, contain or touch it (A06)."""
    truth = runs(df.where("truth").select(contig, "pos"), contig=contig)
    one = truth.groupBy(contig).agg(F.count(F.lit(1)).alias("_n"), F.min("start").alias("s"), F.max("end").alias("e")).where((F.col("_n") == 1) & (F.col("e") - F.col("s") == length))
    called = runs(df.where("called").select(contig, "pos"), contig=contig)
    j = one.join(called, contig, "left")
    hit = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    per = j.groupBy(contig).agg(
        hit((F.col("start") == F.col("s")) & (F.col("end") == F.col("e"))).alias("x"), hit((F.col("start") <= F.col("s")) & (F.col("end") >= F.col("e"))).alias("c"),
        hit((F.col("start") < F.col("e")) & (F.col("end") > F.col("s"))).alias("t"),
    )
    return per.agg(F.count(F.lit(1)).alias("n_scorable"), F.count_if("x").alias("n_exact"), F.count_if("c").alias("n_contains"), F.count_if("t").alias("n_touch"))


def class_confusion(df: DataFrame, *, truth: str, predicted: str, by: list[str]) -> DataFrame:
    """``tp, fp, fn`` per class and block (A02): each row is one count for its
    true class and one for its predicted class."""
    sides = F.array(F.struct(F.col(truth).alias("cls"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("cls"), F.lit(0).alias("t"), F.lit(1).alias("p")))
    rows = df.select(*by, (F.col(truth) == F.col(predicted)).alias("_eq"), F.explode(sides).alias("x"))
    return rows.groupBy(*by, F.col("x.cls").alias("cls")).agg(
        F.count_if(F.col("_eq") & (F.col("x.t") == 1)).alias("tp"), F.count_if(~F.col("_eq") & (F.col("x.p") == 1)).alias("fp"), F.count_if(~F.col("_eq") & (F.col("x.t") == 1)).alias("fn"),
    )


def prf(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and IoU from ``tp, fp, fn``."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (
        df.withColumn("precision", F.try_divide(tp, tp + fp)).withColumn("recall", F.try_divide(tp, tp + fn))
        .withColumn("f1", F.try_divide(2 * tp, 2 * tp + fp + fn)).withColumn("iou", F.try_divide(tp, tp + fp + fn))
    )


def operating_point(df: DataFrame, *, score: str, label: str, thresholds: list[int]) -> DataFrame:
    """Confusion at each threshold."""
    t = df.select(score, label, F.explode(F.array(*[F.lit(x) for x in thresholds])).alias("threshold"))
    pos, call = F.col(label) == 1, F.col(score) >= F.col("threshold")
    return t.groupBy("threshold").agg(F.count_if(pos & call).alias("tp"), F.count_if(~pos & call).alias("fp"), F.count_if(pos & ~call).alias("fn"), F.count_if(~pos & ~call).alias("tn"))


def ranking_curve(df: DataFrame, *, score: str, label: str, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Per distinct score: hits and false hits at or above it, and the totals. Without
    groups the running sums are spread over range partitions."""
    by = by or []
    one = F.col(weight) if weight else F.lit(1)
    n = df.groupBy(*by, score).agg(F.sum(F.when(F.col(label) == 1, one).otherwise(0)).alias("_p"), F.sum(F.when(F.col(label) == 1, 0).otherwise(one)).alias("_n"))
    if not by:
        sums = running_sums(n, [F.desc(score)], {"tp": "_p", "fp": "_n"})
        return sums.select(score, "_p", "tp", "fp", F.col("total_tp").alias("n_pos"), F.col("total_fp").alias("n_neg"))
    w = Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy(*by)
    return n.select(*by, score, "_p", F.sum("_p").over(w).alias("tp"), F.sum("_n").over(w).alias("fp"), F.sum("_p").over(total).alias("n_pos"), F.sum("_n").over(total).alias("n_neg"))


def average_precision(curve: DataFrame, *, by: list[str] | None = None, lam: Column | None = None) -> DataFrame:
    """Step estimator over distinct scores; decoys weigh ``lam``."""
    lam = F.lit(1.0) if lam is None else lam
    gain = F.try_divide(F.col("_p"), "n_pos") * F.try_divide(F.col("tp"), F.col("tp") + lam * F.col("fp"))
    return curve.groupBy(*(by or [])).agg(F.sum(gain).alias("ap"), F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"))


def matched_points(curve: DataFrame, *, score: str, precision: float, recall: float) -> DataFrame:
    """Largest recall at a precision, and largest precision at a recall, over
    reachable thresholds (M02)."""
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", "n_pos")
    rows = curve.select(F.col(score).alias("s"), p.alias("p"), r.alias("r"))
    return rows.agg(F.max(F.when(F.col("p") >= precision, F.col("r"))).alias("recall_at_precision"), F.max(F.when(F.col("r") >= recall, F.col("p"))).alias("precision_at_recall"), F.max(F.when(F.col("r") >= recall, F.col("s"))).alias("threshold"))


def reliability(df: DataFrame, *, p: str, label: str, id_col: str, bins: int = 15, by: list[str] | None = None) -> DataFrame:
    """Equal-mass bins: sizes differ by one at most, the first are larger.
    ``debiased_gap`` is the gap less the mean absolute deviation of a normal error of
    the bin's accuracy under its own scores, 0 at the least. Ranks come from range
    partitions, so no group is sorted by one task."""
    by = by or []
    ranked = rank_in_group(df.select(*by, p, label, id_col), by=by, order=[p, id_col])
    size, more = F.floor(F.col("n") / bins), F.col("n") % bins
    edge, at = more * (size + 1), F.col("rank") - 1
    b = ranked.withColumn("bin", (F.when(at < edge, F.floor(at / (size + 1))).otherwise(more + F.floor((at - edge) / F.greatest(size, F.lit(1)))) + 1).cast("int"))
    g = b.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("conf"), F.avg(label).alias("acc"), F.sum(F.col(p) * (1 - F.col(p))).alias("_v"))
    gap = F.abs(F.col("conf") - F.col("acc"))
    noise = F.sqrt(F.col("_v")) / F.col("n") * F.lit(math.sqrt(2 / math.pi))
    return g.withColumn("gap", gap).withColumn("debiased_gap", F.greatest(F.lit(0.0), gap - noise)).drop("_v")


def ece(table: DataFrame, by: list[str] | None = None, gap: str = "gap") -> DataFrame:
    """Expected calibration error of reliability bins; with ``gap="debiased_gap"``
    less the mean gap that calibrated scores would show by chance."""
    return table.groupBy(*(by or [])).agg((F.sum(F.col("n") * F.col(gap)) / F.sum("n")).alias("ece"))


def prior_band(df: DataFrame, *, logit: str, label: str, id_col: str, priors: list[float], bins: int = 15) -> DataFrame:
    """``prior, ece`` of scores whose log-odds are shifted to each prior of a band."""
    rows = df.withColumn("prior", F.explode(F.array(*(F.lit(float(x)) for x in priors))))
    rows = rows.withColumn("p", sigmoid(F.col(logit) + F.log(F.col("prior") / (1 - F.col("prior")))))
    return ece(reliability(rows, p="p", label=label, id_col=id_col, bins=bins, by=["prior"]), ["prior"])


#: Distinct scores of a tile, and how far below the largest weight a tile is left out: its
#: scores add less than ``exp(-TAIL)`` of it each, some 10^-13 for a billion of them.
TILE, TAIL = 1000, 50.0


def kernel_calibration(df: DataFrame, *, p: str, label: str, bandwidths: list[float], levels: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Leave-one-out Beta-kernel estimates per bandwidth: mean gap and log likelihood
    (M05). A score ``q`` weighs on another ``p`` as the Beta density of shapes
    ``p / h + 1, (1 - p) / h + 1`` at ``q``, relative to the largest such weight.

    Equal scores are one row. They meet tile by tile of ``TILE`` neighbours, and only
    where a tile's nearest end can still weigh; all that is left out adds less than
    ``exp(-TAIL)`` a score. With ``levels`` scores are rounded to so many steps first,
    which is an approximation. Work grows with the square of the distinct scores within
    reach. Groups ``by`` are many or few; a group is numbered in one task, the whole
    table by range partitions. A score without any other has no estimate."""
    by, eps = by or [], 1e-12
    score = F.col(p) if levels is None else F.round(F.col(p) * levels) / levels
    g = df.groupBy(*by, score.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("k")).where("p IS NOT NULL")
    inside = lambda c: F.greatest(F.least(c, F.lit(1 - eps)), F.lit(eps))
    apart = lambda x, y: x * (F.log(inside(x)) - F.log(inside(y))) + (1 - x) * (F.log(1 - inside(x)) - F.log(1 - inside(y)))
    if by:
        order = Window.partitionBy(*by).orderBy("p")
        g = g.select("*", F.row_number().over(order).alias("r"), F.lag("p").over(order).alias("_lo"), F.lead("p").over(order).alias("_hi"))
    else:
        ranked = global_rank(g, [F.col("p")], "r")
        beside = lambda d, name: ranked.select((F.col("r") + d).alias("r"), F.col("p").alias(name))
        g = ranked.join(beside(1, "_lo"), "r", "left").join(beside(-1, "_hi"), "r", "left")
    # How far the nearest score that counts is: an equal one, or a neighbour.
    near = F.when(F.col("n") > 1, 0.0).otherwise(F.least(apart(F.col("p"), F.col("_lo")), apart(F.col("p"), F.col("_hi"))))
    g = cut(g.select(*by, "p", "n", "k", F.floor((F.col("r") - 1) / TILE).alias("tile"), near.alias("near")))
    ends = g.groupBy(*by, "tile").agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.max("near").alias("near")).withColumn("_one", F.lit(1))
    other = ends.select("_one", *by, F.col("tile").alias("tile2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    gap = F.when(F.col("tile") == F.col("tile2"), 0.0).when(F.col("tile") < F.col("tile2"), apart(F.col("hi"), F.col("lo2"))).otherwise(apart(F.col("lo"), F.col("hi2")))
    h = F.explode(F.array(*(F.lit(float(x)) for x in bandwidths))).alias("h")
    # One row of ends a tile; ``_one`` joins the tiles of a table without groups.
    reach = ends.join(other, ["_one", *by]).select(*by, "tile", "tile2", gap.alias("gap"), "near", h).where(F.col("gap") <= F.col("near") + TAIL * F.col("h")).select(*by, "tile", "tile2", "h")
    a = g.join(reach, [*by, "tile"]).drop("tile")
    b = g.select(*by, F.col("tile").alias("tile2"), F.col("p").alias("q"), F.col("n").alias("m"), F.col("k").alias("j"))
    kern = F.exp((F.col("near") - apart(F.col("p"), F.col("q"))) / F.col("h"))
    pairs = a.join(b, [*by, "tile2"]).where((F.col("n") > 1) | (F.col("p") != F.col("q"))).select(*by, "h", "p", "n", "k", (kern * F.col("m")).alias("w"), (kern * F.col("j")).alias("wk"))
    est = pairs.groupBy(*by, "h", "p", "n", "k").agg(F.sum("w").alias("w"), F.sum("wk").alias("wk"))
    own = F.when(F.col("n") > 1, 1.0).otherwise(0.0)
    one = lambda y: F.try_divide(F.col("wk") - y * own, F.col("w") - own)
    ll = F.col("k") * F.log(inside(one(1))) + (F.col("n") - F.col("k")) * F.log(1 - inside(one(0)))
    off = F.col("k") * F.abs(one(1) - F.col("p")) + (F.col("n") - F.col("k")) * F.abs(one(0) - F.col("p"))
    return est.groupBy(*by, "h").agg((F.sum(off) / F.sum("n")).alias("ece"), F.sum(ll).alias("log_likelihood"))


def choose_bandwidth(table: DataFrame) -> DataFrame:
    """The row of ``kernel_calibration`` of the largest leave-one-out likelihood,
    the smaller bandwidth on a tie (M05)."""
    return table.orderBy(F.desc("log_likelihood"), "h").limit(1)


def brier_decomposition(bins: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Reliability, resolution and uncertainty of reliability bins (M05): their
    sum with signs, ``reliability - resolution + uncertainty``, is the Brier score of
    the bins' mean scores."""
    by = by or []
    g = bins.groupBy(*by).agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("acc")) / F.sum("n")).alias("base"), (F.sum(F.col("n") * (F.col("conf") - F.col("acc")) ** 2) / F.sum("n")).alias("reliability"),
        (F.sum(F.col("n") * F.col("acc") ** 2) / F.sum("n")).alias("_sq"),
    )
    return g.select(*by, "n", "reliability", (F.col("_sq") - F.col("base") ** 2).alias("resolution"), (F.col("base") * (1 - F.col("base"))).alias("uncertainty"))


def unit_grades(df: DataFrame, *, unit: str, p: str, label: str, minimum: int, bandwidth: float) -> DataFrame:
    """``n, admissible, brier, ece`` of each unit (M09), ``ece`` by the kernel estimate;
    units below ``minimum`` rows have no grade. Grades of larger groups follow from
    another column as ``unit``."""
    ok = F.col("n") >= minimum
    g = df.groupBy(unit).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(p) - F.col(label)) ** 2).alias("_b"))
    k = kernel_calibration(df.where(F.col(unit).isNotNull()), p=p, label=label, bandwidths=[bandwidth], by=[unit]).select(unit, F.col("ece").alias("_e"))
    return g.join(k, unit, "left").select(unit, "n", ok.alias("admissible"), F.when(ok, F.col("_b")).alias("brier"), F.when(ok, F.col("_e")).alias("ece"))


def strand_robustness(df: DataFrame, *, id_col: str, confirmed: str) -> DataFrame:
    """From one row per item and strand (M10): items, those confirmed on any strand,
    and those whose verdict doesn't depend on it."""
    per = df.groupBy(id_col).agg(F.bool_or(confirmed).alias("_any"), F.bool_and(confirmed).alias("_all"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.count_if("_any").alias("confirmed"), F.count_if(F.col("_any") == F.col("_all")).alias("invariant"))


def _replicate_aurocs(df: DataFrame, *, score: str, label: str, block: str, replicates: int, seed: str) -> DataFrame:
    """``rep, auroc`` of replicates of whole blocks. A row goes once, with its weights in all
    replicates, to its range of scores; ranges give rank sums of their own, and what lies
    below a range follows from the ranges' counts."""
    drawn = F.map_from_entries(F.collect_list(F.struct("rep", "weight")))
    weights = block_bootstrap_weights(df, block=block, replicates=replicates, seed=seed).groupBy(block).agg(drawn.alias("_m"))
    times = F.transform(F.sequence(F.lit(1), F.lit(replicates)), lambda r: F.coalesce(F.col("_m")[r], F.lit(0)).cast("int"))
    small = df.groupBy(block, score, F.coalesce(F.col(label) == 1, F.lit(False)).alias("_y")).agg(F.count(F.lit(1)).alias("_k")).join(weights.select(block, times.alias("_w")), block)
    ranges = small.select(score, "_y", "_k", "_w").repartitionByRange(score).sortWithinPartitions(score)
    # A null score is one score, before all others.
    rows = ranges.select(F.spark_partition_id().alias("p"), F.col(score).isNull().alias("void"), F.coalesce(F.col(score), F.lit(0).cast(df.schema[score].dataType)).alias("s"), "_y", "_k", "_w")

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last, below, u, total = None, None, np.zeros(replicates), np.zeros(replicates), np.zeros(replicates)
        p, n = np.zeros((1, replicates)), np.zeros((1, replicates))  # of the score not yet ended

        def ended(p: np.ndarray, n: np.ndarray) -> None:
            nonlocal below, u, total
            u = u + (p * (below + np.cumsum(n, axis=0) - n / 2)).sum(axis=0)
            below, total = below + n.sum(axis=0), total + p.sum(axis=0)

        for b in batches:
            if not len(b):
                continue
            at, s, void = int(b["p"].iloc[0]), b["s"].to_numpy(), b["void"].to_numpy(bool)
            same = (s[1:] == s[:-1]) | ((s[1:] != s[1:]) & (s[:-1] != s[:-1]))
            starts = np.flatnonzero(np.concatenate([[True], ~(same & (void[1:] == void[:-1]))]))
            w = np.stack(b["_w"].to_numpy()).astype(np.float64) * b["_k"].to_numpy(np.float64)[:, None]
            y = b["_y"].to_numpy(bool)[:, None]
            ps, ns = np.add.reduceat(w * y, starts), np.add.reduceat(w * ~y, starts)
            if last is not None and last[1] == void[0] and (last[0] == s[0] or (last[0] != last[0] and s[0] != s[0])):
                ps[0], ns[0] = ps[0] + p[0], ns[0] + n[0]
            else:
                ps, ns = np.concatenate([p, ps]), np.concatenate([n, ns])
            ended(ps[:-1], ns[:-1])
            p, n, last = ps[-1:], ns[-1:], (s[-1], void[-1])
        ended(p, n)
        if at is not None:
            yield pd.DataFrame({"p": at, "rep": np.arange(1, replicates + 1), "pos": total, "neg": below, "u": u})

    each = rows.mapInPandas(sums, "p int, rep int, pos double, neg double, u double")
    lower = F.coalesce(F.sum("neg").over(Window.partitionBy("rep").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    both = each.withColumn("u", F.col("u") + F.col("pos") * lower).groupBy("rep").agg(*(F.sum(c).alias(c) for c in ("pos", "neg", "u")))
    return both.select("rep", F.try_divide("u", F.col("pos") * F.col("neg")).alias("auroc"))


def auroc_interval(df: DataFrame, *, score: str, label: str, block: str, replicates: int, seed: str, alpha: float = 0.05) -> DataFrame:
    """AUROC and the percentile interval over replicates of whole blocks (M12); no
    interval below two blocks. Rows are compressed to block and score first."""
    ends = _replicate_aurocs(df, score=score, label=label, block=block, replicates=replicates, seed=seed).agg(F.percentile("auroc", F.lit(alpha / 2)).alias("lo"), F.percentile("auroc", F.lit(1 - alpha / 2)).alias("hi"))
    whole = auroc(df, score=score, label=label).select("auroc", "n_pos", "n_neg").join(df.agg(F.count_distinct(block).alias("n_blocks")), F.lit(True))
    ok = F.col("n_blocks") >= 2
    return whole.join(ends, F.lit(True)).select("n_blocks", "auroc", F.when(ok, F.col("lo")).alias("lo"), F.when(ok, F.col("hi")).alias("hi"))


def duplicate_agreement(df: DataFrame, *, payload: str, posterior: str, tolerance: float) -> DataFrame:
    """Payloads scored more than once, those whose scores agree within the tolerance,
    and the largest spread (M10)."""
    g = df.groupBy(payload).agg(F.count(F.lit(1)).alias("_n"), (F.max(posterior) - F.min(posterior)).alias("_d")).where(F.col("_n") > 1)
    return g.agg(F.count(F.lit(1)).alias("n_repeated"), F.count_if(F.col("_d") <= tolerance).alias("n_agree"), F.max("_d").alias("largest"))


def arm_intervals(df: DataFrame, *, arm: str, block: str, score: str, label: str, replicates: int, seed: str, alpha: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Bootstrap intervals of average precision (M08): per arm, and of the paired
    difference between every two arms, over the same replicates of whole blocks.
    Rows are compressed to arm, block and score before the replicates multiply them."""
    w = block_bootstrap_weights(df, block=block, replicates=replicates, seed=seed)
    small = df.groupBy(arm, block, score, label).agg(F.count(F.lit(1)).alias("_k")).join(w, block).withColumn("_wt", F.col("_k") * F.col("weight"))
    ap = average_precision(ranking_curve(small, score=score, label=label, by=[arm, "rep"], weight="_wt"), by=[arm, "rep"]).select(arm, "rep", "ap")
    ends = lambda c: (F.percentile(c, F.lit(alpha / 2)).alias("lo"), F.percentile(c, F.lit(1 - alpha / 2)).alias("hi"), F.count(F.lit(1)).alias("n"))
    other = ap.select(F.col(arm).alias("other"), "rep", F.col("ap").alias("_ap"))
    pairs = ap.join(other, "rep").where(F.col(arm) < F.col("other")).withColumn("_d", F.col("ap") - F.col("_ap"))
    return ap.groupBy(arm).agg(*ends("ap")), pairs.groupBy(arm, "other").agg(*ends("_d"))


def fit_temperature(df: DataFrame, *, logit: str, label: str, lo: float = 0.05, hi: float = 20.0, points: int = 16, rounds: int = 9) -> float | None:
    """Inverse temperature that makes the likelihood's derivative zero, by
    k-section: each round one job has the derivative at ``points`` places (M06).
    None if the bracket has no sign change."""
    rows = df.groupBy(logit, label).agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.persist()
    try:
        for _ in range(rounds):
            betas = [lo + (hi - lo) * i / (points - 1) for i in range(points)]
            z = rows.withColumn("b", F.explode(F.array(*[F.lit(b) for b in betas])))
            sig = 1 / (1 + F.exp(-F.col("b") * F.col(logit)))
            grad = dict(z.groupBy("b").agg(F.sum(F.col("_n") * (sig - F.col(label)) * F.col(logit)).alias("g")).collect())
            pair = next(((a, b) for a, b in zip(betas, betas[1:], strict=False) if grad[a] <= 0 <= grad[b] or grad[a] >= 0 >= grad[b]), None)
            if pair is None:
                return None
            lo, hi = pair
        return (lo + hi) / 2
    finally:
        rows.unpersist()


#: Draws that a task makes of one replicate at a time.
DRAWS = 20_000


def block_bootstrap_weights(blocks: DataFrame, *, block: str, replicates: int, seed: str) -> DataFrame:
    """``rep, block, weight``: whole blocks drawn with replacement by hashes.
    Blocks are numbered by name, over range partitions; draws and numbers meet in an
    equi-join. Every replicate draws as many blocks as there are; for very many blocks
    ``poisson_weights`` need no number at all."""
    n = global_rank(blocks.select(block).distinct(), [F.col(block)], "_rank").select(block, (F.col("_rank") - 1).alias("_i"))
    size = n.agg(F.count(F.lit(1)).alias("_k"))
    # Runs of draws are dealt to a fixed number of tasks: so few rows would else be put into one.
    many = size.where("_k > 0").select(F.col("_k").cast("int").alias("_k"), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep"))
    parts = many.withColumn("_f", F.explode(F.sequence(F.lit(1), F.col("_k"), F.lit(DRAWS)))).repartition(max(replicates, 32), "rep", "_f")
    draws = parts.withColumn("_d", F.explode(F.sequence("_f", F.least(F.col("_f") + DRAWS - 1, "_k"))))
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("rep").cast("string"), F.col("_d").cast("string"))), 1, 8), 16, 10).cast("bigint") % F.col("_k")
    return draws.select("rep", pick.alias("_i")).join(n, "_i").groupBy("rep", block).agg(F.count(F.lit(1)).alias("weight"))


#: Shares of draws of at most 0, 1, ... times when the mean is one (rounded Poisson sums);
#: twelve times or more has a chance of one in 10^9 and counts as twelve.
_POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12)]


def poisson_weights(blocks: DataFrame, *, block: str, replicates: int, seed: str) -> DataFrame:
    """``rep, block, weight`` as ``block_bootstrap_weights``, but each block is drawn for
    itself, a Poisson number of times by a hash of seed, replicate and block (M07): no
    numbering, no exchange, and the same draws however the rows lie. Sizes of replicates
    vary as one in the root of the number of blocks, which ratios do not feel."""
    rows = blocks.select(block).distinct().withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("rep").cast("string"), F.col(block).cast("string"))), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    weight = reduce(lambda a, b: a + b, [F.when(u >= c, 1).otherwise(0) for c in _POISSON])
    return rows.select("rep", block, weight.cast("long").alias("weight")).where("weight > 0")


def bootstrap_ratio(sums: DataFrame, weights: DataFrame, *, block: str, numerator: str, denominator: str, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of a ratio of block sums (M07); null below two blocks."""
    per = weights.join(sums, block).groupBy("rep").agg(F.try_divide(F.sum(F.col("weight") * F.col(numerator)), F.sum(F.col("weight") * F.col(denominator))).alias("v"))
    n = sums.agg(F.count(F.lit(1)).alias("n_blocks"), F.try_divide(F.sum(numerator), F.sum(denominator)).alias("point"))
    ends = per.agg(F.percentile("v", F.lit(alpha / 2)).alias("lo"), F.percentile("v", F.lit(1 - alpha / 2)).alias("hi"))
    ok = F.col("n_blocks") >= 2
    return n.join(ends, F.lit(True)).select("n_blocks", "point", F.when(ok, F.col("lo")).alias("lo"), F.when(ok, F.col("hi")).alias("hi"))


def auroc(df: DataFrame, *, score: str, label: str, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Rank-sum AUROC with mid-ranks for ties, and its null standard error (M11);
    rows count as often as their integer ``weight``."""
    by = by or []
    one = F.col(weight) if weight else F.lit(1)
    n = df.groupBy(*by, score).agg(F.sum(F.when(F.col(label) == 1, one).otherwise(0)).alias("_p"), F.sum(F.when(F.col(label) == 1, 0).otherwise(one)).alias("_n"))
    if by:
        below = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    else:
        n, below = running_sums(n, [F.col(score)], {"_upto": "_n"}), F.col("_upto") - F.col("_n")
    rows = n.select(*by, "_p", "_n", (F.col("_p") * (below + F.col("_n") / 2)).alias("_u"))
    np_, nn = F.sum("_p"), F.sum("_n")
    return rows.groupBy(*by).agg(np_.alias("n_pos"), nn.alias("n_neg"), F.try_divide(F.sum("_u"), np_ * nn).alias("auroc"), F.sqrt(F.try_divide(np_ + nn + 1, 12 * np_ * nn)).alias("null_se"))
