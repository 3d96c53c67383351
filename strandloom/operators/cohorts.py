"""Cohorts and splits: roles of clusters, populations, folds, rungs, subsets.

Tables are keyed by record and cluster; roles follow from columns the caller names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.selection import top_per_group


def cluster_spread(df: DataFrame, *, cluster: str, taxa: list[str], top: str) -> DataFrame:
    """Distinct taxa of each rank in a cluster, ``n_<rank>``, and whether it crosses
    the rank ``top`` (C03); nulls don't count."""
    g = df.groupBy(cluster).agg(*(F.count_distinct(t).alias(f"n_{t}") for t in taxa))
    return g.withColumn("crosses", F.col(f"n_{top}") > 1)


def split_ladder(df: DataFrame, *, cluster: str, heldout: Column, dropped: Column) -> DataFrame:
    """Adds ``role`` (C04): ``heldout`` rows, rows of a cluster with a held-out member
    ``excluded``, other rows ``dropped`` or ``train``. A null condition is false; rows
    without a cluster are judged alone."""
    held = F.coalesce(heldout, F.lit(False))
    linked = df.where(held).select(cluster).dropna().distinct().withColumn("_linked", F.lit(True))
    role = F.when(held, "heldout").when(F.col("_linked"), "excluded").when(F.coalesce(dropped, F.lit(False)), "dropped").otherwise("train")
    return df.join(linked, cluster, "left").withColumn("role", role).drop("_linked")


def rungs(df: DataFrame, *, fold: str, train: str, nested: str, calibration: str, heldout: str) -> DataFrame:
    """Adds ``rung`` (F13): ``calibration`` or ``train`` inside nested training, then
    ``out_of_distribution`` for held-out rows, ``excluded`` for the rest of the training
    fold, else ``in_distribution``. A calibration row outside the training fold is an error."""
    bad = F.col(calibration) & ~F.col(fold).eqNullSafe(train)
    checked = df.where(F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("calibration outside train")).cast("boolean")).otherwise(True))
    rung = F.when(F.col(nested) & F.col(calibration), "calibration").when(F.col(nested), "train").when(F.col(heldout), "out_of_distribution").when(F.col(fold) == train, "excluded").otherwise("in_distribution")
    return checked.withColumn("rung", rung)


def populations(df: DataFrame, *, cluster: str, fold: str, nested: str, heldout: str, unit: str, minimum: int, selection: str = "val", graded: str = "test") -> DataFrame:
    """Rows with their ``population`` (F18), a row in each it belongs to: ``train`` is
    nested training without any cluster of the graded or the selection fold,
    ``selection`` that fold, ``graded`` all rows of clusters with a graded member, and
    ``heldout`` the held-out rows of units with at least ``minimum`` of them."""
    of = lambda name: df.where(F.col(fold) == name).select(cluster).distinct()
    big = df.where(heldout).groupBy(unit).agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") >= minimum).select(unit)
    parts = {
        "train": df.where(nested).join(of(graded), cluster, "left_anti").join(of(selection), cluster, "left_anti"), "selection": df.where(F.col(fold) == selection),
        "graded": df.join(of(graded), cluster, "left_semi"), "heldout": df.where(heldout).join(big, unit, "left_semi"),
    }
    out = None
    for name, p in parts.items():
        p = p.select(*df.columns).withColumn("population", F.lit(name))
        out = p if out is None else out.unionByName(p)
    return out


def stamp_parents(rows: DataFrame, parents: DataFrame, *, parent: str, columns: list[str]) -> DataFrame:
    """Rows with their parent's ``columns`` and ``resolved`` (J07): null and false where
    the parent is unknown. A parent listed twice is an error."""
    known = parents.groupBy(parent).agg(*(F.min(c).alias(c) for c in columns), F.count(F.lit(1)).alias("_n"))
    known = known.where(F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.concat(F.lit("parent listed twice: "), F.col(parent).cast("string"))).cast("boolean"))).drop("_n")
    return rows.join(known.withColumn("_known", F.lit(True)), parent, "left").withColumn("resolved", F.coalesce("_known", F.lit(False))).drop("_known")


def first_and_majority(df: DataFrame, *, cluster: str, value: str, order: str) -> DataFrame:
    """First non-null value of each cluster in table order and its most frequent one
    (W13), the smaller on a tie."""
    first = df.where(F.col(value).isNotNull()).groupBy(cluster).agg(F.min_by(value, order).alias(f"first_{value}"))
    major = df.where(F.col(value).isNotNull()).groupBy(cluster, value).agg(F.count(F.lit(1)).alias("_k")).groupBy(cluster).agg(F.min_by(value, F.struct(-F.col("_k"), value)).alias(f"majority_{value}"))
    return df.select(cluster).distinct().join(first, cluster, "left").join(major, cluster, "left")


def round_decisions(df: DataFrame, *, run: str, order: str, recall: str, drop: int | float) -> DataFrame:
    """Adds the best recall so far, this round included, and ``halt`` (W12): whether the
    round lies ``drop`` or more below it."""
    best = F.max(recall).over(Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("best", best).withColumn("halt", F.col("best") - F.col(recall) >= drop)


def covering_subset(df: DataFrame, *, cls: list[str], id_col: str, minimum: int, seed: str) -> DataFrame:
    """The first ``minimum`` rows of every class in hash order."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    return top_per_group(df.withColumn("_h", h), cls, [F.col("_h"), F.col(id_col)], minimum).drop("_h")


def coverage_report(df: DataFrame, subset: DataFrame, *, cls: list[str], id_col: str, minimum: int, forbidden: DataFrame | None = None) -> DataFrame:
    """Per class: rows, rows in the subset, whether it has the minimum or all there are,
    and subset rows that a table of ids forbids (F20)."""
    bad = (forbidden.select(id_col).distinct() if forbidden is not None else df.select(id_col).where(F.lit(False))).withColumn("_bad", F.lit(1))
    chosen = subset.select(id_col).distinct().withColumn("_in", F.lit(1))
    j = df.select(*cls, id_col).join(chosen, id_col, "left").join(bad, id_col, "left")
    g = j.groupBy(*cls).agg(F.count(F.lit(1)).alias("n"), F.count("_in").alias("n_subset"), F.count_if(F.col("_in").isNotNull() & F.col("_bad").isNotNull()).alias("n_leaked"))
    return g.withColumn("covered", F.col("n_subset") >= F.least(F.col("n"), F.lit(minimum)))


def expected_strata(df: DataFrame, *, stratum: str, draws: list[int]) -> DataFrame:
    """Expected distinct strata among ``k`` rows drawn without replacement."""
    g = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("s"))
    g = g.withColumn("n", g.agg(F.sum("s")).scalar()).withColumn("k", F.explode(F.array(*[F.lit(x) for x in draws])))
    steps = F.sequence(F.lit(0), F.col("k") - 1)
    logs = F.aggregate(steps, F.lit(0.0), lambda a, i: a + F.log((F.col("n") - F.col("s") - i) / (F.col("n") - i)))
    # With fewer other rows than draws the stratum is met for certain.
    return g.groupBy("k").agg(F.sum(F.when(F.col("n") - F.col("s") < F.col("k"), 1.0).otherwise(1 - F.exp(logs))).alias("expected"))


def power_table(df: DataFrame, *, arm: str, block: str, minimum: int) -> DataFrame:
    """Rows, blocks and verdict of each arm (A14, C06): ``too_few`` rows,
    ``not_resamplable`` with fewer than two blocks, else ``powered``."""
    g = df.groupBy(arm).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(block).alias("blocks"))
    return g.withColumn("verdict", F.when(F.col("n") < minimum, "too_few").when(F.col("blocks") < 2, "not_resamplable").otherwise("powered"))


def floor_sweep(counts: DataFrame, *, n: str, floors: list[int]) -> DataFrame:
    """Units that clear each floor and their share."""
    rows = counts.withColumn("floor", F.explode(F.array(*[F.lit(x) for x in floors])))
    ok = F.count_if(F.col(n) >= F.col("floor"))
    return rows.groupBy("floor").agg(ok.alias("cleared"), F.count(F.lit(1)).alias("units"), (ok / F.count(F.lit(1))).alias("fraction"))


def recovery(items: DataFrame, calls: DataFrame, *, item: str, by: list[str]) -> DataFrame:
    """Items and those with at least one call, per group."""
    hit = calls.select(item).distinct().withColumn("_hit", F.lit(1))
    return items.join(hit, item, "left").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count("_hit").alias("recovered"), F.try_divide(F.count("_hit"), F.count(F.lit(1))).alias("rate"))


def hit_windows(windows: DataFrame, hits: DataFrame, *, window: str, score: str, at_least: float, by: list[str]) -> DataFrame:
    """Hits joined to windows by name, windows, and windows removed because a hit of
    theirs reaches the score, per group (J13). Hits are reduced to one row a window first."""
    best = hits.groupBy(window).agg(F.count(F.lit(1)).alias("_k"), F.max(score).alias("_top"))
    return windows.join(best, window, "left").groupBy(*by).agg(F.coalesce(F.sum("_k"), F.lit(0)).alias("joined"), F.count(F.lit(1)).alias("windows"), F.count_if(F.col("_top") >= at_least).alias("removed"))


def price_settings(df: DataFrame, *, settings: list[dict[str, float]], scores: list[str], known: Column) -> DataFrame:
    """For each setting of thresholds, one per score (J22): candidates that no score
    spares (``mined``), those the first alone would leave (``ceiling``), and known
    controls among the mined (``damaged``)."""
    grid = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("setting"), *(F.lit(s[c]).alias(f"_t_{c}") for c in scores)) for i, s in enumerate(settings)]))
    rows = df.select(known.alias("_known"), *scores, grid.alias("g"))
    spared = [F.coalesce(F.col(c) >= F.col(f"g._t_{c}"), F.lit(False)) for c in scores]
    mined = ~spared[0]
    for s in spared[1:]:
        mined = mined & ~s
    return rows.groupBy("g.setting").agg(F.count_if(mined).alias("mined"), F.count_if(~spared[0]).alias("ceiling"), F.count_if(F.col("_known") & mined).alias("damaged"))


def compare_controls(df: DataFrame, *, settings: list[float], score: str, control: Column, by: list[str]) -> DataFrame:
    """Failures of controls and of candidates at each setting and stratum (C07): a score
    below the setting fails; ``anti_selective`` where controls fail more often."""
    rows = df.withColumn("setting", F.explode(F.array(*[F.lit(s) for s in settings]))).withColumn("_c", control)
    failed = F.col(score) < F.col("setting")
    g = rows.groupBy("setting", *by).agg(
        F.count_if("_c").alias("controls"), F.count_if(F.col("_c") & failed).alias("control_failed"), F.count_if(~F.col("_c")).alias("candidates"), F.count_if(~F.col("_c") & failed).alias("candidate_failed"),
    )
    return g.withColumn("anti_selective", F.coalesce(F.try_divide("control_failed", "controls") > F.try_divide("candidate_failed", "candidates"), F.lit(False)))


def grid_inertness(states: DataFrame, *, id_col: str, parameter: str, state: str, by: list[str]) -> DataFrame:
    """Whether a parameter matters (C08): items whose state differs between its values,
    per setting ``by`` of the others; with none it is ``inert``."""
    per = states.groupBy(*by, id_col).agg((F.count_distinct(state) > 1).alias("_d"))
    return per.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if("_d").alias("differing")).withColumn("inert", F.col("differing") == 0)


def published(df: DataFrame, *, id_col: str, strand: str, posterior: str) -> DataFrame:
    """One posterior from two orientations (A33): the larger, the plus strand on a tie."""
    return df.groupBy(id_col).agg(F.max(posterior).alias("best"), F.max_by(strand, F.struct(posterior, strand)).alias(strand))


def separation_census(df: DataFrame, *, arm: str, label: str, score: str) -> DataFrame:
    """Lowest positive, highest negative and whether they part (A34), per arm."""
    lo, hi = F.min(F.when(F.col(label) == 1, F.col(score))), F.max(F.when(F.col(label) == 0, F.col(score)))
    return df.groupBy(arm).agg((lo > hi).alias("separated"), lo.alias("low_pos"), hi.alias("high_neg"))


def class_weights(df: DataFrame, *, cls: str, power: float = 0.5) -> DataFrame:
    """Inverse-frequency weights of mean one and each class's share of the loss."""
    n = df.groupBy(cls).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()
    w = n.withColumn("_w", F.pow(F.sum("n").over(every) / F.col("n"), F.lit(power)))
    return w.select(cls, "n", (F.col("_w") / F.avg("_w").over(every)).alias("weight"), (F.col("n") * F.col("_w") / F.sum(F.col("n") * F.col("_w")).over(every)).alias("loss_share"))
