"""Statistics over tables: percentiles, distances, intervals, power."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import cut


def nearest_rank(df: DataFrame, value: str, q: float, *, by: list[str], id_col: str) -> DataFrame:
    """Value of rank ``ceil(q * n)`` in each group, and ``n`` (A10)."""
    ranked = rank_in_group(df.where(F.col(value).isNotNull()).select(*by, value, id_col), by=by, order=[value, id_col])
    return ranked.where(F.col("rank") == F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("n")))).select(*by, F.col(value).alias("value"), "n")


def linear_percentiles(df: DataFrame, value: str, qs: dict[str, float], *, by: list[str], id_col: str) -> DataFrame:
    """Percentiles by linear interpolation between the two nearest ranks of each
    group (A10), a column for each name of ``qs``; no group is held by one task."""
    ranked = rank_in_group(df.where(F.col(value).isNotNull()).select(*by, value, id_col), by=by, order=[value, id_col])

    def part(q: float) -> Column:
        at = F.lit(q) * (F.col("n") - 1) + 1
        share = F.when(F.col("rank") == F.floor(at), 1 - (at - F.floor(at))).when(F.col("rank") == F.floor(at) + 1, at - F.floor(at))
        return F.sum(F.when(share > 0, share * F.col(value)))

    return ranked.groupBy(*by).agg(*(part(q).alias(name) for name, q in qs.items()))


def ks_statistic(df: DataFrame, value: str, arm: str, first, second, *, by: list[str]) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per group."""
    counts = df.where(F.col(arm).isin(first, second)).groupBy(*by, value).agg(F.count_if(F.col(arm) == first).alias("_a"), F.count_if(F.col(arm) == second).alias("_b"))
    if not by:
        sums = running_sums(counts, [F.col(value)], {"a": "_a", "b": "_b"})
        return sums.agg(F.max(F.abs(F.try_divide("a", "total_a") - F.try_divide("b", "total_b"))).alias("ks"))
    w = Window.partitionBy(*by)
    run = w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    gap = F.abs(F.try_divide(F.sum("_a").over(run), F.sum("_a").over(w)) - F.try_divide(F.sum("_b").over(run), F.sum("_b").over(w)))
    return counts.select(*by, gap.alias("_gap")).groupBy(*by).agg(F.max("_gap").alias("ks"))


def wilson(k: Column, n: Column, z: float = 1.959964) -> tuple[Column, Column]:
    """Ends of the Wilson interval of ``k`` of ``n``; null if ``n`` is 0."""
    p = F.try_divide(k, n)
    den = 1 + F.try_divide(F.lit(z * z), n)
    mid = p + F.try_divide(F.lit(z * z / 2), n)
    half = F.lit(z) * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z / 4), n * n))
    return (mid - half) / den, (mid + half) / den


def binomial_se(k: Column, n: Column) -> Column:
    """Standard error of the share ``k`` of ``n``."""
    p = F.try_divide(k, n)
    return F.sqrt(F.try_divide(p * (1 - p), n))


def minimum_detectable_effect(p: Column, n: Column, *, z_alpha: float = 1.959964, z_power: float = 0.841621) -> Column:
    """Smallest difference from a rate ``p`` that two arms of ``n`` show at the given
    normal quantiles of level and power (A12)."""
    return F.lit(z_alpha + z_power) * F.sqrt(F.try_divide(2 * p * (1 - p), n))


def false_discovery_budget(rate: Column, tested: Column, accepted: Column) -> Column:
    """Share of accepted items that a false-pass rate among those tested allows to be
    false, 1 at most (A12)."""
    return F.least(F.lit(1.0), F.try_divide(rate * tested, accepted))


def rank_in_group(df: DataFrame, *, by: list[str], order: list[str]) -> DataFrame:
    """``rank`` (1..n) of each row in its group by a total order, and ``n``, from one
    global rank: a large group is spread over tasks like any other rows. Groups
    ``by`` are few; null is one."""
    ranked = global_rank(df, [*(F.col(c) for c in by), *(F.col(c) for c in order)], "_rank")
    if not by:
        return ranked.withColumnRenamed("_rank", "rank").withColumn("n", df.agg(F.count(F.lit(1))).scalar())
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*(F.col(c).alias(f"_g_{c}") for c in by), "n", before.alias("_before"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return ranked.join(sizes, same).withColumn("rank", F.col("_rank") - F.col("_before")).select(*df.columns, "rank", "n")


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Adds for each ``name: column`` the column's sum over the rows up to this one,
    ``name``, and over all, ``total_<name>``, in a total order of the whole table. Rows
    are range-partitioned, summed inside partitions, and each partition's start follows
    from the partitions' totals (one row each)."""
    parts = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.select("*", *(F.sum(c).over(own).alias(f"_own_{n}") for n, c in sums.items()))
    earlier, every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    totals = parts.groupBy("_part").agg(*(F.sum(c).alias(f"_s_{n}") for n, c in sums.items()))
    starts = totals.select("_part", *(F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums), *(F.sum(f"_s_{n}").over(every).alias(f"total_{n}") for n in sums))
    joined = local.join(F.broadcast(starts), "_part")
    return joined.select(*df.columns, *((F.col(f"_own_{n}") + F.col(f"_before_{n}")).alias(n) for n in sums), *(f"total_{n}" for n in sums))


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Dense position 1..n in a total order without a single-task sort: rows are
    range-partitioned, numbered inside partitions, and each partition's start
    follows from the partitions' counts (one row each)."""
    sorted_rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    numbered = sorted_rows.withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    counts = numbered.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return numbered.join(F.broadcast(starts), "_p").withColumn(name, F.col("_i") + F.col("_start") + 1).drop("_p", "_i", "_start")
