"""Deterministic selection: top-k, stratified draws, whole-cluster carves, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows of each group in a total order (K02); the planner limits
    each task to ``k`` rows a group before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def reservoir(df: DataFrame, id_col: str, *, head: int, k: int, seed: str) -> DataFrame:
    """``k`` rows by hash order among ids below ``head``."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    return df.where(F.col(id_col) < head).orderBy(h, id_col).limit(k)


def table_digest(hashes: DataFrame, *, by: list[str] | None = None, digits: int = 4) -> DataFrame:
    """Digest of a table of row hashes ``h`` that ignores order, one per group
    ``by`` (E01): sorted hashes per bucket of their first ``digits`` digits, then the
    digests of up to 256 buckets at a time, two digits less at each level. A bucket
    holds rows / 16**digits hashes; two more digits divide it by 256."""
    by = by or []
    join = lambda c: F.sha2(F.array_join(c, "\n"), 256)
    level = hashes.groupBy(*by, F.substring("h", 1, digits).alias("b")).agg(F.count(F.lit(1)).alias("n"), join(F.array_sort(F.collect_list("h"))).alias("h"))
    for left in range(digits - 2, -1, -2):
        pairs = F.array_sort(F.collect_list(F.struct("b", "h")))
        level = level.groupBy(*by, F.substring("b", 1, left).alias("c")).agg(join(F.transform(pairs, lambda x: x["h"])).alias("h"), F.sum("n").alias("n")).withColumnRenamed("c", "b")
    return level.select(*by, F.col("h").alias("digest"), "n")


def stratified_round_robin(df: DataFrame, *, stratum: str, id_col: str, n: int, cap: int, seed: str) -> DataFrame:
    """One per stratum and pass, strata by size then name, seeded order inside,
    at most ``cap`` of each (W07)."""
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_size"))
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    ranked = df.withColumn("_pass", F.row_number().over(Window.partitionBy(stratum).orderBy(h, id_col))).where(F.col("_pass") <= cap)
    return ranked.join(sizes, stratum).orderBy("_pass", F.desc("_size"), stratum).limit(n).drop("_size").withColumnRenamed("_pass", "pass")


def heldout_units(counts: DataFrame, *, unit: str, n: str, floor: float, minimum: int) -> DataFrame:
    """Units in order of size are reserved for training until their cumulative
    share reaches ``floor``; of the rest those of ``minimum`` rows are held out (W08)."""
    w = Window.orderBy(F.desc(n), unit)
    before = F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(n).over(Window.partitionBy())
    role = F.when(before < F.lit(floor) * total, "reserved").when(F.col(n) >= minimum, "heldout").otherwise("train")
    return counts.select(unit, n, role.alias("role"))


def whole_cluster_carve(df: DataFrame, *, cluster: str, stratum: str, fraction: float, seed: str) -> DataFrame:
    """Clusters, in hash order inside their stratum, until a fraction of the
    stratum's records is held; clusters are never split (W09). A cluster's
    stratum is its most frequent, smaller name on ties."""
    per = df.groupBy(cluster, stratum).agg(F.count(F.lit(1)).alias("_k"))
    own = per.groupBy(cluster).agg(F.min_by(stratum, F.struct(-F.col("_k"), stratum)).alias(stratum), F.sum("_k").alias("n"))
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(cluster).cast("string")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(stratum).orderBy(h, cluster).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.partitionBy(stratum))
    return own.withColumn("held", before < F.lit(fraction) * total)


def cluster_representatives(df: DataFrame, *, cluster: str, unit: str, id_col: str) -> DataFrame:
    """One record per cluster, smallest id of the unit that fewest clusters can
    offer, rarest units first (W10; greedy, so coverage may be below the best
    matching)."""
    options = df.groupBy(cluster, unit).agg(F.min(id_col).alias(id_col))
    rarity = options.groupBy(unit).agg(F.count(F.lit(1)).alias("_offers"))
    return options.join(rarity, unit).groupBy(cluster).agg(F.min_by(F.struct(id_col, unit), F.struct("_offers", unit)).alias("r")).select(cluster, f"r.{id_col}", f"r.{unit}")


def random_folds(df: DataFrame, *, cluster: str, stratum: str, ratios: dict[str, float], seed: str) -> DataFrame:
    """Fold of each whole cluster by its cumulative share of records inside its
    stratum (C05). The stratum is the cluster's smallest value."""
    per = df.groupBy(cluster).agg(F.min(stratum).alias(stratum), F.count(F.lit(1)).alias("n"))
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(cluster).cast("string")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(stratum).orderBy(h, cluster).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.partitionBy(stratum))
    fold, edge = None, 0.0
    for name, share in ratios.items():
        edge += share
        cond = before < F.lit(round(edge, 9)) * total
        fold = F.when(cond, name) if fold is None else fold.when(cond, name)
    return per.withColumn("fold", fold.otherwise(name))
