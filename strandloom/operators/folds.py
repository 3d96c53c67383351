"""Folds by the largest deficit: an ordered, stateful assignment in range partitions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.session import cut


def cluster_strata(df: DataFrame, *, cluster: str, stratum: str) -> DataFrame:
    """``cluster, stratum, n``: records of each cluster and its most frequent stratum, the
    smaller name on ties; null and empty strata don't count, and a cluster without
    any has ``''``. Rows without a cluster are left out."""
    named = F.when(F.col(stratum) != "", F.col(stratum))
    per = df.where(F.col(cluster).isNotNull()).groupBy(F.col(cluster).alias("cluster"), named.alias("_s")).agg(F.count(F.lit(1)).alias("_k"))
    own = F.min_by("_s", F.when(F.col("_s").isNotNull(), F.struct(-F.col("_k"), "_s")))
    return per.groupBy("cluster").agg(F.coalesce(own, F.lit("")).alias("stratum"), F.sum("_k").alias("n"))


def _deal(sizes: list[int], counts: list[int], ratios: list[float]) -> list[int]:
    """The fold of each size in turn: the one whose share would stay furthest below its
    ratio, the first on ties. ``counts`` is brought up to date."""
    out, total, folds = [], sum(counts), range(len(ratios))
    for n in sizes:
        total += n
        f = max(folds, key=lambda f: ratios[f] - (counts[f] + n) / total)
        counts[f] += n
        out.append(f)
    return out


def deficit_folds(df: DataFrame, *, cluster: str, stratum: str, ratios: dict[str, float], seed: str) -> DataFrame:
    """``cluster, stratum, n, fold``: whole clusters in order of stratum and, inside, of a
    seeded hash, each to the fold whose share of records so far is furthest below its
    ratio (C05). An empty table gives no rows.

    What a cluster gets depends on all before it, but only through the records of each
    fold. So clusters are range-partitioned in that order and every partition is dealt at
    once, from the counts that its predecessors would have if they met the ratios; then
    those partitions whose start is not their predecessor's end are dealt again, until
    none is left. That is the result of the loop over all clusters, for any data: after
    round ``i`` the first ``i`` partitions are right. Two starts mostly lead to one end
    within a partition, as deficits are made up, so few rounds are needed. The driver
    holds one row of counts a partition."""
    names, share = list(ratios), [float(x) for x in ratios.values()]
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("stratum"), F.lit(":"), F.col("cluster").cast("string")))
    totals = cluster_strata(df, cluster=cluster, stratum=stratum).withColumn("_h", order)
    by = ["stratum", "_h", "cluster"]
    parts = cut(totals.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()))
    sums = sorted((r["_part"], r["s"]) for r in parts.groupBy("_part").agg(F.sum("n").alias("s")).collect())
    start, before = {}, 0
    for part, s in sums:
        guess = [int(before * x) for x in share]
        guess[0] += before - sum(guess)
        start[part], before = tuple(guess), before + s

    def dealt(rows: DataFrame, start: dict, only_ends: bool) -> DataFrame:
        ends = T.StructType([T.StructField("_part", T.IntegerType()), T.StructField("counts", T.ArrayType(T.LongType()))])
        full = T.StructType([*rows.drop("_h", "_part").schema.fields, T.StructField("fold", T.StringType())])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            counts, part = None, None
            for batch in batches:
                if not len(batch):
                    continue
                if counts is None:
                    part = int(batch["_part"].iloc[0])
                    counts = list(start[part])
                folds = _deal(batch["n"].tolist(), counts, share)
                if not only_ends:
                    yield batch.drop(columns=["_h", "_part"]).assign(fold=[names[f] for f in folds])
            if only_ends and counts is not None:
                yield pd.DataFrame({"_part": [part], "counts": [counts]})

        return rows.mapInPandas(run, ends if only_ends else full)

    stale, ends = [p for p, _ in sums], {}
    while stale:
        ends |= {r["_part"]: tuple(r["counts"]) for r in dealt(parts.where(F.col("_part").isin(stale)), start, True).collect()}
        true_start = {b: ends[a] for (a, _), (b, _) in zip(sums, sums[1:], strict=False)}
        stale = [p for p, s in true_start.items() if s != start[p]]
        start |= true_start
    return dealt(parts, start, False).withColumnRenamed("cluster", cluster).withColumnRenamed("stratum", stratum)
