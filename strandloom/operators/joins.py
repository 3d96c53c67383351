"""Joins that must not lose, repeat or miss rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def strict_join(base: DataFrame, others: list[DataFrame], key: str) -> DataFrame:
    """Inner join on a key that is unique everywhere and that every table holds
    (J05). A repeated key or a missing partner raises while the join runs."""
    fail = lambda text: F.raise_error(F.lit(text)).cast("boolean")
    unique = lambda df: df.groupBy(key).agg(*[F.any_value(c).alias(c) for c in df.columns if c != key], F.count(F.lit(1)).alias("_n")).where(F.when(F.col("_n") == 1, True).otherwise(fail("repeated key"))).drop("_n")
    out = unique(base)
    for i, o in enumerate(others):
        out = out.join(unique(o).withColumn(f"_has{i}", F.lit(True)), key, "left").where(F.when(F.col(f"_has{i}"), True).otherwise(fail("lost row"))).drop(f"_has{i}")
    return out


def lookup_or_fail(rows: DataFrame, values: DataFrame, key: str, value: str) -> DataFrame:
    """Left join whose misses are errors."""
    j = rows.join(values.select(key, value), key, "left")
    return j.where(F.when(F.col(value).isNotNull(), True).otherwise(F.raise_error(F.lit("no value for a key")).cast("boolean")))


def item_scores(items: DataFrame, rows: DataFrame, *, uncalled: float) -> DataFrame:
    """Best score per item and its rows; rows of unknown items are left out and
    ``stray_items`` lists them (J15)."""
    best = rows.groupBy("item").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n_rows"))
    return items.join(best, "item", "left").select("item", F.coalesce("score", F.lit(uncalled)).alias("score"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def stray_items(items: DataFrame, rows: DataFrame) -> DataFrame:
    return rows.select("item").distinct().join(items.select("item"), "item", "left_anti")
