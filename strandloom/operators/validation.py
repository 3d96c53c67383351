"""Gates, censuses and checks over whole tables.

Checks come as rows of figures; ``require`` turns a false figure into an error.
A rate over nothing is null, and a gate over nothing is false.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_gate(df: DataFrame, *, rows: int, columns: int) -> DataFrame:
    """Exact rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("long")).withColumn("ok", (F.col("n_rows") == rows) & (F.col("n_columns") == columns))


def require(check: DataFrame, message: str) -> None:
    """Raises unless ``ok`` holds in the check's only row."""
    if not check.select("ok").first()["ok"]:
        raise ValueError(message)


def outside_vocabulary(df: DataFrame, column: str, allowed: DataFrame) -> DataFrame:
    """Values outside the allowed set with their counts."""
    words = allowed.select(F.col(allowed.columns[0]).alias(column)).distinct()
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).join(words, column, "left_anti")


def first_reason(rules: list[tuple[str, Column]], otherwise: str = "admitted") -> Column:
    """Name of the first rule that holds; null conditions don't hold."""
    out = F.lit(otherwise)
    for name, rule in reversed(rules):
        out = F.when(F.coalesce(rule, F.lit(False)), name).otherwise(out)
    return out


def census(df: DataFrame, *by: str) -> DataFrame:
    """Rows per status and their share; null is a bucket of its own."""
    n = df.select(*[F.coalesce(F.col(b).cast("string"), F.lit("(missing)")).alias(b) for b in by]).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.try_divide("n", n.agg(F.sum("n")).scalar()))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys of more than one row, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def clauses(df: DataFrame, named: dict[str, Column], *by: str) -> DataFrame:
    """Whether each clause holds in all rows and there are rows; ``passed`` is
    their conjunction (F16)."""
    aggs = [(F.coalesce(F.bool_and(F.coalesce(c, F.lit(False))), F.lit(False))).alias(k) for k, c in named.items()]
    got = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *aggs) if by else df.agg(F.count(F.lit(1)).alias("n"), *aggs)
    return got.withColumn("passed", reduce(lambda a, b: a & b, [F.col(k) for k in named], F.col("n") > 0))


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys missing from either side (U02): exact cover means no rows."""
    left = a.select(key).distinct().withColumn("_a", F.lit(True))
    right = b.select(key).distinct().withColumn("_b", F.lit(True))
    side = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra")
    return left.join(right, key, "full").select(key, side.alias("side")).where("side IS NOT NULL")


def leak_report(splits: DataFrame) -> DataFrame:
    """Counts of leaks over a split table of ``record, cluster_id, genus, fold,
    heldout, nested_train, calib`` (F17); all must be zero."""
    per = splits.groupBy("cluster_id").agg(
        F.count_distinct("fold").alias("folds"), F.bool_or("nested_train").alias("any_train"), F.bool_or(F.expr("fold = 'test' AND nested_train")).alias("test_train"),
        F.min("calib").alias("c0"), F.max("calib").alias("c1"), F.bool_or("heldout").alias("any_held"),
    )
    a = per.agg(
        F.count_if(F.col("folds") > 1).alias("clusters_across_folds"), F.count_if(F.col("c0") != F.col("c1")).alias("clusters_across_calib"),
        F.count_if(F.col("any_train") & F.col("any_held")).alias("clusters_train_and_heldout"), F.count_if("test_train").alias("clusters_test_and_train"),
    )
    r = splits.agg(
        F.count_if(F.expr("calib AND fold <> 'train'")).alias("calib_outside_train"), F.count_if(F.expr("nested_train AND heldout")).alias("heldout_in_train"),
        F.count_if(F.expr("nested_train AND fold <> 'train'")).alias("train_outside_fold"), F.count_if(F.expr("fold IS NULL OR cluster_id IS NULL")).alias("unassigned"),
        (F.count(F.lit(1)) - F.count_distinct("record")).alias("repeated_records"), F.count_if(F.expr("fold NOT IN ('train', 'val', 'test')")).alias("unknown_folds"),
    )
    return a.join(r, F.lit(True))
