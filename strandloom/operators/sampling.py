"""Sampling weights and weighted draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.loci import hash_draw


def curriculum_weights(df: DataFrame, *, strata: list[str], alpha: float) -> DataFrame:
    """Product of inverse-frequency powers over strata, mean one; null is a
    stratum of its own (E09)."""
    out = df.withColumn("_w", F.lit(1.0))
    for i, s in enumerate(strata):
        key = F.coalesce(F.col(s), F.lit("UNKNOWN"))
        sizes = df.groupBy(key.alias(f"_k{i}")).agg(F.count(F.lit(1)).alias("_n"))
        out = out.withColumn(f"_k{i}", key).join(sizes, f"_k{i}").withColumn("_w", F.col("_w") * F.pow("_n", F.lit(-alpha))).drop("_n", f"_k{i}")
    return out.withColumn("weight", F.col("_w") / out.agg(F.avg("_w")).scalar()).drop("_w")


def weighted_draws(df: DataFrame, *, id_col: str, weight: str, draws: DataFrame, seed: str, rows_per_bin: int = 64, rows_per_part: int = 1_000_000) -> DataFrame:
    """One row of ``df`` per row of ``draws``, with replacement, in proportion to
    integer weights (E10). Rows get ranges of the running weight, in order of a hash
    part and the id; a draw is a hash below the total, and meets its row in one of
    equal bins, whose number follows from the rows, so that a draw is compared with
    about ``rows_per_bin`` of them."""
    n = df.count()
    bins, n_parts = max(1, -(-n // rows_per_bin)), max(16, -(-n // rows_per_part))
    # Running weights by parts: each part's own, behind the sums of earlier parts.
    parts = df.select(id_col, weight, (hash_draw("part", F.col(id_col)) % n_parts).alias("_p"))
    own = Window.partitionBy("_p").orderBy(id_col).rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("_p").agg(F.sum(weight).alias("_s"))
    before = sums.select("_p", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    rows = parts.withColumn("_own", F.coalesce(F.sum(weight).over(own), F.lit(0))).join(before, "_p").select(id_col, weight, (F.col("_start") + F.col("_own")).alias("_lo"))
    rows = rows.withColumn("_hi", F.col("_lo") + F.col(weight)).withColumn("_t", parts.agg(F.sum(weight)).scalar())
    size = F.greatest(F.lit(1), F.ceil(F.col("_t") / bins))
    spread = rows.where(F.col(weight) > 0).withColumn("_b", F.explode(F.sequence(F.floor(F.col("_lo") / size), F.floor((F.col("_hi") - 1) / size)))).select(id_col, "_lo", "_hi", "_b")
    d = draws.select(F.col(id_col).alias("draw")).withColumn("_t", parts.agg(F.sum(weight)).scalar()).withColumn("_x", hash_draw(seed, F.col("draw")) % F.col("_t")).withColumn("_b", F.floor(F.col("_x") / size))
    return d.join(spread, "_b").where((F.col("_x") >= F.col("_lo")) & (F.col("_x") < F.col("_hi"))).select("draw", id_col)


def mixed_draws(positives: DataFrame, negatives: DataFrame, *, id_col: str, weight: str, n: int, negative_share: float, seed: str) -> DataFrame:
    """``slot, kind, <id>`` for ``n`` draws with a fixed share of negatives, spread evenly
    over the slots (E10): positives in proportion to their weights, negatives alike,
    both with replacement. A side without rows gives no draw."""
    slots = positives.sparkSession.range(n).withColumnRenamed("id", "slot")
    share = F.lit(negative_share)
    negative = F.floor((F.col("slot") + 1) * share + 1e-9) > F.floor(F.col("slot") * share + 1e-9)
    out = []
    for kind, rows, mine in (("positive", positives, ~negative), ("negative", negatives.withColumn(weight, F.lit(1)), negative)):
        own = slots.where(mine).select(F.col("slot").alias(id_col))
        got = weighted_draws(rows.select(id_col, weight), id_col=id_col, weight=weight, draws=own, seed=f"{seed}:{kind}")
        out.append(got.select(F.col("draw").alias("slot"), F.lit(kind).alias("kind"), id_col))
    return out[0].unionByName(out[1])


def mix_summary(drawn: DataFrame, *, id_col: str) -> DataFrame:
    """Draws, distinct rows and share of each kind as realised."""
    g = drawn.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(id_col).alias("n_rows"))
    return g.withColumn("share", F.col("n") / g.agg(F.sum("n")).scalar())
