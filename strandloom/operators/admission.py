"""Which rows take part, and reports of why others do not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.operators.selection import table_digest
from strandloom.operators.validation import first_reason

Rules = list[tuple[str, Column]]


def refusal_census(rows: DataFrame, rules: Rules, *, kept: str, by: list[str], name: str = "refusal") -> DataFrame:
    """Rows per group ``by`` and first rule that refuses them, ``kept`` if none does."""
    return rows.select(*by, first_reason(rules, kept).alias(name)).groupBy(*by, name).agg(F.count(F.lit(1)).alias("n"))


def assemble_pools(pools: dict[str, tuple[DataFrame, Rules]], *, kept: str = "kept") -> tuple[DataFrame, DataFrame]:
    """``(rows, census)`` of a data set put together from named pools of the same columns,
    each with its own rules (J06): every row carries its ``pool`` and ``refusal``, and the
    census counts both, refused rows included."""
    out = None
    for pool, (rows, rules) in pools.items():
        own = rows.withColumn("pool", F.lit(pool)).withColumn("refusal", first_reason(rules, kept))
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no pool is given")
    return out, out.groupBy("pool", "refusal").agg(F.count(F.lit(1)).alias("n"))


def heldout_carve(rows: DataFrame, rules: Rules, *, digest: str, kept: str = "query") -> DataFrame:
    """Rows with ``reason`` (F21): ``duplicate_digest`` where another row has the same content
    digest, then the first rule that holds, else ``kept``. A null digest equals none."""
    copies = rows.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(digest, F.lit(True).alias("_copy"))
    every = [("duplicate_digest", F.coalesce(F.col("_copy"), F.lit(False))), *rules]
    return rows.join(copies, digest, "left").withColumn("reason", first_reason(every, kept)).drop("_copy")


def checked_evidence(rows: DataFrame, *, status: str, posterior: str, at_least: float, words: tuple[str, ...] = ("passed", "failed", "unavailable")) -> DataFrame:
    """Evidence rows with ``derived``, whether the posterior reaches ``at_least`` (F22). A row
    whose status is no known word, whose posterior is outside 0 to 1 or not a number, or
    whose ``passed`` or ``failed`` is not what the posterior says is an error."""
    p, s = F.col(posterior), F.col(status)
    derived = p >= at_least
    sound = s.isin(*words) & (~s.isin("passed", "failed") | (p.between(0, 1) & ~F.isnan(p) & ((s == "passed") == derived)))
    message = F.concat(F.lit("evidence that does not hold together: "), F.coalesce(s, F.lit("null")), F.lit(" at "), F.coalesce(p.cast("string"), F.lit("null")))
    return rows.where(F.when(F.coalesce(sound, F.lit(False)), True).otherwise(F.raise_error(message).cast("boolean"))).withColumn("derived", derived)


def false_pass_rates(rows: DataFrame, *, arm: str, verdict: str) -> DataFrame:
    """``n, decided, passed, rate`` of each control arm (A27): the rate is over decided rows,
    null without any; a null verdict is undecided."""
    out = rows.groupBy(arm).agg(F.count(F.lit(1)).alias("n"), F.count(verdict).alias("decided"), F.count_if(verdict).alias("passed"))
    return out.withColumn("rate", F.try_divide("passed", "decided"))


def window_census(genomes: DataFrame, *, seq_col: str, by: list[str], window: int, stride: int) -> DataFrame:
    """Genomes and their windows per group (A25), from lengths alone."""
    n = S.n_windows(F.length(seq_col), window, stride)
    return genomes.groupBy(*by).agg(F.count(F.lit(1)).alias("genomes"), F.sum(n).alias("windows"))


def spared_causes(ruled: DataFrame, *, reason: str = "reason") -> DataFrame:
    """Spared candidates by cause (C09), of reasons joined by ``;``; one may have several."""
    return ruled.select(F.explode(F.split(reason, ";")).alias("cause")).where("cause <> ''").groupBy("cause").agg(F.count(F.lit(1)).alias("n"))


def threshold_sensitivity(rows: DataFrame, *, id_col: str, score: str, thresholds: list[float]) -> DataFrame:
    """Spared and mined rows at each threshold and a digest of every row's outcome (C09):
    equal digests mean that the threshold changed nothing."""
    each = rows.select(F.col(id_col).cast("string").alias("id"), F.col(score).alias("s"), F.explode(F.array(*(F.lit(t) for t in thresholds))).alias("threshold"))
    spared = F.col("s") >= F.col("threshold")
    outcomes = each.select("threshold", spared.alias("spared"), F.sha2(F.concat("id", F.when(spared, ":spared").otherwise(":mined")), 256).alias("h"))
    counts = outcomes.groupBy("threshold").agg(F.count_if("spared").alias("spared"), F.count_if(~F.coalesce("spared", F.lit(False))).alias("mined"))
    return counts.join(table_digest(outcomes, by=["threshold"]), "threshold").select("threshold", "spared", "mined", F.col("digest").alias("fingerprint"))
