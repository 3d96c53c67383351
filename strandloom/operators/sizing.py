"""Sizing of a control draw: are its queries alike, can its records be placed, what can it reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.statistics import ks_statistic, wilson
from strandloom.session import cut


def span_matchedness(control: DataFrame, candidates: DataFrame, *, length: str) -> DataFrame:
    """One row (C06): whether control queries are as long as the candidates they stand for.

    Medians and quartiles of both, their ratio, the Kolmogorov-Smirnov distance, and how
    many controls lie within the candidates' range. Null lengths are left out. An empty
    side or a median that is not positive is an error: there is nothing to compare.
    """
    tagged = control.select(F.col(length).alias("length"), F.lit("control").alias("arm")).unionByName(candidates.select(F.col(length).alias("length"), F.lit("candidate").alias("arm"))).where("length IS NOT NULL")
    # Equal lengths are one row, so percentiles and ranges see distinct lengths only.
    sizes = cut(tagged.groupBy("arm", "length").agg(F.count(F.lit(1)).alias("n")))
    at = lambda q: F.percentile("length", F.lit(q), F.col("n"))
    ends = sizes.groupBy("arm").agg(F.sum("n").alias("n"), F.min("length").alias("lo"), at(0.25).alias("p25"), at(0.5).alias("median"), at(0.75).alias("p75"), F.max("length").alias("hi"))
    side = {r["arm"]: r for r in ends.collect()}  # two rows
    if set(side) != {"control", "candidate"}:
        raise ValueError("both populations are needed")
    if side["control"]["median"] <= 0 or side["candidate"]["median"] <= 0:
        raise ValueError("a median length is not positive")
    mine, other = (ends.where(F.col("arm") == a).drop("arm").select(*(F.col(c).alias(f"{a}_{c}") for c in ends.columns[1:])) for a in ("control", "candidate"))
    within = sizes.where((F.col("arm") == "control") & F.col("length").between(side["candidate"]["lo"], side["candidate"]["hi"])).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_inside"))
    out = mine.join(other, F.lit(True)).join(within, F.lit(True)).join(ks_statistic(tagged, "length", "arm", "control", "candidate", by=[]), F.lit(True))
    return out.select("*", (F.col("n_inside") / F.col("control_n")).alias("share_inside"), (F.col("control_median") / F.col("candidate_median")).alias("median_ratio"))


def substrate_overlap(records: DataFrame, candidates: DataFrame, searched: DataFrame, *, taxon: str, assembly: str) -> DataFrame:
    """One row (C06): how many control ``records`` come from a species that the searched
    genomes hold, which is the most that could be placed in them, and how many
    assemblies of the candidates are themselves searched, whose queries find themselves.
    ``searched`` has a taxon and an assembly a row; rows that repeat one count once, and
    nulls match nothing."""
    taxa, genomes = searched.select(taxon).dropna().distinct(), searched.select(assembly).dropna().distinct()
    named = records.where(F.col(taxon).isNotNull()).groupBy(taxon).agg(F.count(F.lit(1)).alias("n"))
    hit = named.join(taxa.withColumn("_hit", F.lit(True)), taxon, "left")
    met = lambda c: F.coalesce(F.sum(F.when(F.col("_hit"), c)), F.lit(0))
    counts = hit.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_with_taxon"), F.count(F.lit(1)).alias("n_taxa"), met(F.col("n")).alias("n_routable"), met(F.lit(1)).alias("n_taxa_searched"))
    own = candidates.select(assembly).dropna().distinct()
    selves = own.join(genomes.withColumn("_hit", F.lit(True)), assembly, "left").agg(F.count(F.lit(1)).alias("n_candidate_assemblies"), F.count("_hit").alias("n_self_hits"))
    sizes = records.agg(F.count(F.lit(1)).alias("n_records")).join(genomes.agg(F.count(F.lit(1)).alias("n_genomes")), F.lit(True)).join(taxa.agg(F.count(F.lit(1)).alias("n_searched_taxa")), F.lit(True))
    out = sizes.join(counts, F.lit(True)).join(selves, F.lit(True))
    return out.withColumn("share_routable", F.coalesce(F.try_divide("n_routable", "n_records"), F.lit(0.0)))


def draw_feasibility(records: DataFrame, *, stratum: str, cluster: str, draws: list[int]) -> DataFrame:
    """``k, strata, quota, strata_with_quota, clusters, one_per_cluster`` (C06): what an equal
    draw of ``k`` over the strata asks of each, how many have that many clusters (one at
    least), and whether ``k`` different clusters exist."""
    per = records.where(F.col(stratum).isNotNull()).groupBy(stratum).agg(F.count_distinct(cluster).alias("n"))
    n_strata, n_clusters = per.count(), records.agg(F.count_distinct(cluster)).scalar()
    rows = per.withColumn("k", F.explode(F.array(*(F.lit(k) for k in draws)))).withColumn("quota", F.floor(F.col("k") / F.lit(n_strata)))
    g = rows.groupBy("k", "quota").agg(F.count(F.lit(1)).alias("strata"), F.count_if(F.col("n") >= F.greatest(F.lit(1), F.col("quota"))).alias("strata_with_quota"))
    return g.withColumn("clusters", n_clusters).withColumn("one_per_cluster", F.col("k") <= F.col("clusters"))


def effective_power(spark, *, draws: list[int], shares: dict[str, float], at: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """``k, anchor, effective_n`` and the width of the Wilson interval at each share ``at``
    (C06), for draws of which only the anchor's share can be measured; null if none can."""
    grid = spark.createDataFrame([(k, a, float(s)) for k in draws for a, s in shares.items()], "k long, anchor string, share double")
    n = F.rint(F.col("k") * F.col("share")).cast("long")
    out = grid.select("k", "anchor", n.alias("effective_n"))
    for p in at:
        lo, hi = wilson(F.lit(p) * F.col("effective_n"), F.col("effective_n"))
        out = out.withColumn(f"width_at_{round(p * 100)}", hi - lo)
    return out
