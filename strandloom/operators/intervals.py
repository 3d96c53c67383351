"""Interval operators: merging, masking, matching, overlap joins.

A range condition alone would be a nested-loop join, so every join here has an
equality on accession and position bin; a long interval appears in each bin it
touches, and a pair counts in one bin only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.loci import hash_draw

BIN = 4096


def merge_intervals(df: DataFrame, *, key: str = "acc", lo: str = "lo", hi: str = "hi", adjacent: bool = True) -> DataFrame:
    """Closed intervals that overlap (or touch) united, per key."""
    w = Window.partitionBy(key).orderBy(lo, hi)
    before = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (before.isNull() | (F.col(lo) > before + (1 if adjacent else 0))).cast("long")
    marked = df.select(key, lo, hi, new.alias("_new"))
    island = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(key, "_island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.count(F.lit(1)).alias("n")).drop("_island")


def _bins(lo: Column, hi: Column, size: int) -> Column:
    return F.explode(F.sequence(F.floor(lo / size), F.floor(hi / size)))


def overlap_join(left: DataFrame, right: DataFrame, *, key: str = "acc", lo: str = "lo", hi: str = "hi", flank: int = 0, bin_size: int = BIN) -> DataFrame:
    """Pairs of overlapping closed intervals; right columns get the prefix ``r_``.
    The pair is taken in the bin of the later start (J21)."""
    a = left.withColumn("_bin", _bins(F.col(lo) - flank, F.col(hi) + flank, bin_size))
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).withColumn("_rbin", _bins(F.col(f"r_{lo}"), F.col(f"r_{hi}"), bin_size))
    meet = (F.col(key) == F.col(f"r_{key}")) & (F.col("_bin") == F.col("_rbin"))
    first = F.floor(F.greatest(F.col(lo) - flank, F.col(f"r_{lo}")) / bin_size)
    near = (F.col(lo) - flank <= F.col(f"r_{hi}")) & (F.col(f"r_{lo}") <= F.col(hi) + flank) & (F.col("_bin") == first)
    return a.join(b, meet & near).drop("_bin", "_rbin")


def masked_ids(candidates: DataFrame, known: DataFrame, *, flank: int, id_col: str = "locus_id", key: str = "acc", lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Ids of candidates within ``flank`` of a known interval (J01). A candidate
    without accession is never masked."""
    merged = merge_intervals(known, key=key, lo=lo, hi=hi)
    return overlap_join(candidates, merged.drop("n"), key=key, lo=lo, hi=hi, flank=flank).select(id_col).distinct()


def exact_ids(candidates: DataFrame, known: DataFrame, *, id_col: str = "locus_id", on: tuple[str, ...] = ("acc", "lo", "hi")) -> DataFrame:
    """Ids of candidates equal to an interval as it was before merging."""
    return candidates.join(known.select(*on).distinct(), list(on), "left_semi").select(id_col).distinct()


def mask_report(candidates: DataFrame, known: DataFrame, *, flank: int, by: str) -> DataFrame:
    """Per group: candidates, masked at the flank, truly overlapping, exact."""
    merged = merge_intervals(known).drop("n")
    pairs = overlap_join(candidates.select("locus_id", "acc", "lo", "hi").distinct(), merged, flank=flank)
    touch = (F.col("lo") <= F.col("r_hi")) & (F.col("r_lo") <= F.col("hi"))
    hit = pairs.groupBy("locus_id").agg(F.bool_or(touch).alias("overlap")).withColumn("masked", F.lit(True))
    flags = candidates.join(hit, "locus_id", "left").join(exact_ids(candidates, known).withColumn("exact", F.lit(True)), "locus_id", "left")
    return flags.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(f"n_{c}") for c in ("masked", "overlap", "exact")])


def leakage_class(loci: DataFrame, corpus: DataFrame, *, id_col: str = "locus_id", key: str = "acc") -> DataFrame:
    """Whether a locus lies on a host of the corpus and overlaps it there."""
    hit = overlap_join(loci.dropna(subset=["lo", "hi", key]), corpus, key=key).select(id_col).distinct().withColumn("_hit", F.lit(True))
    hosts = corpus.select(key).distinct().withColumn("_host", F.lit(True))
    cls = F.when(F.col("lo").isNull() | F.col("hi").isNull(), "no_coordinates").when(F.col("_hit"), "overlap").when(F.col("_host"), "host_only").otherwise("independent")
    return loci.join(hosts, key, "left").join(hit, id_col, "left").withColumn("leakage", cls).drop("_hit", "_host")


def best_overlap(spans: DataFrame, annotated: DataFrame, *, id_col: str, right_id: str, key: str = "acc") -> DataFrame:
    """Each span's annotated locus of largest IoU with the intersection length;
    spans without one keep nulls (J21)."""
    inter = F.least("hi", "r_hi") - F.greatest("lo", "r_lo") + 1
    union = F.greatest("hi", "r_hi") - F.least("lo", "r_lo") + 1
    pairs = overlap_join(spans, annotated, key=key).select(id_col, F.col(f"r_{right_id}").alias(right_id), inter.alias("inter"), (inter / union).alias("iou"))
    best = pairs.groupBy(id_col).agg(F.max_by(F.struct(right_id, "inter", "iou"), F.struct("iou", "inter", right_id)).alias("b"))
    return spans.select(id_col).join(best, id_col, "left").select(id_col, f"b.{right_id}", "b.inter", "b.iou")


def control_windows(loci: DataFrame, hosts: DataFrame, known: DataFrame, *, id_col: str, seed: str, acc: str = "acc", length: str = "len") -> DataFrame:
    """One window of each locus's length at a hash-drawn place of its host, without
    those that touch a known interval (W14). Hosts have one row of ``acc, len``; a
    host shorter than the locus gives none."""
    span = F.col("hi") - F.col("lo")
    c = loci.select(id_col, acc, span.alias("_span")).distinct().join(hosts.select(acc, length), acc).where(F.col(length) > F.col("_span"))
    lo = hash_draw(seed, F.col(id_col)) % (F.col(length) - F.col("_span")) + 1
    drawn = c.withColumn("lo", lo).withColumn("hi", F.col("lo") + F.col("_span")).select(id_col, acc, "lo", "hi")
    return drawn.join(masked_ids(drawn, known, flank=0, id_col=id_col), id_col, "left_anti").select(id_col, acc, "lo", "hi")
