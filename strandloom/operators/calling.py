"""From per-position scores to loci: runs, gap merges, strands, hand-off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import sequence as S


def forward_bounds(region_lo: Column, region_hi: Column, strand: Column, start: Column, length: int) -> tuple[Column, Column]:
    """Forward coordinates of a window that starts ``start`` letters into a
    region; on the minus strand the region is read from its end (F09)."""
    lo = F.when(strand > 0, region_lo + start).otherwise(region_hi - start - (length - 1))
    return lo, lo + (length - 1)


def handoff(df: DataFrame, *, id_col: str, seq_col: str, start0: Column, length: Column, strands: str) -> DataFrame:
    """One row per locus and carried strand with its oriented RNA."""
    cut = F.substr(F.col(seq_col), start0 + 1, length)
    rows = df.select(id_col, cut.alias("dna"), F.explode(strands).alias("strand"))
    return rows.withColumn("rna", S.to_rna("dna", "strand"))


def call_coordinates(calls: DataFrame, *, window: str, start: str, end: str) -> DataFrame:
    """Half-open calls inside windows named ``contig:start`` as closed 0-based
    coordinates of the contig, with a candidate id (E33)."""
    parts = F.split(F.col(window), ":")
    base = parts[1].cast("long")
    rows = calls.select(parts[0].alias("contig_id"), (base + F.col(start)).alias("lo"), (base + F.col(end) - 1).alias("hi"))
    return rows.withColumn("candidate_id", F.concat("contig_id", F.lit(":"), F.col("lo").cast("string"), F.lit("-"), F.col("hi").cast("string")))


def runs(df: DataFrame, *, contig: str = "contig", pos: str = "pos", by: str | None = None, values: dict[str, Column] | None = None) -> DataFrame:
    """Maximal runs of consecutive positions (of one class) as half-open spans."""
    keys = [contig, *([by] if by else [])]
    w = Window.partitionBy(*keys).orderBy(pos)
    marked = df.withColumn("_g", F.col(pos) - F.row_number().over(w))
    aggs = [c.alias(k) for k, c in (values or {}).items()]
    return marked.groupBy(*keys, "_g").agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("end"), *aggs).drop("_g")


def merge_gaps(spans: DataFrame, *, contig: str = "contig", gap: int | Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Spans whose gap is at most ``gap`` united; ``island`` numbers them."""
    w = Window.partitionBy(contig, *keys).orderBy("start")
    gap = F.lit(gap) if isinstance(gap, int) else gap
    before = F.lag("end").over(w)
    new = (before.isNull() | (F.col("start") - before > gap)).cast("long")
    marked = spans.withColumn("_new", new)
    return marked.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def call_candidates(positions: DataFrame, *, threshold: int, gap: int, min_span: int, contig: str = "contig", pos: str = "pos", score: str = "p", cls: str = "cls", background: int = 0) -> DataFrame:
    """Candidates: runs of positions at or above the threshold, gap-merged, then
    filtered by span, with peak, mean over flagged positions, their number and
    the dominant class, the lowest on a tie (W03)."""
    flagged = positions.where((F.col(score) >= threshold) & (F.col(cls) != background))
    spans = merge_gaps(runs(flagged, contig=contig, pos=pos), contig=contig, gap=gap)
    per = spans.groupBy(contig, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).where(F.col("end") - F.col("start") >= min_span)
    # Flagged positions find their candidate by the gap rule again: same islands.
    w = Window.partitionBy(contig).orderBy(pos)
    before = F.lag(pos).over(w)
    own = flagged.withColumn("_new", (before.isNull() | (F.col(pos) - before - 1 > gap)).cast("long")).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    classes = own.groupBy(contig, "island", cls).agg(F.sum(score).alias("_s"), F.count(F.lit(1)).alias("_k"), F.max(score).alias("_m"))
    facts = classes.groupBy(contig, "island").agg(
        F.max("_m").alias("peak"), (F.sum("_s") / F.sum("_k")).alias("mean"), F.sum("_k").alias("n_flagged"), F.min_by(cls, F.struct(-F.col("_s"), cls)).alias("dominant"),
    )
    return per.join(facts, [contig, "island"]).drop("island")


def construct_loci(positions: DataFrame, *, threshold: int, gap: int, min_classes: int, flank: int, contig: str = "contig", pos: str = "pos", score: str = "p", cls: str = "cls", background: int = 0) -> DataFrame:
    """Loci of at least ``min_classes`` distinct classes over their core; flanks
    are added last, clipped to the contig with the shortfall noted, and overlaps
    of flanked neighbours are flagged (W04)."""
    length = positions.groupBy(contig).agg(F.max(pos).alias("_len"))
    flagged = positions.where((F.col(score) >= threshold) & (F.col(cls) != background))
    w = Window.partitionBy(contig).orderBy(pos)
    before = F.lag(pos).over(w)
    own = flagged.withColumn("_new", (before.isNull() | (F.col(pos) - before - 1 > gap)).cast("long")).withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    core = own.groupBy(contig, "_i").agg(F.min(pos).alias("core_start"), (F.max(pos) + 1).alias("core_end"), F.count_distinct(cls).alias("n_classes")).where(F.col("n_classes") >= min_classes)
    out = core.join(length, contig)
    start, end = F.greatest(F.col("core_start") - flank, F.lit(1)), F.least(F.col("core_end") + flank, F.col("_len") + 1)
    out = out.withColumn("start", start).withColumn("end", end).withColumn("shortfall", 2 * flank - (F.col("core_start") - F.col("start")) - (F.col("end") - F.col("core_end")))
    v = Window.partitionBy(contig).orderBy("core_start")
    touch = F.coalesce(F.lag("end").over(v) > F.col("start"), F.lit(False)) | F.coalesce(F.lead("start").over(v) < F.col("end"), F.lit(False))
    return out.withColumn("neighbour_overlap", touch).drop("_i", "_len")


def resolve_strand(elements: DataFrame, *, rank: dict[int, int], margin: int, locus: str = "locus", cls: str = "cls", pos: str = "pos") -> DataFrame:
    """Strand by vote: every pair of classes in a locus, by median position, is
    in canonical order or against it; a margin decides, else both strands are
    carried (W05)."""
    m = F.create_map(*[x for k, v in rank.items() for x in (F.lit(k), F.lit(v))])
    med = elements.groupBy(locus, cls).agg(F.percentile(pos, F.lit(0.5)).alias("_med")).withColumn("_r", m[F.col(cls)])
    both = med.alias("a").join(med.alias("b"), (F.col(f"a.{locus}") == F.col(f"b.{locus}")) & (F.col("a._r") < F.col("b._r")))
    votes = both.groupBy(F.col(f"a.{locus}").alias(locus)).agg(F.count_if(F.col("a._med") < F.col("b._med")).alias("concordant"), F.count_if(F.col("a._med") > F.col("b._med")).alias("discordant"))
    every = med.select(locus).distinct().join(votes, locus, "left").na.fill(0, ["concordant", "discordant"])
    diff = F.col("concordant") - F.col("discordant")
    reason = F.when(F.col("concordant") + F.col("discordant") == 0, "no_pairs").when(F.abs(diff) < margin, "margin").otherwise("resolved")
    strands = F.when(reason != "resolved", F.array(F.lit(1), F.lit(-1))).when(diff > 0, F.array(F.lit(1))).otherwise(F.array(F.lit(-1)))
    return every.select(locus, "concordant", "discordant", reason.alias("reason"), strands.alias("strands"))


def reconcile_windows(logits: DataFrame, *, contig: str = "contig", pos: str = "pos") -> DataFrame:
    """Log of the mean probability over covering windows and its arg-max class,
    the lowest on a tie. Input rows hold the window's ``logits`` array at a
    position; the soft-max runs inside each window first (W06)."""
    top = F.array_max("logits")
    e = F.transform("logits", lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    rows = logits.select(contig, pos, F.posexplode(F.transform(e, lambda x: x / total)).alias("cls", "p"))
    mean = rows.groupBy(contig, pos, "cls").agg(F.avg("p").alias("p"), F.count(F.lit(1)).alias("coverage"))
    return mean.groupBy(contig, pos).agg(F.max("coverage").alias("coverage"), F.min_by("cls", F.struct(-F.round("p", 12), "cls")).alias("cls"), F.sum("p").alias("p_total"), F.max(F.log("p")).alias("log_p"))


def density_surface(positions: DataFrame, *, thresholds: list[int], spans: list[int], gaps: list[int], contig: str = "contig", pos: str = "pos", score: str = "p") -> DataFrame:
    """Candidates per (threshold, min span, gap), runs found once per threshold
    and merged once per gap (A20)."""
    t = F.explode(F.array(*[F.lit(x) for x in thresholds]))
    flagged = positions.select(contig, pos, score).withColumn("threshold", t).where(F.col(score) >= F.col("threshold"))
    w = Window.partitionBy(contig, "threshold").orderBy(pos)
    r = flagged.withColumn("_g", F.col(pos) - F.row_number().over(w)).groupBy(contig, "threshold", "_g").agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("end"))
    g = r.withColumn("gap", F.explode(F.array(*[F.lit(x) for x in gaps])))
    merged = merge_gaps(g, contig=contig, gap=F.col("gap"), keys=("threshold", "gap")).groupBy(contig, "threshold", "gap", "island").agg((F.max("end") - F.min("start")).alias("span"))
    each = merged.withColumn("min_span", F.explode(F.array(*[F.lit(x) for x in spans])))
    return each.groupBy("threshold", "min_span", "gap").agg(F.count_if(F.col("span") >= F.col("min_span")).alias("n"))
