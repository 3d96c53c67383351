"""Quality rules with a hashed n-gram log-likelihood ratio (DataFrame functions only).

Two multinomials over hashed word 1- and 2-grams are counted: one over a trusted
target, one over the raw corpus. A document's score is the sum of
``ln p_target - ln p_raw`` over its n-grams divided by their number, and every
document is held against one threshold, the cut that best parts the trusted from
documents labelled as junk; nothing is drawn at random.

Both count vectors have ``n_buckets`` entries whatever the corpus, so they are
collected and go back to the tasks as one literal; scoring is a narrow pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.session import cut, table

SPACES = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
N_BUCKETS = 8192
#: Trusted ids that are broadcast at most: some 40 MB in each executor.
MAX_BROADCAST = 1_000_000
#: Threshold where no junk is labelled.
THRESHOLD = -0.15
#: Scores are counted in bins of this width to find the threshold, within +-SPAN bins.
BIN, SPAN = 0.001, 4000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def chained(shorter: Column, ids: Column, n: int) -> Column:
    """Hashes of n-grams from those of (n-1)-grams and of the words."""
    m = F.greatest(F.size(ids) - (n - 1), F.lit(0))
    return F.zip_with(F.slice(shorter, 1, m), F.slice(ids, n, m), lambda a, b: F.xxhash64(a, b))


def bucket_counts(rows: DataFrame, n_buckets: int) -> tuple[list[int], list[int]]:
    """``(target, raw)`` counts per bucket from rows of ``words, trusted``; the
    result has at most ``n_buckets`` rows and is summed on the map side first."""
    hashed = rows.select("trusted", F.transform("words", lambda w: F.xxhash64(w)).alias("ids"))
    grams = hashed.select("trusted", F.explode(F.concat("ids", chained(F.col("ids"), F.col("ids"), 2))).alias("h"))
    got = (
        grams.groupBy(F.pmod("h", F.lit(n_buckets)).alias("b"))
        .agg(F.count(F.lit(1)).alias("raw"), F.count("trusted").alias("target")).collect()
    )
    target, raw = [0] * n_buckets, [0] * n_buckets
    for r in got:
        target[r["b"]], raw[r["b"]] = r["target"], r["raw"]
    return target, raw


def log_ratios(target: list[int], raw: list[int]) -> list[float]:
    """Add-one smoothed ``ln p_target - ln p_raw`` for every bucket."""
    n = len(raw)
    t, r = math.log(sum(target) + n), math.log(sum(raw) + n)
    return [(math.log(a + 1) - t) - (math.log(b + 1) - r) for a, b in zip(target, raw, strict=True)]


#: Windows up to which a sort holds their positions beside 49 bits of their hashes.
PACKED = 1 << 15


def repeated_places(windows: Column) -> Column:
    """``(i, j)`` for neighbours of one hash in the order of hash and position, null if
    no hash occurs twice. Up to ``PACKED`` windows are sorted as plain integers, 49
    bits of the hash above the position, and the whole hashes of neighbours are
    compared: should any two differ, ``j`` is -1."""
    n = F.size(windows)
    packed = F.sort_array(F.transform(windows, lambda h, i: F.shiftleft(h, 15).bitwiseOR(i)))
    place = lambda a: a.bitwiseAND(F.lit((1 << 15) - 1)).cast("int")
    whole = lambda a: F.get(windows, place(a))
    pair = lambda a, b: F.when(F.shiftrightunsigned(a.bitwiseXOR(b), 15) == 0, F.struct(place(a).alias("i"), F.when(whole(a) == whole(b), place(b)).otherwise(-1).alias("j")))
    few = F.array_compact(F.zip_with(F.slice(packed, 1, n - 1), F.slice(packed, 2, n - 1), pair))
    return F.when(F.size(F.array_distinct(windows)) < n, F.when(n <= PACKED, few).otherwise(sorted_places(windows)))


def sorted_places(windows: Column) -> Column:
    """The same from a sort by whole hashes, for any number of windows."""
    n = F.size(windows)
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.array_compact(F.zip_with(F.slice(pairs, 1, n - 1), F.slice(pairs, 2, n - 1), lambda a, b: F.when(a["h"] == b["h"], F.struct(a["i"].alias("i"), b["i"].alias("j")))))


def repeated_words(windows: Column, places: Column) -> Column:
    """Words in windows whose 64-bit hash occurs twice or more in the array, from
    ``repeated_places``: each position covers three words."""
    def covered(pairs: Column) -> Column:
        at = F.array_union(F.transform(pairs, lambda p: p["i"]), F.transform(pairs, lambda p: p["j"]))
        step = lambda k: F.transform(at, lambda i: i + k)
        return F.size(F.array_union(F.array_union(at, step(1)), step(2)))

    mixed = F.exists(places, lambda p: p["j"] < 0)
    return F.when(places.isNull(), 0).when(mixed, covered(sorted_places(windows))).otherwise(covered(places)).cast("long")


def best_cut(counts: dict[int, tuple[int, int]]) -> float | None:
    """The cut with the smallest sum of the share of trusted scores below it and
    the share of junk scores not below it, from ``bin: (trusted, junk)``; none
    without both. The lowest of equals is taken: trusted scores lie a little high,
    because their own n-grams are in the target."""
    t_all, j_all = (sum(c[i] for c in counts.values()) for i in (0, 1))
    if not t_all or not j_all:
        return None
    best, at, below, above = t_all * j_all, min(counts), 0, j_all
    for b in sorted(counts):
        t, j = counts[b]
        below, above = below + t, above - j
        if below * j_all + above * t_all < best:
            best, at = below * j_all + above * t_all, b + 1
    return at * BIN


def label_cut(scored: DataFrame, trusted: DataFrame, junk: DataFrame) -> float | None:
    """``best_cut`` over the labelled rows of ``doc_id, llr, base_failed`` that pass
    the fixed rules, from one aggregate of at most ``2 * SPAN + 1`` rows."""
    labels = trusted.withColumn("t", F.lit(1)).withColumn("j", F.lit(0)).unionByName(junk.withColumn("t", F.lit(0)).withColumn("j", F.lit(1)))
    found = scored.where(~F.col("base_failed")).select("doc_id", "llr").join(labels.hint("merge"), "doc_id")
    at = F.greatest(F.lit(-SPAN), F.least(F.lit(SPAN), F.floor(F.col("llr") / BIN)))
    got = found.groupBy(at.alias("b")).agg(F.sum("t").alias("t"), F.sum("j").alias("j")).collect()
    return best_cut({r["b"]: (r["t"], r["j"]) for r in got})


def quality_rules(
    docs: DataFrame, trusted: DataFrame, *, junk: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
    n_buckets: int = N_BUCKETS, threshold: float = THRESHOLD, min_words: int = 50, max_repeat_percent: int = 50,
) -> DataFrame:
    """One row per input row: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, llr, kept``.

    ``trusted`` lists the ids of the target documents (its first column); repeats
    and nulls in it are ignored. With no trusted text every ratio is near zero
    and the fixed rules decide. ``junk`` lists ids of documents known to be bad in the
    same way and sets the threshold by ``best_cut``; ``threshold`` holds where it is
    absent or either side has no document that passes the fixed rules. A null text has no words (and so fails the length
    rule); repeated rows are counted and returned as often as they occur; other
    columns are ignored; an empty table gives an empty result. Windows are told
    apart by 64-bit hashes within one document.
    """
    listed = lambda x: x.select(F.col(x.columns[0]).alias("doc_id")).dropna().distinct()
    ids = listed(trusted).withColumn("trusted", F.lit(True))
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # Ids are broadcast only if they are counted to be few enough; else texts are shuffled to meet them.
    beside = F.broadcast(ids) if ids.count() <= MAX_BROADCAST else ids.hint("merge")
    marked = docs.join(beside, "doc_id", "left").select("trusted", words_of(F.col("text")).alias("words"))
    table_text = ",".join(repr(x) for x in log_ratios(*bucket_counts(marked, n_buckets)))
    ratios = F.split(F.lit(table_text), ",").cast("array<double>")

    named = docs.select("doc_id", "text", words_of(F.col("text")).alias("words"))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(NOT_SPACE))
    parts = named.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count("text", F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols"), lines.alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("ids"),
    )
    parts = parts.withColumn("two", chained(F.col("ids"), F.col("ids"), 2))
    parts = parts.withColumn("windows", chained(F.col("two"), F.col("ids"), 3))
    parts = parts.withColumn("places", repeated_places(F.col("windows")))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, h: a + F.get(ratios, F.pmod(h, F.lit(n_buckets)).cast("int")))
    llr = (total("ids") + total("two")) / F.greatest(F.size("ids") + F.size("two"), F.lit(1))
    scored = parts.select(
        "doc_id", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("windows"), F.col("places")).alias("n_repeat_words"), llr.alias("llr"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    results = scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "llr",
    )
    if junk is not None:
        results = cut(results)  # scores are few bytes a row and are read twice
        found = label_cut(results, listed(trusted), listed(junk))
        threshold = threshold if found is None else found
    return results.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids labelled good and not toxic, the trusted target."""
    return labels.where("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id")


def junk_ids(labels: DataFrame) -> DataFrame:
    """Ids labelled as bad."""
    return labels.where("quality = 0").select("doc_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return quality_rules(table(spark, sf_dir, "documents"), trusted_ids(labels), junk=junk_ids(labels))
