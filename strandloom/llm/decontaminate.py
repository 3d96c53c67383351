"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over consecutive words; the words at its zeros are
ignored, so a seed still hits where such words were substituted. Hashes of all
masked windows of the benchmark are joined with those of the documents. Each hit
names a diagonal (position in the document minus position in the item); around
it all words of the item are compared with the document's words in place, and
the share of equal ones is the overlap. Substitutions lower the overlap by their
own words only. Diagonals close to each other are judged together as well, so an
inserted or missing word does not hide a passage.

A seed that many items hold, a common phrase, is lengthened by one more word of
the item, at any distance. An overlap that is long enough has a number of equal
words beside the common phrases, so at least one of the item's other words, all
but its most frequent ones, is among them: nothing is lost, and a document that
holds the phrase alone meets none of the items.

Documents are hashed in Arrow batches; a bitmap of fixed size over the
benchmark's hashes keeps all but a few of their windows from being shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.textbatch import mix, ragged_index, span_hashes, text_slices
from strandloom.session import cut, table

#: Fixed masks over words: 1 is compared, 0 ignored. Of items of 12 words or more with
#: half of their words or more equal at random places they hit nine in ten or more.
MASKS = ("1111", "11011", "101101", "1010101", "1100101", "1001011")
#: Items of this many words or more need two seeds on a diagonal to be compared.
LONG_ITEM = 24
#: A seed held by more items than this is common.
COMMON_ITEMS = 16
#: Diagonals up to so many words apart are judged together, three at a time.
NEAR_DIAGONALS = 8
#: Extended windows hashed at a time.
EXTENDED_AT_ONCE = 1_000_000
#: Bits of the bitmap over the benchmark's hashes, whatever their number.
BITMAP_BITS = 1 << 25
#: Diagonals to compare that are broadcast at most; beyond, texts are shuffled to meet them.
MAX_BROADCAST = 200_000
#: Bytes of text hashed at a time.
SLICE_BYTES = 1_000_000


@cache
def _word_table() -> np.ndarray:
    """Lower-cased word bytes, 0 for what separates words."""
    out = np.zeros(256, np.uint8)
    out[0x80:] = np.arange(0x80, 256)
    for a, b in ((48, 58), (97, 123)):
        out[a:b] = np.arange(a, b)
    out[65:91] = np.arange(97, 123)
    return out


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of letters, digits and non-ASCII bytes, A-Z
    lower-cased) and their number per text."""
    data = _word_table()[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    inside = np.concatenate([[False], data > 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return span_hashes(data, starts, ends), np.diff(np.append(0, np.searchsorted(starts, bounds)))


def seed_hashes(words: np.ndarray, counts: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``text, position, hash`` of every window under the mask."""
    n = np.maximum(counts - len(mask) + 1, 0)
    begins = np.cumsum(counts) - counts
    at = ragged_index(begins, n)
    text = np.repeat(np.arange(len(counts)), n)
    h = np.full(len(at), int(mask, 2) * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            h = (h ^ words[at + k]) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
    return text, at - begins[text], mix(h)


def _hashed(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, word hashes, words per row and a key of each row's words, by slices."""
    import xxhash

    for lo, texts in text_slices(batch.column(column), SLICE_BYTES):
        words, counts = word_hashes([t.encode("utf-8", "surrogatepass") for t in texts])
        ends = np.cumsum(counts)
        keys = [xxhash.xxh3_64_intdigest(words[e - n : e].tobytes()) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
        yield lo, words, counts, np.array(keys, np.uint64).view(np.int64)


def extended(seed: np.ndarray, distance: np.ndarray | int, word: np.ndarray) -> np.ndarray:
    """Hash of a seed and one more word at a distance from its first."""
    return mix(seed ^ mix(word + np.asarray(distance, np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def _held(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    b = h & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(b >> np.uint64(3)).astype(np.int64)] >> (b & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _seed_rows(masks: tuple[str, ...], bitmap: bytes | None = None, common: bytes | None = None, reach: tuple[int, int] = (0, -1)):
    """Rows ``id, key, mask, hash, pos, n_words`` of a table of ``id, text``; with a
    bitmap only windows it holds. Windows of the bitmap ``common`` are lengthened by each
    word within ``reach`` of their start, under the mask -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, often = (None if x is None else np.frombuffer(x, np.uint8) for x in (bitmap, common))

        def rows(batch: pa.RecordBatch, lo: int, keys: np.ndarray, counts: np.ndarray, m: int, text: np.ndarray, pos: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(text + lo)), pa.array(keys[text]), pa.array(np.full(len(h), m), pa.int32()), pa.array(h.view(np.int64)), pa.array(pos, pa.int64()), pa.array(counts[text], pa.int64())],
                names=["id", "key", "mask", "hash", "pos", "n_words"],
            )

        for batch in batches:
            for lo, words, counts, keys in _hashed(batch, 1):
                begins = np.cumsum(counts) - counts
                for m, mask in enumerate(masks):
                    text, pos, h = seed_hashes(words, counts, mask)
                    if often is not None:
                        many = np.flatnonzero(_held(often, h))
                        step = max(1, EXTENDED_AT_ONCE // (reach[1] - reach[0] + 1))
                        for a in range(0, len(many), step):
                            some = many[a : a + step]
                            low, high = np.maximum(reach[0], -pos[some]), np.minimum(reach[1], counts[text[some]] - pos[some] - 1)
                            n = np.maximum(high - low + 1, 0)
                            at, distance = np.repeat(some, n), ragged_index(low, n)
                            more = extended(h[at], distance, words[begins[text[at]] + pos[at] + distance])
                            met = _held(bits, more)
                            yield rows(batch, lo, keys, counts, -1, text[at[met]], pos[at[met]], more[met])
                    if bits is not None:
                        held = _held(bits, h)
                        text, pos, h = text[held], pos[held], h[held]
                    yield rows(batch, lo, keys, counts, m, text, pos, h)

    return run


def _lengthened(min_overlap: float, sizes: tuple[int, ...]):
    """From rows of ``id, key, text, seeds (mask, hash, pos), often (word, n)`` of items with
    common seeds, rows like those of ``_seed_rows``: the common seeds lengthened by
    the item's other words, or as they are where common words alone are overlap enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, words, counts, _ in _hashed(batch, 2):
                ends = np.cumsum(counts)
                out = []
                for i, (n, end) in enumerate(zip(counts.tolist(), ends.tolist(), strict=True)):
                    own = words[end - n : end]
                    seeds = batch.column(3)[lo + i].values
                    mask, h, pos = (seeds.field(c).to_numpy() for c in ("mask", "hash", "pos"))
                    shared = np.zeros(n, bool)
                    for m, p in zip(mask.tolist(), pos.tolist(), strict=True):
                        shared[p : p + sizes[m]] = True
                    rest = np.flatnonzero(~shared)
                    need = int(np.ceil(min_overlap * n - 1e-9)) - (n - len(rest))
                    if need <= 0:
                        out += [(i, m, x, p) for m, x, p in zip(mask.tolist(), h.tolist(), pos.tolist(), strict=True)]
                        continue
                    often = batch.column(4)[lo + i].values
                    times = dict(zip(often.field("word").to_pylist(), often.field("n").to_pylist(), strict=True))
                    rarest = rest[np.argsort([times[w] for w in own[rest].view(np.int64).tolist()], kind="stable")][: max(0, len(rest) - need + 1)]
                    for m, x, p in zip(mask.tolist(), h.tolist(), pos.tolist(), strict=True):
                        more = extended(np.full(len(rarest), np.int64(x).view(np.uint64)), rarest - p, own[rarest])
                        out += [(i, -1, y, p) for y in more.view(np.int64).tolist()]
                at = np.array([x[0] for x in out], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at + lo)), batch.column(1).take(pa.array(at + lo)), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.int64()), pa.array(counts[at], pa.int64())],
                    names=["id", "key", "mask", "hash", "pos", "n_words"],
                )

    return run


def _bitmap(hashes: DataFrame) -> bytes:
    """``BITMAP_BITS`` bits, set where a row's ``hash`` falls; at most a 32nd as many rows come back."""
    bit = F.col("hash").bitwiseAND(F.lit(BITMAP_BITS - 1))
    parts = hashes.groupBy(F.shiftright(bit, 5).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(31)).cast("int"))).alias("part"))
    out = np.zeros(BITMAP_BITS // 32, "<u4")
    for r in parts.toLocalIterator():
        out[r["at"]] = r["part"]
    return out.tobytes()


def _seed_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("id", id_type), T.StructField("key", T.LongType()), T.StructField("mask", T.IntegerType()), *(T.StructField(x, T.LongType()) for x in ("hash", "pos", "n_words"))])


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``item_key, words`` of each row of ``id, text``."""
    for batch in batches:
        for _, words, counts, keys in _hashed(batch, 1):
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(words.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(keys), lists], names=["item_key", "words"])


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows of ``id, text, doc_key, wanted``, the hashes of the words that lie on
    each wanted diagonal, one for each word of the item and null beyond the text's ends."""
    for batch in batches:
        for lo, words, counts, keys in _hashed(batch, 1):
            ends = np.cumsum(counts)
            for i in np.flatnonzero(keys == batch.column(2).slice(lo, len(keys)).to_numpy()).tolist():
                own, wanted = words[ends[i] - counts[i] : ends[i]].view(np.int64), batch.column(3)[lo + i].values
                n, diagonal = (wanted.field(c).to_numpy() for c in ("n_words", "diagonal"))
                for a in range(0, len(n), 1000):
                    at = np.repeat(diagonal[a : a + 1000], n[a : a + 1000]) + ragged_index(np.zeros(len(n[a : a + 1000]), np.int64), n[a : a + 1000])
                    inside = (at >= 0) & (at < len(own))
                    values = pa.array(own[np.where(inside, at, 0)], mask=~inside)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n[a : a + 1000])), pa.int32()), values)
                    some = wanted.slice(a, 1000)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(np.full(len(some), lo + i))), some.field("item_id"), some.field("item_key"), some.field("diagonal"), lists],
                        names=["doc_id", "item_id", "item_key", "diagonal", "found"],
                    )


def _wanted(d: DataFrame, b: DataFrame, masks: tuple[str, ...], n_spaced: int, min_overlap: float) -> DataFrame:
    """``doc_id, doc_key, item_id, item_key, n_words, diagonal`` to be compared word by word."""
    shortest = min(map(len, masks[:n_spaced]))
    id_type, item_type = d.schema["id"].dataType, b.schema["id"].dataType
    seeds = b.mapInArrow(_seed_rows(masks), _seed_schema(item_type))
    seeds = cut(seeds.where((F.col("mask") < n_spaced) | (F.col("n_words") < shortest)))
    often = seeds.groupBy("mask", "hash").agg(F.count_distinct("key").alias("n")).where(F.col("n") > COMMON_ITEMS).select("mask", "hash", F.lit(True).alias("common"))
    marked = cut(seeds.join(often, ["mask", "hash"], "left"))
    common, reach = None, (0, -1)
    tests = marked.where("common IS NULL").drop("common")
    if not marked.where("common").isEmpty():
        common = _bitmap(marked.where("common"))
        own = marked.where("common").groupBy("id", "key").agg(F.collect_set(F.struct("mask", "hash", "pos")).alias("seeds"))
        words = b.mapInArrow(_item_words, "item_key long, words array<long>").dropDuplicates(["item_key"]).select("item_key", F.explode(F.array_distinct("words")).alias("word"))
        times = words.join(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word")
        times = times.groupBy(F.col("item_key").alias("key")).agg(F.collect_list(F.struct("word", "n")).alias("often"))
        texts = b.mapInArrow(_item_keys, T.StructType([b.schema["id"], T.StructField("key", T.LongType()), T.StructField("text", T.StringType())])).dropDuplicates(["id", "key"])
        rows = texts.join(own, ["id", "key"]).join(times, "key").select("id", "key", "text", "seeds", "often")
        more = cut(rows.mapInArrow(_lengthened(min_overlap, tuple(map(len, masks))), _seed_schema(item_type)))
        # Distances that items have: each item's are within its own words.
        longest = more.agg(F.max("n_words")).first()[0] or 0
        tests, reach = tests.unionByName(more), (-longest, longest)
    hits = d.mapInArrow(_seed_rows(masks, _bitmap(tests), common, reach), _seed_schema(id_type)).select(F.col("id").alias("doc_id"), F.col("key").alias("doc_key"), "mask", "hash", "pos")
    items = tests.select(F.col("id").alias("item_id"), F.col("key").alias("item_key"), "mask", "hash", F.col("pos").alias("at"), "n_words").distinct()
    met = hits.join(items, ["mask", "hash"]).select("doc_id", "doc_key", "item_id", "item_key", "n_words", (F.col("pos") - F.col("at")).alias("diagonal"), "mask", "at")
    diagonals = met.groupBy("doc_id", "doc_key", "item_id", "item_key", "n_words", "diagonal").agg(F.count_distinct("mask", "at").alias("seeds"), F.min("mask").alias("mask"))
    return diagonals.where((F.col("n_words") < LONG_ITEM) | (F.col("seeds") > 1) | (F.col("mask") < 0))


def _item_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, key, text`` of each row of ``id, text``."""
    for batch in batches:
        for lo, _, _, keys in _hashed(batch, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(keys)), pa.array(keys), batch.column(1).slice(lo, len(keys))], names=["id", "key", "text"])


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, min_overlap: float = 0.5, masks: tuple[str, ...] = MASKS,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row per document and benchmark item that it holds: ``doc_id, item_id,
    n_equal, n_item_words, overlap, first_word``.

    ``overlap`` is the share of the item's words that are equal and in place on the
    best diagonal; ``min_overlap`` of it are needed; ``first_word`` is where that
    diagonal meets the item's start in the document (its own start at the least).
    Diagonals are those that seeds hit, twice for items of ``LONG_ITEM`` words or
    more. An inserted or missing word starts another diagonal; three that are at most
    ``NEAR_DIAGONALS`` apart count together where none is enough alone. Items shorter
    than the shortest mask are found by unmasked seeds of their own length, so whole
    or not at all; items without words never are. Seeds of more than ``COMMON_ITEMS``
    items are lengthened first, which loses no diagonal. Null texts have no words; rows with a null id are not reported; rows that repeat
    an id are reported once, with the best overlap of their texts; other columns are
    ignored; empty tables give an empty result.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    b = benchmark.select(F.col(item_col).alias("id"), F.col(item_text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    id_type, item_type, shortest = d.schema["id"].dataType, b.schema["id"].dataType, min(map(len, masks))
    # Short items: at most ``shortest - 1`` different lengths.
    lengths = b.select(F.size(F.array_remove(F.split(F.col("text"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")).alias("n"))
    short = sorted(r["n"] for r in lengths.where((F.col("n") > 0) & (F.col("n") < shortest)).distinct().collect())
    every = (*masks, *("1" * n for n in short))
    wanted = cut(_wanted(d, b, every, len(masks), min_overlap).groupBy(F.col("doc_id").alias("id"), "doc_key").agg(F.collect_list(F.struct("item_id", "item_key", "n_words", "diagonal")).alias("wanted")))
    n_wanted = wanted.agg(F.sum(F.size("wanted"))).first()[0] or 0
    beside = F.broadcast(wanted) if n_wanted <= MAX_BROADCAST else wanted.hint("merge")
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("item_id", item_type), T.StructField("item_key", T.LongType()), T.StructField("diagonal", T.LongType()), T.StructField("found", T.ArrayType(T.LongType()))])
    passages = d.join(beside, "id").select("id", "text", "doc_key", "wanted").mapInArrow(_passages, schema)
    words = b.mapInArrow(_item_words, "item_key long, words array<long>").dropDuplicates(["item_key"])
    n = F.size("words").cast("long")
    total = lambda *masks: F.size(F.filter(reduce(lambda x, y: F.zip_with(x, y, lambda p, q: p | q), masks), lambda e: e)).cast("long")
    compared = passages.join(words, "item_key").select("doc_id", "item_id", "item_key", "diagonal", n.alias("n_item_words"), F.zip_with("found", "words", lambda x, y: F.coalesce(x == y, F.lit(False))).alias("same"))
    # One by one, and with the next two if they are near.
    order = Window.partitionBy("doc_id", "item_id", "item_key").orderBy("diagonal")
    none = F.transform("same", lambda e: F.lit(False))
    near = [F.when(F.lead("diagonal", k).over(order) - F.col("diagonal") <= NEAR_DIAGONALS, F.lead("same", k).over(order)) for k in (1, 2)]
    compared = compared.select("*", *(x.alias(f"same{k}") for k, x in enumerate(near))).withColumn("n_alone", total(F.col("same")))
    joined = total(F.col("same"), F.coalesce("same0", none), F.coalesce("same1", none))
    enough = lambda x: x / F.col("n_item_words") >= min_overlap
    compared = compared.withColumn("n_equal", F.when(enough(F.col("n_alone")) | F.col("same0").isNull(), F.col("n_alone")).otherwise(joined))
    good = compared.where(enough(F.col("n_equal"))).select("doc_id", "item_id", "n_equal", "n_item_words", (F.col("n_equal") / F.col("n_item_words")).alias("overlap"), F.greatest("diagonal", F.lit(0).cast("long")).alias("first_word"), (F.col("n_alone") == F.col("n_equal")).alias("alone"))
    best = good.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("n_equal", "n_item_words", "overlap", "first_word"), F.struct("alone", "overlap", "n_equal", -F.col("first_word"))).alias("best"))
    return best.select("doc_id", "item_id", "best.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no benchmark item. Rows that share an id go together;
    rows with a null id are judged by their texts, each for itself."""
    def without(rows: DataFrame, key: str) -> DataFrame:
        found = contaminated(rows, benchmark, id_col=key, text_col=text_col, **options).select(F.col("doc_id").alias(key)).distinct()
        return rows.join(found, key, "left_anti").select(*docs.columns)

    digest = "digest of the text"
    nameless = docs.where(F.col(id_col).isNull()).withColumn(digest, F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    return without(docs.where(F.col(id_col).isNotNull()), id_col).unionByName(without(nameless, digest))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
