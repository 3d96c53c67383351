"""SimHash near-duplicates by multi-index hashing.

Fingerprints are cut into two segments of 32 bits. Two fingerprints that differ
in at most three bits differ in at most one bit of some segment, so each
fingerprint enumerates the ball of radius one around its segments and meets the
others in the buckets of those values. Only flips from 1 to 0 are enumerated:
of two segments that differ in one bit one has the bit set, so every pair still
meets. Full distances are verified inside buckets, and a bucket answers with a
spanning forest of its links, never with all pairs.

Distinct fingerprints are handled, so copies never multiply. Buckets with more
than ``hot`` fingerprints are cut again by balls of radius one in the halves of
the other segment, which keeps every link for the same reason.

Removal of near duplicates at a stated Jaccard similarity of five-word shingles
takes fingerprints as a filter only. More segments are needed at that distance,
and their balls hold flips of the least certain bits alone, those with the
closest votes, because that is where similar texts differ; the shingle sets of
each component of candidates are then compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.textbatch import mix, text_slices, texts_of
from strandloom.operators.cluster import connected_components
from strandloom.session import cut, table

#: Hashes whose bits are added up in one byte each.
PIECE = 255
#: Documents and bytes handled at a time.
BATCH_DOCS, BATCH_BYTES = 500, 2_000_000
HOT_BUCKET = 4096


def shingle_hashes(text: str, k: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of every k-word shingle (the whole sequence if shorter)."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII only
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([digest(b" ".join(words), seed)] if words else [], np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    ends = starts[k - 1 :] + sizes[k - 1 :]
    return np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts.tolist(), ends.tolist(), strict=False)), np.uint64, len(ends))


def votes_of(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many of each document's hashes have each of the 64 bits set: the bits
    of eight places are added in the bytes of one integer, ``PIECE`` hashes at a time."""
    votes = np.zeros((len(counts), 64), np.int32)
    some = np.flatnonzero(counts)
    if not len(some):
        return votes
    n_pieces = -(-counts[some] // PIECE)
    first = np.cumsum(n_pieces) - n_pieces
    begins = np.cumsum(counts) - counts
    at = np.repeat(begins[some], n_pieces) + (np.arange(n_pieces.sum()) - np.repeat(first, n_pieces)) * PIECE
    for k in range(8):
        spread = (hashes >> np.uint64(k)) & np.uint64(0x0101010101010101)
        sums = np.add.reduceat(spread, at).astype("<u8").view(np.uint8).reshape(-1, 8)
        votes[some, k::8] = np.add.reduceat(sums, first, axis=0, dtype=np.int32)
    return votes


def fingerprints_of(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Majority of every bit over each document's hashes; none gives zero."""
    return np.packbits(2 * votes_of(hashes, counts) > counts[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(docs: DataFrame, *, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: the 64 bits as a signed long, one row per input row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in text_slices(batch.column(1), BATCH_BYTES, BATCH_DOCS):
                lists = [shingle_hashes(t, k) for t in texts]
                fp = fingerprints_of(np.concatenate(lists), np.array([len(x) for x in lists]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), pa.array(fp.view(np.int64))], names=schema.names)

    return rows.mapInArrow(run, schema)


def _ball(value: Column, bits: int) -> Column:
    """The value and those with one set bit cleared."""
    flips = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b))
    return F.concat(F.array(value), F.transform(F.filter(flips, lambda m: value.bitwiseAND(m) != 0), lambda m: value.bitwiseXOR(m)))


def _segment(fp: Column, i: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, i * bits).bitwiseAND(F.lit((1 << bits) - 1))


def forest(fps: np.ndarray, max_bits: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between distinct fingerprints: each found
    one is compared with those not found yet, a block at a time."""
    rest = fps
    parents, children = [], []
    while len(rest) > 1:
        frontier, rest = rest[:1], rest[1:]
        while len(frontier) and len(rest):
            block, frontier = frontier[:256], frontier[256:]
            near = np.bitwise_count(rest[None, :] ^ block[:, None]) <= max_bits
            found = near.any(axis=0)
            if found.any():
                parents.append(block[near[:, found].argmax(axis=0)])
                children.append(rest[found])
                frontier = np.concatenate([frontier, rest[found]])
                rest = rest[~found]
    none = np.zeros(0, fps.dtype)
    return np.concatenate([none, *parents]), np.concatenate([none, *children])


def _bucket_links(max_bits: int):
    """Links of each bucket from a partition sorted by bucket and fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys = np.zeros((0, 2), np.int64)
        held_fp = np.zeros(0, np.uint64)
        done = False
        batches = iter(batches)
        while not done:
            batch = next(batches, None)
            done = batch is None
            if not done:
                keys = np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
                held_keys = np.concatenate([held_keys, keys])
                held_fp = np.concatenate([held_fp, batch.column(2).to_numpy().view(np.uint64)])
            if not len(held_fp):
                continue
            cuts = np.flatnonzero((held_keys[1:] != held_keys[:-1]).any(axis=1)) + 1
            bounds = np.concatenate([[0], cuts, [len(held_fp)] if done else []]).astype(np.int64)
            parents, children = [], []
            for i in np.flatnonzero(np.diff(bounds) > 1):
                p, c = forest(np.unique(held_fp[bounds[i] : bounds[i + 1]]), max_bits)
                parents.append(p)
                children.append(c)
            if parents:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (parents, children)], names=["a", "b"])
            held_keys, held_fp = held_keys[bounds[-1] :], held_fp[bounds[-1] :]

    return run


def fingerprint_links(distinct: DataFrame, *, max_bits: int = 3, hot: int = HOT_BUCKET) -> DataFrame:
    """``a, b``: links that connect all fingerprints within ``max_bits`` (3 at
    most) of each other as the full set of such pairs would."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments with balls of radius one reach three bits")
    fp = F.col("fp")
    rows = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("seg"), _ball(_segment(fp, i, 32), 32).alias("ball")) for i in (0, 1)])).alias("s"))
    rows = rows.select("fp", F.col("s.seg").alias("seg"), F.explode("s.ball").alias("value"))
    rows = rows.select("fp", "seg", (F.col("value") * 2 + F.col("seg")).alias("bucket"))
    crowded = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("bucket", F.lit(True).alias("crowded"))
    marked = rows.join(crowded, "bucket", "left")
    other = F.when(F.col("seg") == 0, _segment(fp, 1, 32)).otherwise(_segment(fp, 0, 32))
    finer = F.flatten(F.array(*[_halves(other, i) for i in (0, 1)]))
    keyed = marked.select("bucket", "fp", F.explode(F.when(F.col("crowded"), finer).otherwise(F.array(F.lit(-1).cast("long")))).alias("sub"))
    dealt = keyed.select("bucket", "sub", "fp").repartition("bucket", "sub").sortWithinPartitions("bucket", "sub", "fp")
    return dealt.mapInArrow(_bucket_links(max_bits), "a long, b long")


def _halves(value: Column, i: int) -> Column:
    return F.transform(_ball(_segment(value, i, 16), 16), lambda v: v * 2 + F.lit(i))


def near_duplicates(docs: DataFrame, *, k: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id``, one row per input row.

    ``component_id`` is the smallest ``doc_id`` that links reach. A null or empty
    text has fingerprint zero and links like any other; a null id takes part but
    is never a component's name unless all ids of it are null; repeated rows give
    repeated results; other columns are ignored; an empty table gives an empty
    result.
    """
    fps = cut(fingerprints(docs, k=k, id_col=id_col, text_col=text_col))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    classes = connected_components(fingerprint_links(distinct.select("fp"), max_bits=max_bits)).select(F.col("node").alias("fp"), "component")
    grouped = distinct.join(classes, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    labels = grouped.select("fp", "component").join(named, "component").select("fp", "component_id")
    return fps.join(labels, "fp").select("doc_id", "fp", "component_id")


#: Words of 64 bits in a wide fingerprint, and their columns.
WORDS = 4
FP = tuple(f"fp{i + 1}" for i in range(WORDS))
#: Buckets up to this size are tested for links before a forest is grown.
TESTED_BUCKET = 1024
#: Rows of a bucket or component's pair of blocks beyond which it is dealt out, and
#: the most buckets that are broadcast because they are.
CROWDED_BUCKET, MAX_BROADCAST = 50_000, 100_000


def _linked(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Whether rows of 64-bit words are near, over the arrays' common shape."""
    return sum(np.bitwise_count(a[..., i] ^ b[..., i]).astype(np.int16) for i in range(a.shape[-1])) <= max_bits


def wide_forest(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of a spanning forest of the links between wide fingerprints."""
    rest, parents, children = np.arange(len(fps)), [], []
    while len(rest) > 1:
        frontier, rest = rest[:1], rest[1:]
        while len(frontier) and len(rest):
            block, frontier = frontier[:64], frontier[64:]
            near = _linked(fps[block][:, None], fps[rest][None, :], max_bits)
            found = near.any(axis=0)
            if found.any():
                parents.append(block[near[:, found].argmax(axis=0)])
                children.append(rest[found])
                frontier = np.concatenate([frontier, rest[found]])
                rest = rest[~found]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *parents]), np.concatenate([none, *children])


def _wide_bucket_links(max_bits: int):
    """Links of each bucket from a partition sorted by ``bucket, sub``; rows are
    ``bucket, sub``, ``WORDS`` words of fingerprint, ``id``."""

    def links(fps: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.diff(bounds)
        small = sizes <= TESTED_BUCKET
        grown = ~small
        # Pairs at distance 1, 2, ... in the sorted rows of all small buckets.
        bucket = np.repeat(np.arange(len(sizes)), sizes)
        end, at, step = bounds[1:][bucket], np.flatnonzero(small[bucket]), 1
        while len(at):
            at = at[at + step < end[at]]
            grown[bucket[at[_linked(fps[at], fps[at + step], max_bits)]]] = True
            step += 1
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in np.flatnonzero(grown):
            own = slice(bounds[i], bounds[i + 1])
            p, c = wide_forest(fps[own], max_bits)
            a.append(ids[own][p])
            b.append(ids[own][c])
        return np.concatenate(a), np.concatenate(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, ids = np.zeros((0, 2), np.int64), np.zeros((0, WORDS), np.uint64), np.zeros(0, np.int64)
        batches, done = iter(batches), False
        while not done:
            batch = next(batches, None)
            done = batch is None
            if not done:
                columns = [c.to_numpy() for c in batch.columns]
                keys = np.concatenate([keys, np.column_stack(columns[:2])])
                fps = np.concatenate([fps, np.column_stack(columns[2:-1]).view(np.uint64)])
                ids = np.concatenate([ids, columns[-1]])
            if not len(ids):
                continue
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            bounds = np.concatenate([[0], cuts, [len(ids)] if done else []]).astype(np.int64)
            last = bounds[-1]
            if last:
                a, b = links(fps[:last], ids[:last], bounds)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            keys, fps, ids = keys[last:], fps[last:], ids[last:]

    return run


def _block_pairs(blocks: Column) -> Column:
    """A number for each pair of blocks that the row's block, a hash of its id, is in."""
    own = F.pmod(F.xxhash64("id"), blocks)
    return F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda x: F.least(own, x) * blocks + F.greatest(own, x))


def _bucket_forests(rows: DataFrame, max_bits: int, hot: int) -> DataFrame:
    """``a, b`` from rows of ``bucket``, fingerprint words and ``id``: a forest of the links in each
    bucket. A bucket of about ``hot`` rows or more, as a share of the ids tells, is
    dealt into blocks by a hash of the id and every two blocks meet in a group of
    their own, so that no link is lost and no group grows with the data."""
    share = max(1, hot // 1024)
    seen = rows.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).groupBy("bucket").agg((F.count(F.lit(1)) * share).alias("n"))
    crowded = cut(seen.where(F.col("n") > hot).select("bucket", F.ceil(F.col("n") / (hot / 2)).alias("blocks")))
    n = crowded.count()
    single = F.array(F.lit(-1).cast("long"))
    if n:
        crowded = F.broadcast(crowded) if n <= MAX_BROADCAST else crowded.hint("merge")
        rows = rows.join(crowded, "bucket", "left").withColumn("sub", F.explode(F.coalesce(_block_pairs(F.col("blocks")), single)))
    else:
        rows = rows.withColumn("sub", F.lit(-1).cast("long"))
    # A forest grows from its bucket's smallest id, so that the forests of buckets that
    # hold the same group have most of their links in common.
    dealt = rows.select("bucket", "sub", *FP, "id").repartition("bucket", "sub").sortWithinPartitions("bucket", "sub", "id")
    return dealt.mapInArrow(_wide_bucket_links(max_bits), "a long, b long")


def _shared_parents(links: DataFrame) -> DataFrame:
    """Links with the same components as ``a, b`` of parents and children in forests: a child
    and its parents are linked to the smallest of them. Copies meet in all their
    buckets and have a parent in each, mostly the same few, so about one link a copy is
    left. A child has one parent at most in each of its groups: one a bucket, and one a pair
    of blocks in buckets that are dealt out."""
    own = links.groupBy("b").agg(F.collect_set("a").alias("p"))
    return own.select(F.explode(F.array_append("p", F.col("b"))).alias("a"), F.array_min("p").alias("b")).where("a <> b").distinct()


#: Bits of a segment and their number, up to each number of documents. At a similarity
#: of 0.8 a bit differs with a probability of 0.151, so segments of 18 bits meet in
#: 0.37 of all cases and one of twelve in 0.996; the wider ones keep buckets small
#: and are as many as reach 0.99 as well (figures from correlated normal votes).
LAYOUTS = ((1 << 24, 18, 12), (1 << 27, 21, 18), (1 << 30, 24, 27), (1 << 62, 28, 47))
#: Least certain bits of a segment that its ball flips.
WEAK_BITS = 4
#: Candidates differ in at most this many of 256 bits. Sets of a similarity of 0.8
#: differ in 39 on average with a standard deviation of 6, unrelated ones in 128 with
#: one of 8, so that one of some 10^10 unrelated pairs that meet is a candidate.
CANDIDATE_BITS = 75
#: Votes of few shingles are coarse: sets of at most PREFIXED meet in their smallest
#: hashes, of which two that are similar enough share one for certain.
SEGMENTED, PREFIXED = 32, 40
#: Least similarity the segments are laid out for, in percent.
LEAST_PERCENT = 80
#: Characters of text in a block of a component of candidates.
BLOCK_CHARS = 4_000_000


def layout(n_docs: int) -> tuple[int, int]:
    """Bits and number of segments for so many documents."""
    return next((bits, n) for most, bits, n in LAYOUTS if n_docs <= most)


def weak_balls(votes: np.ndarray, counts: np.ndarray, bits: int, n_segments: int) -> np.ndarray:
    """Segment values of each document's fingerprint with one weak bit or none
    flipped, ``1 + WEAK_BITS`` a segment, marked with the segment's number."""
    margin = (2 * votes - counts[:, None]).reshape(len(counts), -1, 64)
    margin = margin[:, :, : 64 // bits * bits].reshape(len(counts), -1, bits)[:, :n_segments]
    place = np.int64(1) << np.arange(bits, dtype=np.int64)
    value = ((margin > 0) * place).sum(axis=2)
    weak = np.argsort(np.abs(margin), axis=2, kind="stable")[:, :, :WEAK_BITS]
    ball = np.concatenate([value[:, :, None], value[:, :, None] ^ place[weak]], axis=2)
    return ((ball * 64 + np.arange(n_segments)[None, :, None]) * 2).reshape(len(counts), -1)


def shingle_sets(docs: DataFrame, *, k: int = 5, percent: int = LEAST_PERCENT, bits: int = 18, n_segments: int = 12) -> DataFrame:
    """``doc_id, set1, set2, n``, ``FP`` and ``buckets`` of ``doc_id, text``: a digest of
    the set of shingles, their number, 256 bits of fingerprint, and the buckets in
    which similar sets meet: balls of the segments, and of sets up to ``PREFIXED`` the
    smallest hashes, of which two sets that are similar enough share one. Sets too
    small to be similar to another without being equal have no bucket."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(x, T.LongType()) for x in ("set1", "set2", "n", *FP)), T.StructField("buckets", T.ArrayType(T.LongType()))])
    n_words = max(WORDS, -(-n_segments // (64 // bits)))

    def buckets(x: np.ndarray, balls: np.ndarray) -> np.ndarray:
        if len(x) * (100 - percent) < percent:
            return np.zeros(0, np.int64)
        low = x[: len(x) + 1 + -len(x) * percent // 100].view(np.int64) | 1 if len(x) <= PREFIXED else np.zeros(0, np.int64)
        return np.concatenate([balls, low]) if len(x) >= SEGMENTED else low

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for lo, texts in text_slices(batch.column(1), BATCH_BYTES, BATCH_DOCS):
                lists = [np.unique(shingle_hashes(t, k)) for t in texts]
                counts, hashes = np.array([len(x) for x in lists]), np.concatenate(lists)
                digests = np.array([np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), np.int64) for x in lists])
                votes = []
                for _ in range(n_words):
                    votes.append(votes_of(hashes, counts))
                    hashes = mix(hashes)
                fp = [np.packbits(2 * v > counts[:, None], axis=1, bitorder="little").view("<i8").reshape(-1) for v in votes[:WORDS]]
                own = [buckets(x, b) for x, b in zip(lists, weak_balls(np.concatenate(votes, axis=1), counts, bits, n_segments), strict=True)]
                offsets = np.append(0, np.cumsum([len(x) for x in own]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, len(texts)), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(counts.astype(np.int64)), *map(pa.array, fp),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(own))),
                    ],
                    names=schema.names,
                )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def candidate_links(distinct: DataFrame, *, hot: int = CROWDED_BUCKET) -> DataFrame:
    """``a, b`` between the ids of rows of ``shingle_sets`` that connect all candidates."""
    return _shared_parents(_bucket_forests(distinct.select(F.explode("buckets").alias("bucket"), *FP, "id"), CANDIDATE_BITS, hot))


def set_forest(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a spanning forest of the links between sets (sorted arrays) of a
    Jaccard similarity of at least ``percent``, each compared exactly."""
    sizes = np.array([len(x) for x in sets])
    values, items = np.unique(np.concatenate(sets), return_inverse=True)
    ends, doc = np.cumsum(sizes), np.repeat(np.arange(len(sets)), sizes)
    all_items, rest, parents, children = items, np.arange(len(sets)), [], []
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            i = frontier.pop()
            mark = np.zeros(len(values), bool)
            mark[all_items[ends[i] - sizes[i] : ends[i]]] = True
            shared = np.bincount(doc[mark[items]], minlength=len(sets))[rest]
            near = 100 * shared >= percent * (sizes[i] + sizes[rest] - shared)
            if near.any():
                found, rest = rest[near], rest[~near]
                parents.append(np.full(len(found), i))
                children.append(found)
                frontier.extend(found)
                alive = np.zeros(len(sets), bool)
                alive[rest] = True
                items, doc = items[alive[doc]], doc[alive[doc]]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *parents]), np.concatenate([none, *children])


def similar_links(members: DataFrame, *, k: int = 5, percent: int = LEAST_PERCENT) -> DataFrame:
    """``a, b`` between the ids of ``component, sub, id, text``: a forest of the links
    of a similarity of at least ``percent`` inside each component's groups ``sub``."""
    dealt = members.select("component", "sub", "id", "text").repartition("component", "sub").sortWithinPartitions("component", "sub", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, sets = np.zeros((0, 2), np.int64), np.zeros(0, np.int64), []
        batches, done = iter(batches), False
        while not done:
            batch = next(batches, None)
            done = batch is None
            if not done:
                keys = np.concatenate([keys, np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])])
                ids = np.concatenate([ids, batch.column(2).to_numpy()])
                sets += [np.unique(shingle_hashes(t, k)) for t in texts_of(batch.column(3))]
            if not len(ids):
                continue
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            bounds = [0, *cuts.tolist(), *([len(ids)] if done else [])]
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                p, c = set_forest(sets[lo:hi], percent)
                a.append(ids[lo:hi][p])
                b.append(ids[lo:hi][c])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
            keys, ids, sets = keys[bounds[-1] :], ids[bounds[-1] :], sets[bounds[-1] :]

    return dealt.mapInArrow(run, "a long, b long")


def drop_similar(
    docs: DataFrame, *, k: int = 5, percent: int = LEAST_PERCENT, hot: int = CROWDED_BUCKET, block_chars: int = BLOCK_CHARS, segments: tuple[int, int] | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest id
    that links reach. Documents link where the Jaccard similarity of their sets of
    ``k``-word shingles is ``percent`` (80 at least) or more. Fingerprints fetch the
    candidates and miss about one of 200 pairs of a similarity of just 0.8, fewer
    above; no link is made on a fingerprint alone. ``segments`` are the bits and
    the number of the segments, by default those that ``layout`` has for the rows.

    Ids are integers. Rows that repeat an id are one document, which stays if one
    of its texts is the first of its copies and no link leads to a smaller id; the
    row of its smallest text stays. Rows with a null id can't be named and all stay.
    Texts without a word link to each other; an empty table gives an empty result.
    A component of candidates of more than ``block_chars`` is dealt into pairs of
    blocks like a crowded bucket.
    """
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError("the segments reach a similarity of 80 percent")
    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bits, n_segments = segments or layout(docs.count())
    # Rows are few bytes here and become many: a number of partitions that is given
    # keeps them from being coalesced into one.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = shingle_sets(named, k=k, percent=percent, bits=bits, n_segments=n_segments)
    distinct = cut(sets.groupBy("set1", "set2").agg(F.min("doc_id").alias("id"), *(F.min(c).alias(c) for c in ("n", *FP)), F.first("buckets").alias("buckets")).repartition(n, "id"))
    near = cut(connected_components(candidate_links(distinct, hot=hot)).select(F.col("node").alias("id"), "component"))
    # Shingles are about as many as words, of six characters on average.
    sizes = near.join(distinct.select("id", "n"), "id").groupBy("component").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") * 6 / block_chars)).alias("blocks"))
    dealt = near.join(sizes, "component").select("id", "component", F.explode(_block_pairs(F.col("blocks"))).alias("sub"))
    members = named.withColumnRenamed("doc_id", "id").join(dealt, "id")
    found = connected_components(_shared_parents(similar_links(members, k=k, percent=percent))).where("node <> component")
    first = distinct.join(found.select(F.col("node").alias("id")), "id", "left_anti").select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col)).distinct()
    kept = docs.join(first, id_col, "left_semi")
    order = Window.partitionBy(id_col).orderBy(F.col(text_col), F.xxhash64(*docs.columns))
    kept = kept.select(*docs.columns, F.row_number().over(order).alias("_row of its id")).where(F.col("_row of its id") == 1)
    return kept.select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
