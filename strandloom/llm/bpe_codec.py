"""Byte-level BPE encoding and decoding with one encoding per distinct word.

Blocks of documents are cut into pre-tokens. What is shuffled is packed: each
block sends its distinct words, cut by hash range into buckets, and its parse
(the positions of the words, as numbers of its distinct words). A bucket's task
reads its rows as a stream, merges each word once (while a bounded table of
words holds it) and answers every block with ids. Words and answers are sorted
by hash, so the answers of a block, laid bucket after bucket, are in the order
of its word numbers; the parse is then read through them, position by position.
A word is shuffled at most once per block, so frequent words weigh no more than
rare ones, and the number of buckets follows from the bytes of all texts, so a
bucket doesn't grow with them.

The parse is not taken from a written table but computed again, in the same
way, in the second branch of the plan; blocks are keyed by a digest of their
content, and a block without its answers fails the job. The input must give the
same rows in the same order each time it is read, as files do; a table whose order
may change (behind a shuffle) is to be written first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm import bpe
from strandloom.llm.textbatch import Words, chunks, distinct_spans, ragged_index, text_slices
from strandloom.session import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bytes of a block of documents.
BLOCK_BYTES = 8_000_000
#: Bytes of all texts for each bucket of words; at most about a fifth of them are words to encode.
BUCKET_BYTES = 64_000_000
#: Packed bytes of words that a task encodes together, and words or tokens put in place together.
SLICE_BYTES = 500_000
SLICE_WORDS = 200_000


def pack(a: np.ndarray) -> bytes:
    """An integer array as compressed byte planes."""
    import zstandard

    a = np.ascontiguousarray(a, np.uint32)
    width = 1 if not len(a) else max(1, (int(a.max()).bit_length() + 7) // 8)
    planes = a.view(np.uint8).reshape(-1, 4)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(b: bytes) -> np.ndarray:
    import zstandard

    width = b[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 4), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u4").reshape(-1).astype(np.int64)


def _pack_bytes(a: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _unpack_bytes(b: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, Words]]:
    """Key, ids and words of each block."""
    import xxhash

    for batch in batches:
        for lo, texts in text_slices(batch.column(1), BLOCK_BYTES):
            words = Words(texts)
            ids = batch.column(0).slice(lo, len(texts))
            digest = xxhash.xxh3_128(repr(ids.to_pylist()).encode())
            for part in (words.hashes, words.parse, words.doc_counts):
                digest.update(part.tobytes())
            yield digest.hexdigest(), ids, words


def _parse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, ids, words in _blocks(batches):
        offsets = pa.array([0, len(ids)], pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (ids, pa.array(words.doc_counts, pa.int64()))]
        yield pa.RecordBatch.from_arrays([pa.array([key]), *lists, pa.array([pack(words.parse)], pa.binary())], names=["block", "doc_ids", "n_words", "parse"])


def _word_rows(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, words in _blocks(batches):
            ends = np.append(0, np.cumsum(words.sizes))
            bucket = bucket_of(words.hashes, n_buckets)
            cuts = np.searchsorted(bucket, np.arange(n_buckets + 1))
            held = [b for b in range(n_buckets) if cuts[b] < cuts[b + 1]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([key] * len(held)), pa.array(held, pa.int32()),
                    pa.array([pack(words.sizes[cuts[b] : cuts[b + 1]]) for b in held], pa.binary()),
                    pa.array([_pack_bytes(words.blob[ends[cuts[b]] : ends[cuts[b + 1]]]) for b in held], pa.binary()),
                ],
                names=["block", "bucket", "sizes", "blob"],
            )

    return run


def bucket_of(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """Equal ranges of the upper 32 bits, so buckets keep the order of hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)


def _encode_buckets(path: str):
    """Answers from a partition sorted by bucket. The table of known words is of
    one bucket and limited; words beyond it are merged again for each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = bpe.load_ranks(path)
        fresh = lambda: bpe.WordCache(lambda blob, sizes: bpe.merge_words(blob, sizes, merges))
        known, held = fresh(), None
        for batch in batches:
            bucket = batch.column(1).to_numpy()
            packed = [len(x) for x in batch.column(3).to_pylist()] if len(bucket) else []
            cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else []
            for first, last in zip(cuts[:-1], cuts[1:], strict=True):
                if bucket[first] != held:
                    known, held = fresh(), bucket[first]
                for lo, hi in chunks(packed[first:last], SLICE_BYTES):
                    yield _answers(batch.slice(first + lo, hi - lo), known)

    return run


def _answers(rows: pa.RecordBatch, known: bpe.WordCache) -> pa.RecordBatch:
    sizes = [unpack(x) for x in rows.column(2).to_pylist()]
    size, blob = np.concatenate(sizes), np.concatenate([_unpack_bytes(x) for x in rows.column(3).to_pylist()])
    begin = np.cumsum(size) - size
    hashes, at, entry = distinct_spans(blob, begin, size)
    ids, starts, counts = known.look(hashes, blob[ragged_index(begin[at], size[at])], size[at])
    own = np.split(entry, np.cumsum([len(s) for s in sizes])[:-1])
    return pa.RecordBatch.from_arrays(
        [rows.column(0), rows.column(1), pa.array([pack(counts[o]) for o in own], pa.binary()), pa.array([pack(bpe.expand(ids, starts, counts, o)) for o in own], pa.binary())],
        names=["block", "bucket", "counts", "ids"],
    )


def _reassemble(id_type: pa.DataType):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        order = pc.sort_indices(answers, [("bucket", "ascending")])
        answers = answers.take(order)
        new = np.append(True, np.diff(answers.column("bucket").to_numpy()) != 0) if len(answers) else np.zeros(0, bool)
        answers = answers.filter(pa.array(new))  # equal blocks give equal answers
        counts = np.concatenate([np.zeros(0, np.int64), *(unpack(x) for x in answers.column("counts").to_pylist())])
        ids = np.concatenate([np.zeros(0, np.int32), *(unpack(x).astype(np.int32) for x in answers.column("ids").to_pylist())])
        starts = np.cumsum(counts) - counts
        tables = []
        for doc_ids, n_words, packed in zip(*(blocks.column(c) for c in ("doc_ids", "n_words", "parse")), strict=True):
            parse = unpack(packed.as_py())
            if len(parse) and parse.max() >= len(counts):
                raise RuntimeError("a block of documents came back without ids for its words")
            n_words, doc_ids, before = n_words.values.to_numpy(), doc_ids.values, 0
            for lo, hi in chunks(n_words.tolist(), SLICE_WORDS):
                own = parse[before : before + int(n_words[lo:hi].sum())]
                before += len(own)
                ends = np.append(0, np.cumsum(counts[own]))[np.append(0, np.cumsum(n_words[lo:hi]))]
                flat = bpe.expand(ids, starts, counts, own)
                tables.append(pa.table({"doc_id": doc_ids.slice(lo, hi - lo), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))}))
        return pa.concat_tables(tables) if tables else pa.table({"doc_id": pa.array([], id_type), "ids": pa.array([], pa.list_(pa.int32()))})

    return run


def encode(
    docs: DataFrame, *, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", n_buckets: int | None = None,
) -> DataFrame:
    """``doc_id, ids``, one row per input row; no special tokens.

    A null or empty text has no ids; null ids of documents are carried; repeated
    rows give repeated results; other columns are ignored; an empty table gives
    an empty result. ``n_buckets``, if not given, is one for each ``BUCKET_BYTES``
    of text, at least the shuffle partitions. The input is read three times and
    must give the same rows in the same order each time.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType
    n = n_buckets
    if n is None:
        total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    parse = rows.mapInArrow(_parse_rows, T.StructType([T.StructField("block", T.StringType()), T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("n_words", T.ArrayType(T.LongType())), T.StructField("parse", T.BinaryType())]))
    words = rows.mapInArrow(_word_rows(n), "block string, bucket int, sizes binary, blob binary")
    dealt = words.repartition(n, "bucket").sortWithinPartitions("bucket", "block")
    answers = dealt.mapInArrow(_encode_buckets(ranks_path), "block string, bucket int, counts binary, ids binary")
    arrow_id = pa.array([], pa.int64()).type if isinstance(id_type, T.LongType) else pa.string()
    out = T.StructType([T.StructField("doc_id", id_type), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return parse.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_reassemble(arrow_id), out)


def decode(tokens: DataFrame, *, ranks_path: str) -> DataFrame:
    """Adds ``decoded`` (binary): the bytes of each document's ``ids``, looked up
    in the token table, which has one row per vocabulary entry. Null lists give no
    bytes; one document decodes to less than 2 GiB."""
    kept = tokens.columns
    schema = T.StructType([*tokens.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bpe.load_ranks(ranks_path).token_bytes
        sizes = np.array([len(t) for t in held])
        begins, blob = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(held), np.uint8)
        at = kept.index("ids")
        for batch in batches:
            n_tokens = pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_pylist()
            for lo, hi in chunks(n_tokens, SLICE_WORDS):
                some = batch.slice(lo, hi - lo)
                own = some.column(at).flatten().to_numpy()
                ends = np.append(0, np.cumsum(sizes[own]))[np.append(0, np.cumsum(n_tokens[lo:hi]))]
                data = blob[ragged_index(begins[own], sizes[own])]
                decoded = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(np.ascontiguousarray(ends, np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([*some.columns, decoded], names=schema.names)

    return tokens.mapInArrow(run, schema)


def digests(decoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    return digests(decode(encode(table(spark, sf_dir, "documents"), ranks_path=path), ranks_path=path))
