"""Token ids in ORC files with light-weight indexes.

Documents are range-partitioned by id, encoded, and written as ORC: integers in
run-length encoding, row indexes, and a Bloom filter on the document id. Rows
carry the file's number and the ids before them in it, so the place of every
document in the whole sequence follows from the files' totals alone, and any
stripe can be read by itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm import bpe
from strandloom.llm.textbatch import Words, text_slices
from strandloom.session import scratch_path, table

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: Bytes of text whose pre-tokens are made distinct together.
BLOCK_BYTES = 4_000_000


@lru_cache(maxsize=2)
def _library(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _cache(path: str) -> bpe.WordCache:
    """Pre-tokens are encoded by the library, each once while the cache holds it."""
    tokenizer = _library(path)

    def encode(blob: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(sizes)
        whole = blob.tobytes()
        ids, counts = [], np.zeros(len(sizes), np.int64)
        for lo in range(0, len(sizes), 20_000):
            some = [whole[e - s : e].decode() for e, s in zip(ends[lo : lo + 20_000], sizes[lo : lo + 20_000], strict=True)]
            got = [e.ids for e in tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            counts[lo : lo + len(some)] = [len(x) for x in got]
            ids.append(np.array([i for x in got for i in x], np.int32))
        return np.concatenate([np.zeros(0, np.int32), *ids]), counts

    return bpe.WordCache(encode)


def encode_batch(texts: list[str], path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids with the end id behind each text, and the ids per text."""
    special = [s for s, _ in bpe.load_json(path)[1]]
    whole = {i: _library(path).encode(t, add_special_tokens=False).ids for i, t in enumerate(texts) if any(s in t for s in special)}
    words = Words(["" if i in whole else t for i, t in enumerate(texts)])
    ids, starts, counts = _cache(path).look(words.hashes, words.blob, words.sizes)
    flat = bpe.expand(ids, starts, counts, words.parse)
    total = np.append(0, np.cumsum(counts[words.parse]))
    ends = total[np.cumsum(words.doc_counts)]
    if whole:
        per = np.diff(np.append(0, ends))
        pieces = np.split(flat, ends[:-1])
        for i, x in whole.items():
            pieces[i], per[i] = np.array(x, np.int32), len(x)
        flat, ends = np.concatenate(pieces), np.cumsum(per)
    return np.insert(flat, ends, np.int32(end_id)), np.diff(np.append(0, ends)) + 1


def write_token_files(
    docs: DataFrame, path: str, *, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
    stripe_bytes: int = 16 << 20, bloom_fpp: float = 0.01,
) -> None:
    """Writes ``doc_id, part, part_start, n_tokens, ids`` to ``path`` as ORC, in
    ascending ``doc_id`` order over the files and within each (nulls first;
    repeated ids by text). A null or empty text holds the end id alone."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    schema = T.StructType([
        T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("part", T.IntegerType()), T.StructField("part_start", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, texts in text_slices(batch.column(1), BLOCK_BYTES):
                ids, counts = encode_batch(texts, tokenizer_path, end_id)
                n = len(texts)
                ends = np.cumsum(counts)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), pa.array(np.full(n, part), pa.int32()), pa.array(before + ends - counts, pa.int64()), pa.array(counts, pa.int64()), lists],
                    schema=pa.schema([("doc_id", batch.schema.field(0).type), ("part", pa.int32()), ("part_start", pa.int64()), ("n_tokens", pa.int64()), pa.field("ids", pa.list_(pa.field("element", pa.int32(), False)))]),
                )
                before += int(ends[-1])

    (ordered.mapInArrow(run, schema).write.option("orc.compress", "ZSTD").option("orc.bloom.filter.columns", "doc_id")
     .option("orc.bloom.filter.fpp", str(bloom_fpp)).option("orc.create.index", "true").option("orc.stripe.size", str(stripe_bytes)).orc(path))


def read_token_files(spark: SparkSession, path: str, id_type: T.DataType) -> DataFrame:
    """``doc_id, start, n_tokens, ids``: the files' totals, one row a file, give
    each file's place; filters on ``doc_id`` reach the stripes' indexes."""
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("part", T.IntegerType()), T.StructField("part_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    rows = spark.read.schema(schema).orc(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = totals.select("part", before.alias("before"))
    # One row of two integers a file: bounded by the number of files, which Spark lists anyway.
    return rows.join(F.broadcast(places), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def id_checksums(tokens: DataFrame) -> DataFrame:
    """Replaces ``ids`` by ``ids_crc32``, the CRC-32 of the ids as little-endian
    unsigned 32-bit integers."""
    kept = [c for c in tokens.columns if c != "ids"]
    rows = tokens.select(*kept, "ids")
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(kept))
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            data = memoryview(lists.flatten().to_numpy().astype("<u4")).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(crc, pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = scratch_path(spark, "token-files")
    write_token_files(docs, path, tokenizer_path=public_tokenizers.path(VOCABULARY))
    return id_checksums(read_token_files(spark, path, docs.schema["doc_id"].dataType))
