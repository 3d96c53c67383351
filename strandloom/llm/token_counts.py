"""Token counts by rank-synchronous merging of batched pre-tokens.

One narrow pass: each Arrow batch is cut into pre-tokens held as ragged numpy
arrays, all unfinished pre-tokens merge their lowest-rank pair in the same
round, and the symbols that survive are counted per document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm import bpe
from strandloom.llm.textbatch import Words, text_slices
from strandloom.session import table

VOCABULARY = "byte_bpe_50k.json"
#: Bytes of text whose pre-tokens are made distinct together.
BLOCK_BYTES = 8_000_000


@lru_cache(maxsize=2)
def _cache(path: str) -> bpe.WordCache:
    merges, _ = bpe.load_json(path)
    return bpe.WordCache(lambda blob, sizes: bpe.merge_words(blob, sizes, merges))


def count_batch(texts: list[str], path: str) -> np.ndarray:
    """Tokens of each text; special strings count as one token each."""
    parts, rows, n_special = bpe.split_special(texts, bpe.load_json(path)[1])
    words = Words(parts)
    _, _, counts = _cache(path).look(words.hashes, words.blob, words.sizes)
    total = np.append(0, np.cumsum(counts[words.parse]))
    ends = np.cumsum(words.doc_counts)
    per_part = total[ends] - total[ends - words.doc_counts]
    return n_special + np.bincount(rows, per_part, minlength=len(texts)).astype(np.int64)


def count_tokens(
    docs: DataFrame, *, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``, one row per input row.

    ``tokenizer_path`` names a tokenizers file with a byte-level BPE model. No
    begin, end or other special tokens are added and nothing is truncated. A null
    or empty text has 0 bytes and 0 tokens; null ids are carried; repeated rows
    give repeated results; other columns are ignored. Pre-tokens
    are told apart by their bytes.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in text_slices(batch.column(1), BLOCK_BYTES):
                n = count_batch(texts, tokenizer_path)
                size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], names=schema.names)

    return rows.mapInArrow(run, schema)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path=public_tokenizers.path(VOCABULARY))
