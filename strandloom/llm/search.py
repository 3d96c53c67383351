"""Ranked lexical search over K2-treaps.

Documents are indexed in blocks. A block's grid has a row for each of its terms
(the most frequent first) and a column for each document; it is kept as a
quadtree, level by level: a nibble for every cell tells which of its four
quarters hold anything, and the greatest impact below a cell is stored as the
difference from its parent's. A term's row is a path of cells through it, so
the path gives upper bounds for every range of documents.

For an item the paths of all its terms descend together: the range of documents
with the greatest bound is halved next, until single documents with their exact
scores come out; ranges below the item's fiftieth score are never opened. The
impacts stored do not depend on the terms' weights, which come with the item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.decontaminate import _word_table
from strandloom.llm.textbatch import distinct_spans, ragged_index, same_spans, span_hashes, text_slices
from strandloom.session import cut, scratch_path, table

TOP = 50
#: Documents and bytes of text in a block of the index.
BLOCK_DOCS, BLOCK_BYTES = 4096, 6_000_000
#: Bytes of a row group of the index.
ROW_GROUP_BYTES = 16 << 20
#: Items and bytes of their texts that one pass over the index answers.
PASS_ITEMS, PASS_BYTES = 2000, 8_000_000
#: Ranges opened in one step, and numbers of cells that a step or an item's open ranges hold at most.
STEP_RANGES, STEP_CELLS = 256, 200_000
#: Groups in which an item's best documents of all tasks meet before they meet at last.
MERGE_GROUPS = 64

_BITS = np.array([bin(i).count("1") for i in range(16)], np.int32)


def terms_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, starts and lengths of their terms (runs of
    letters, digits and non-ASCII bytes), and the terms of each text."""
    data = _word_table()[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], data > 0, [False]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return data, starts, ends - starts, np.diff(np.append(0, np.searchsorted(starts, bounds)))


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of a number below 2^31 at every other place."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


@dataclass
class Treap:
    """The quadtree of a grid of ``2^height`` rows and columns: of all cells from the root
    down, the quarters that hold anything, the first of their children, and the greatest
    value below. Cell 0 is nothing, cell 1 the root."""

    height: int
    quarters: np.ndarray
    first: np.ndarray
    most: np.ndarray

    def halves(self, cells: np.ndarray, row_bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children of cells in the left and the right half of their columns, in the
        half of their rows that the bit names; 0 where there is none."""
        q = self.quarters[cells] >> (2 * row_bit)
        above = np.where(row_bit == 1, _BITS[self.quarters[cells] & 3], 0)
        left, right = q & 1, (q >> 1) & 1
        begin = self.first[cells] + above
        return begin * left, (begin + left) * right


def build_treap(shape: tuple[int, int], rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """Height, nibbles, differences and the cells per level of points of positive values."""
    height = max(1, (max(shape) - 1).bit_length())
    code = (_spread(rows) << np.uint64(1)) | _spread(columns)
    order = np.argsort(code)
    code, most = code[order], values[order].astype(np.int64)
    nibbles, lost, sizes = [], [], [len(code)]
    for _ in range(height):
        head = np.flatnonzero(np.concatenate([[True], code[1:] >> np.uint64(2) != code[:-1] >> np.uint64(2)])) if len(code) else np.zeros(0, np.int64)
        counts = np.diff(np.append(head, len(code)))
        above = np.maximum.reduceat(most, head) if len(head) else most
        nibbles.append(np.bitwise_or.reduceat(1 << (code & np.uint64(3)).astype(np.uint8), head).astype(np.uint8) if len(head) else np.zeros(0, np.uint8))
        lost.append((np.repeat(above, counts) - most).astype("<u4"))
        code, most = code[head] >> np.uint64(2), above
        sizes.append(len(head))
    lost.append(most.astype("<u4"))
    # From the root down; the four bytes of the differences apart, which packs better.
    flat = np.concatenate(lost[::-1])
    return height, np.concatenate(nibbles[::-1]).tobytes(), np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 4).T).tobytes(), np.array(sizes[::-1], "<i8").tobytes()


def read_treap(height: int, nibbles: bytes, lost: bytes, sizes: bytes) -> Treap:
    sizes = np.frombuffer(sizes, "<i8")
    n = int(sizes.sum())
    inner = np.frombuffer(nibbles, np.uint8)
    quarters = np.zeros(n + 1, np.uint8)
    quarters[1 : len(inner) + 1] = inner
    children = _BITS[quarters].astype(np.int64)
    # Children follow level by level in the order of their parents.
    first = (np.cumsum(children) - children + 1 + int(sizes[0])).astype(np.int32)
    most = np.zeros(n + 1, np.int32)
    own = np.ascontiguousarray(np.frombuffer(lost, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int32)
    at = 1
    for k, size in enumerate(sizes.tolist()):
        if k == 0:
            most[at : at + size] = own[:size]
        else:
            parent = np.repeat(np.arange(at - int(sizes[k - 1]), at), children[at - int(sizes[k - 1]) : at])
            most[at : at + size] = most[parent] - own[at - 1 : at - 1 + size]
        at += size
    return Treap(height, quarters, first, most)


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term adds for a weight of one: ``tf`` times in a document of ``n`` terms."""
    m = np.array([50 + 50 * x * n_docs // n_terms for x in n.tolist()], np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all terms, of rows of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms_of([t.encode("utf-8", "surrogatepass") for t in texts])[3] for _, texts in text_slices(batch.column(0), BLOCK_BYTES)]
            yield pa.RecordBatch.from_arrays([pa.array([sum(int((x > 0).sum()) for x in found)], pa.int64()), pa.array([sum(int(x.sum()) for x in found)], pa.int64())], names=["docs", "terms"])

    return tuple(docs.select("text").mapInArrow(run, "docs long, terms long").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first())


INDEX_SCHEMA = "height int, docs binary, term_sizes binary, term_bytes binary, df binary, nibbles binary, lost binary, sizes binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts of consecutive rows, ``BLOCK_DOCS`` and about ``BLOCK_BYTES`` at most."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for lo, some in text_slices(batch.column(1), BLOCK_BYTES // 4, BLOCK_DOCS // 4):
            encoded = [t.encode("utf-8", "surrogatepass") for t in some]
            n = sum(map(len, encoded))
            if ids and (size + n > BLOCK_BYTES or len(ids) + len(some) > BLOCK_DOCS):
                yield ids, texts
                ids, texts, size = [], [], 0
            ids, texts, size = ids + batch.column(0).slice(lo, len(some)).to_pylist(), texts + encoded, size + n
    if ids:
        yield ids, texts


def index_block(ids: list, texts: list[bytes], n_docs: int, n_terms: int) -> list:
    """One row of the index. Documents stand in ascending id; those without one count in
    the terms' numbers of documents but have no column."""
    data, starts, sizes, counts = terms_of(texts)
    hashes, at, entry = distinct_spans(data, starts, sizes)
    doc = np.repeat(np.arange(len(texts)), counts)
    pair, tf = np.unique(entry * len(texts) + doc, return_counts=True)
    term, doc = pair // max(1, len(texts)), pair % max(1, len(texts))
    df = np.bincount(term, minlength=len(hashes))
    by_df = np.argsort(-df, kind="stable")
    row = np.empty(len(by_df), np.int64)
    row[by_df] = np.arange(len(by_df))
    named = np.array([i is not None for i in ids], bool)
    order = np.array(sorted(np.flatnonzero(named).tolist(), key=lambda k: ids[k]), np.int64)
    column = np.full(len(ids), -1)
    column[order] = np.arange(len(order))
    value = impacts(tf, counts[doc], n_docs, n_terms) if len(tf) else tf
    kept = named[doc] & (value > 0)
    height, nibbles, lost, per_level = build_treap((len(df), len(order)), row[term[kept]], column[doc[kept]], value[kept])
    spans = at[by_df]
    blob = data[ragged_index(starts[spans], sizes[spans])]
    return [
        height, np.array([ids[k] for k in order.tolist()], "<i8").tobytes(), sizes[spans].astype("<i4").tobytes(), blob.tobytes(),
        df[by_df].astype("<i4").tobytes(), nibbles, lost, per_level,
    ]


def write_index(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[int, int]:
    """Indexes every row of ``docs`` (ids are integers) at ``path`` and returns the number
    of documents with a term and of all terms. A narrow pass: blocks are runs of rows."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n_docs, n_terms = corpus_size(rows)
    schema = T.StructType.fromDDL(INDEX_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _blocks(batches):
            row = index_block(ids, texts, n_docs, n_terms)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32() if i == 0 else pa.binary()) for i, x in enumerate(row)], names=schema.names)

    written = rows.mapInArrow(run, schema).write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES)
    # Rows are megabytes, so a row group's size is looked at after every one.
    for k in ("parquet.page.size.row.check.min", "parquet.page.size.row.check.max", "parquet.block.size.row.check.min", "parquet.block.size.row.check.max"):
        written = written.option(k, 1)
    written.parquet(path)
    return n_docs, n_terms


@dataclass
class Queries:
    """Distinct terms of a pass (bytes and hashes) and those of every item."""

    hashes: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    data: np.ndarray
    items: list[np.ndarray]

    @staticmethod
    def of(texts: list[list[str]]) -> Queries:
        flat = [t.encode("utf-8", "surrogatepass") for own in texts for t in own]
        data, starts, sizes, counts = terms_of(flat)
        hashes, at, entry = distinct_spans(data, starts, sizes)
        ends = np.append(0, np.cumsum(counts))[np.append(0, np.cumsum([len(own) for own in texts]))]
        return Queries(hashes, starts[at], sizes[at], data, [np.unique(entry[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)])

    def rows_in(self, sizes: bytes, blob: bytes) -> np.ndarray:
        """The row of each term in a block, -1 if it has none."""
        n, data = np.frombuffer(sizes, "<i4").astype(np.int64), np.frombuffer(blob, np.uint8)
        begin = np.cumsum(n) - n
        own = span_hashes(data, begin, begin + n)
        out = np.full(len(self.hashes), -1)
        order = np.argsort(own, kind="stable")
        at, end = (np.searchsorted(own[order], self.hashes, side=s) for s in ("left", "right"))
        rest = np.flatnonzero(at < end)
        while len(rest):  # terms of one hash stand one after another
            row = order[at[rest]]
            same = same_spans(self.data, self.starts[rest], self.sizes[rest], data, begin[row], n[row])
            out[rest[same]] = row[same]
            at[rest] += 1
            rest = rest[~same & (at[rest] < end[rest])]
        return out


def document_frequencies(index: DataFrame, queries) -> np.ndarray:
    """Documents that hold each term of a pass (a broadcast ``Queries``): reads the blocks'
    dictionaries only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = queries.value
        total = np.zeros(len(q.hashes), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                sizes, blob, df = (batch.column(c)[i].as_py() for c in range(3))
                row = q.rows_in(sizes, blob)
                total += np.where(row >= 0, np.frombuffer(df, "<i4")[row] if len(df) else 0, 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["term", "df"])

    out = np.zeros(len(queries.value.hashes), np.int64)
    counted = index.select("term_sizes", "term_bytes", "df").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    for r in counted.toLocalIterator():  # a row for each term of the pass at most
        out[r["term"]] = r["df"]
    return out


class Best:
    """The best documents of an item so far: greatest score first, then smallest id."""

    def __init__(self, top: int):
        self.top, self.scores, self.ids, self.floor = top, np.zeros(0, np.int64), np.zeros(0, np.int64), 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.append(self.scores, scores), np.append(self.ids, ids)
        order = np.lexsort((ids, -scores))[: self.top]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.top:
            self.floor = max(1, int(self.scores[-1]))


def descend(treap: Treap, docs: np.ndarray, rows: np.ndarray, weights: np.ndarray, best: Best) -> int:
    """Adds the documents of a block to an item's best: the rows' paths descend jointly,
    always into the ranges of documents of the greatest bounds. Returns the ranges opened."""
    n_ranges, opened = max(1, min(STEP_RANGES, STEP_CELLS // len(rows))), 0
    bounds = np.array([int(weights.sum()) * int(treap.most[1])])
    cells, level, begin = np.ones((1, len(rows)), np.int32), np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        open_ = bounds >= best.floor
        if not open_.all():
            bounds, cells, level, begin = bounds[open_], cells[open_], level[open_], begin[open_]
        if not len(bounds):
            return opened
        # The greatest bounds first; deepest first while too many ranges are open to hold.
        key = bounds if cells.size <= 4 * STEP_CELLS else level
        pick = np.argpartition(-key, n_ranges - 1)[:n_ranges] if len(bounds) > n_ranges else np.arange(len(bounds))
        rest = np.ones(len(bounds), bool)
        rest[pick] = False
        own, deep, first = cells[pick], level[pick], begin[pick]
        opened += len(pick)
        row_bit = ((rows[None, :] >> (treap.height - 1 - deep)[:, None]) & 1).astype(np.uint8)
        children = np.concatenate(treap.halves(own, row_bit))
        scores = (treap.most[children] * weights).sum(axis=1)
        deep = np.concatenate([deep, deep]) + 1
        first = np.concatenate([2 * first, 2 * first + 1])
        some = scores >= best.floor
        children, scores, deep, first = children[some], scores[some], deep[some], first[some]
        last = deep == treap.height
        if last.any():
            best.add(scores[last], docs[first[last]])
        go = ~last
        bounds, cells = np.concatenate([bounds[rest], scores[go]]), np.concatenate([cells[rest], children[go]])
        level, begin = np.concatenate([level[rest], deep[go]]), np.concatenate([begin[rest], first[go]])


def _search_blocks(queries, weights: np.ndarray, top: int):
    """Rows ``item, score, doc_id, part``: each item's best documents of a partition of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = queries.value
        best = [Best(top) for _ in q.items]
        for batch in batches:
            for i in range(batch.num_rows):
                height, docs, sizes, blob, nibbles, lost, levels = (batch.column(c)[i].as_py() for c in range(7))
                docs = np.frombuffer(docs, "<i8")
                if not len(docs) or not len(lost):
                    continue
                treap, row = read_treap(height, nibbles, lost, levels), q.rows_in(sizes, blob)
                for item, own in zip(best, q.items, strict=True):
                    own = own[row[own] >= 0]
                    if len(own):
                        descend(treap, docs, row[own], weights[own], item)
        n = [len(b.ids) for b in best]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(best)), n), pa.int64()), pa.array(np.concatenate([np.zeros(0, np.int64), *(b.scores for b in best)])), pa.array(np.concatenate([np.zeros(0, np.int64), *(b.ids for b in best)])), pa.array(np.full(sum(n), TaskContext.get().partitionId()), pa.int32())],
            names=["item", "score", "doc_id", "part"],
        )

    return run


def _passes(items: DataFrame) -> Iterator[tuple[list, list[list[str]]]]:
    """Ids and texts of items, in passes of bounded size; rows of one id are one item."""
    ids, texts, size = [], [], 0
    for r in items.groupBy("item_id").agg(F.collect_list("text").alias("texts")).orderBy("item_id").toLocalIterator():
        n = sum(map(len, r["texts"]))
        if ids and (len(ids) == PASS_ITEMS or size + n > PASS_BYTES):
            yield ids, texts
            ids, texts, size = [], [], 0
        ids, texts, size = [*ids, r["item_id"]], [*texts, r["texts"]], size + n
    if ids:
        yield ids, texts


def search(docs: DataFrame, items: DataFrame, *, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of the greatest scores above 0
    for each item, equal scores by ascending id.

    The index holds every document and is written once below ``spark.checkpoint.dir``;
    items are answered ``PASS_ITEMS`` at a time. Null and empty texts have no terms, so
    they are neither counted nor found; a document without an id counts in all numbers and
    is never returned, an item without one is left out; rows that repeat a document's id are
    documents of their own, rows that repeat an item's are one item; other columns are
    ignored; empty tables give an empty result.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "treap-index")
    n_docs, _ = write_index(docs, path, id_col=id_col, text_col=text_col)
    index = spark.read.parquet(path)
    wanted = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where("item_id IS NOT NULL")
    schema = T.StructType([wanted.schema["item_id"], T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    out = spark.createDataFrame([], schema)
    for ids, texts in _passes(wanted):
        queries = spark.sparkContext.broadcast(Queries.of(texts))
        df = document_frequencies(index, queries)
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        found = index.select("height", "docs", "term_sizes", "term_bytes", "nibbles", "lost", "sizes").mapInArrow(_search_blocks(queries, weights, top), "item long, score long, doc_id long, part int")
        order = (F.desc("score"), F.col("doc_id"))
        some = Window.partitionBy("item", F.pmod("part", F.lit(MERGE_GROUPS))).orderBy(*order)
        found = found.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top).drop("rank")
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("item", T.LongType()), wanted.schema["item_id"]]))
        # As many names as a pass has items.
        out = out.unionByName(cut(found.join(F.broadcast(names), "item").select(*schema.names)))
    return out


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
n AS (SELECT doc_id, w AS words, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
t AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM n),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(words) AS term FROM n) GROUP BY ALL),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, t GROUP BY term, docs),
s AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms))))::BIGINT AS score
      FROM i JOIN w USING (term) JOIN tf USING (term) JOIN n USING (doc_id), t GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 50"""
