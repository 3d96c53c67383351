"""Best-fit packing of token sequences by linear grouping.

Pieces have at most ``capacity`` whole lengths, so a histogram of that many
counts describes any number of them. On it the packing is planned: lengths above
``small`` are cut into groups of equal cardinality and rounded up to their
group's longest; for these few sizes the best configurations of a sequence come
from a linear programme, solved by generating columns; whole multiples of the
configurations are taken and actual lengths put in for the rounded ones. What
is left over and the small pieces go, longest first, where they fit best.

Pieces of one length are interchangeable, so the plan is a table of intervals
of their ranks, some thousands at most whatever the number of pieces; Spark
ranks the pieces and every task looks its own up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.textbatch import ragged_index, text_slices
from strandloom.llm.token_files import BLOCK_BYTES, END_ID, VOCABULARY, encode_batch
from strandloom.operators.statistics import global_rank
from strandloom.session import cut, table

CAPACITY = 1024
#: Groups of the rounded lengths; the plan with the fewest sequences is taken.
GROUPS = (16, 48)
#: Columns generated at most; the programme's value is within a small part of the best long before.
MAX_COLUMNS = 600


def pieces(
    docs: DataFrame, *, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: the token ids of each text and the end
    id, cut into pieces of ``capacity`` of which the first may be shorter. A null or
    empty text holds the end id alone; null ids are carried; rows that repeat an id are
    documents of their own; other columns are ignored."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()), *(T.StructField(x, T.LongType()) for x in ("start", "length", "ids_crc32"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in text_slices(batch.column(1), BLOCK_BYTES):
                ids, counts = encode_batch(texts, tokenizer_path, end_id)
                n = -(-counts // capacity)
                row = np.repeat(np.arange(len(texts)), n)
                piece = ragged_index(np.zeros(len(n), np.int64), n)
                first = counts - (n - 1) * capacity
                start = np.where(piece > 0, first[row] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, first[row])
                at = (np.cumsum(counts) - counts)[row] + start
                data = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row + lo)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=schema.names,
                )

    return rows.mapInArrow(run, schema)


def best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size a sequence of the greatest worth takes; one more piece is
    added to the best of every room at a time, as many as the smallest size allows."""
    reach = int(sizes.min())
    room = np.arange(capacity + 1)[None, :] - sizes[:, None]
    layers, picks = [np.zeros(capacity + 1)], []
    for _ in range(capacity // reach):
        gain = np.where(room >= 0, layers[-1][np.maximum(room, 0)] + worth[:, None], -np.inf)
        pick = gain.argmax(axis=0)
        best = gain[pick, np.arange(capacity + 1)]
        more = best > layers[-1] + 1e-12
        if not more.any():
            break
        picks.append(np.where(more, pick, -1))
        layers.append(np.where(more, best, layers[-1]))
    out, c = np.zeros(len(sizes), np.int64), capacity
    for pick in picks[::-1]:
        if pick[c] >= 0:
            out[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Configurations (a row each) and how often each is used in the least number of
    sequences, in fractions, that hold the demand."""
    k = len(sizes)
    patterns = np.diag(capacity // sizes).astype(float)
    b = demand.astype(float)
    for _ in range(MAX_COLUMNS):
        dual = np.linalg.solve(patterns.T, np.ones(k))
        new = best_configuration(sizes, dual, capacity)
        if new @ dual <= 1 + 1e-7:
            break
        x, d = np.linalg.solve(patterns, b), np.linalg.solve(patterns, new.astype(float))
        ratio = np.where(d > 1e-9, np.maximum(x, 0) / np.where(d > 1e-9, d, 1), np.inf)
        patterns[:, int(ratio.argmin())] = new
    return patterns.T.round().astype(np.int64), np.maximum(np.linalg.solve(patterns, b), 0)


@dataclass
class Plan:
    """Intervals of ranks, in the order of falling length: from ``first`` on, pieces go to
    sequences counted up from ``sequence``, at ``offset`` of each."""

    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    n_sequences: int


class _Filling:
    """Sequences by what is free in them, as runs of equal ones, and the intervals so far."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.capacity = capacity
        #: Rank of the first piece of each length that is not placed yet, and pieces left.
        above = np.append(np.cumsum(counts[::-1])[::-1], 0)
        self.next, self.left = above[1:].copy(), counts.astype(np.int64).copy()
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.rows: list[tuple[int, int, int]] = []
        self.n = 0

    def put(self, length: int, sequence: int, n: int, offset: int) -> None:
        """The next ``n`` pieces of a length into as many sequences."""
        self.rows.append((int(self.next[length]), sequence, offset))
        self.next[length] += n
        self.left[length] -= n

    def open(self, n: int) -> int:
        self.n += n
        return self.n - n

    def best_fit(self, length: int) -> None:
        """All pieces left of a length, into the fullest sequences that have room, or new ones."""
        while self.left[length]:
            free = next((f for f in range(length, self.capacity + 1) if self.runs[f]), None)
            if free is None:
                free, wanted = self.capacity, -(-int(self.left[length]) // (self.capacity // length))
                self.runs[free].append((self.open(wanted), wanted))
            sequence, n = self.runs[free].pop()
            each = free // length
            full = min(n, int(self.left[length]) // each)
            m, times = (full, each) if full else (1, int(self.left[length]))
            for i in range(times):
                self.put(length, sequence, m, self.capacity - free + i * length)
            self.runs[free - times * length].append((sequence, m))
            if n > m:
                self.runs[free].append((sequence + m, n - m))


def grouped(counts: np.ndarray, groups: int, small: int) -> tuple[np.ndarray, np.ndarray]:
    """Rounded sizes and the pieces of each: lengths above ``small`` and below the
    capacity in so many groups of equal cardinality, each at its longest."""
    large = np.arange(len(counts) - 2, small, -1)
    n_large = int(counts[large].sum())
    if not n_large:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # The cuts may fall inside a length.
    per = -(-n_large // groups)
    heads = np.arange(0, n_large, per)
    sizes, where = np.unique(large[np.searchsorted(np.cumsum(counts[large]), heads, side="right")], return_inverse=True)
    demand = np.zeros(len(sizes), np.int64)
    np.add.at(demand, where, np.minimum(per, n_large - heads))
    return sizes, demand


def filled(counts: np.ndarray, sizes: np.ndarray, demand: np.ndarray, patterns: np.ndarray, times: np.ndarray, small: int, hold: int = 1) -> Plan:
    """The plan that takes every configuration as often as ``times`` says, as far as its
    pieces go, and places the rest by best fit; the ``hold`` shortest slots of each are
    left to best fit as well."""
    capacity = len(counts) - 1
    fill = _Filling(counts, capacity)
    whole = int(counts[capacity])
    if whole:
        fill.put(capacity, fill.open(whole), whole, 0)
    held = [int(x) for x in demand]
    for pattern, x in zip(patterns, np.floor(times + 1e-9).astype(np.int64).tolist(), strict=True):
        slots = np.repeat(np.arange(len(sizes)), pattern)[::-1].tolist()
        x = min([x, *(held[g] // int(pattern[g]) for g in set(slots))])
        if x <= 0 or not slots:
            continue
        begin, runs, reserve = fill.open(x), [(0, x, 0)], int(sizes[slots].sum())
        for i, g in enumerate(slots):
            held[g] -= x
            reserve -= int(sizes[g])
            # What rounding left over in a slot goes to the next ones.
            if i == 0 or i < len(slots) - hold:
                runs = _substitute(fill, small, reserve, begin, runs)
        for a, b, used in runs:
            fill.runs[capacity - used].append((begin + a, b - a))
    for length in range(capacity - 1, 0, -1):
        fill.best_fit(length)
    rows = np.array(sorted(fill.rows), np.int64).reshape(-1, 3)
    return Plan(rows[:, 0], rows[:, 1], rows[:, 2], fill.n)


def plan(counts: np.ndarray, groups: tuple[int, ...] = GROUPS) -> Plan:
    """The plan with the fewest sequences over the numbers of groups, with lengths up to
    an eighth or a third of the capacity as the small ones. Rounding makes the programme
    open more sequences than actual lengths need, so its configurations are also taken
    less often, by up to four times the share that rounding added and half at most."""
    found = []
    for small in ((len(counts) - 1) // 8, (len(counts) - 1) // 3):
        for g in groups:
            sizes, demand = grouped(counts, g, small)
            patterns, times = configurations(sizes, demand, len(counts) - 1) if len(sizes) else (np.zeros((0, 0), np.int64), np.zeros(0))
            actual = int((counts * np.arange(len(counts)))[small + 1 : -1].sum())
            added = 1 - actual / max(1, int((sizes * demand).sum()))
            found += [filled(counts, sizes, demand, patterns, times * (1 - min(0.5, k * added)), small, hold) for k in (0, 1, 2, 4) for hold in (0, 1)]
    return min(found, key=lambda p: p.n_sequences)


def _substitute(fill: _Filling, small: int, reserve: int, begin: int, runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Actual pieces for one slot of the sequences ``runs`` (first, end, tokens so far) of a
    configuration: the longest left that leave ``reserve`` for the slots to come. Returns
    the runs, cut where the length changes."""
    out = []
    for a, b, used in runs:
        length = fill.capacity - used - reserve
        while a < b:
            while length > small and not fill.left[length]:
                length -= 1
            if length <= small:  # slots that stay empty
                out.append((a, b, used))
                break
            n = min(b - a, int(fill.left[length]))
            fill.put(length, begin + a, n, used)
            out.append((a, a + n, used + length))
            a += n
    return out


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS, order: tuple[str, ...] = ("doc_id", "start", "ids_crc32")) -> DataFrame:
    """Adds ``sequence_id, offset`` to rows with a ``length`` of 1 to ``capacity``: no two
    overlap in a sequence and none leaves a gap. Rows that are equal in ``length`` and
    ``order`` are interchangeable; an empty table gives an empty result."""
    rows = cut(pieces)
    wrong = rows.where(F.col("length").isNull() | ~F.col("length").between(1, capacity)).count()
    if wrong:
        raise ValueError(f"{wrong} pieces are not of 1 to {capacity} tokens")
    counts = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy("length").count().collect():  # ``capacity`` rows at most
        counts[r["length"]] = r["count"]
    placed = plan(counts, groups)
    ranked = global_rank(rows, [F.desc("length"), *(F.col(c) for c in order)], "_rank")
    # The plan goes to the tasks with the function: its size follows the capacity.
    first, sequence, offset = placed.first, placed.sequence, placed.offset
    schema = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column(batch.num_columns - 1).to_numpy() - 1
            i = np.searchsorted(first, rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence[i] + rank - first[i]), pa.array(offset[i])], names=schema.names)

    return ranked.select(*rows.columns, "_rank").mapInArrow(run, schema)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pack(pieces(table(spark, sf_dir, "documents"), tokenizer_path=public_tokenizers.path(VOCABULARY)))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
