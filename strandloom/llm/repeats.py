"""Removal of repeated 100-byte strings by prefix-free parsing.

Parsing. A rolling hash runs over the bytes; each window of ``length`` bytes takes
as trigger the ``W``-byte string with the smallest hash in it. Windows with one
trigger in their first or in their second half form a phrase, and phrases overlap so
that every window lies whole in one. Triggers depend on the bytes of the window alone,
so equal windows have equal triggers at equal places. All windows of a phrase share the
trigger and as many bytes before or behind it as half a window leaves, its key: a window
of a phrase can only be equal to windows of phrases with the same key. Triggers alone
are met by ever more different phrases as a corpus grows, keys of 58 bytes by copies.
The phrases' suffixes up to the end of the trigger are prefix-free, which is what lets
order be decided phrase by phrase.

Dictionary and parse. A document's parse is its sequence of (key, phrase)
hashes, the key being called trigger below. Every occurrence of a phrase but the first repeats as a whole. Where
phrases differ around a trigger, the first occurrence of each phrase enters the
dictionary with its bytes; the suffixes of the dictionary's phrases are sorted
trigger by trigger to their first ``length`` bytes, and runs of equal suffixes
are repeats of their earliest member. Corpus order is thus decided by trigger,
phrase and phrase suffix, never by sorting the corpus's own suffixes.

Phrases are equal if two independent 64-bit hashes are, of the trigger and of the
phrase; suffixes are compared byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.textbatch import mix, ragged_index, span_hashes
from strandloom.session import scratch_path, table

#: Bytes of a trigger.
W = 16
#: Bytes parsed at a time; longer documents are cut into overlapping pieces.
CHUNK_BYTES = 2_000_000
#: Occurrences of a trigger beyond which its phrases' windows are dealt out one by one.
CROWDED = 1_000
#: Bytes of texts, and of crowded phrases, that a task works on at once, and rows it sorts or gives.
PORTION_BYTES, CROWD_BYTES, PORTION_ROWS = 16_000_000, 2_000_000, 2_000


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches ``id, text, ...`` cut to about ``PORTION_BYTES`` of text, a row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        share = np.cumsum(sizes) // PORTION_BYTES
        bounds = [0, *(np.flatnonzero(share[1:] != share[:-1]) + 1).tolist(), len(batch)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            if b > a or len(batch) == 0:
                yield batch.slice(a, b - a)


def pieces(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], np.ndarray, np.ndarray]]:
    """Rows, start in the document, bytes and bounds of pieces; each window of
    ``length`` bytes lies in exactly one piece."""
    rows, offsets, parts, total = [], [], [], 0

    def flush():
        bounds = np.append(0, np.cumsum([len(p) for p in parts]))
        return rows, offsets, np.frombuffer(b"".join(parts), np.uint8), bounds

    for i, t in enumerate(texts):
        for lo in range(0, max(0, len(t) - length + 1), CHUNK_BYTES):
            part = t[lo : lo + CHUNK_BYTES + length - 1]
            if total and total + len(part) > CHUNK_BYTES:
                yield flush()
                rows, offsets, parts, total = [], [], [], 0
            rows.append(i)
            offsets.append(lo)
            parts.append(part)
            total += len(part)
    if parts:
        yield flush()


def phrases(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """``piece, first window, last window, key hash, phrase hash`` of every
    phrase; windows are named by where they start in ``data``."""
    n, t = len(data), length - W + 1
    at = np.arange(n - W + 1)
    hashes = span_hashes(data, at, at + W)
    key = (hashes & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    low, width = key, 1
    while 2 * width <= t:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < t:
        low = np.minimum(low[: len(low) - (t - width)], low[t - width :])
    valid = ragged_index(bounds[:-1], np.diff(bounds) - (length - 1))
    trigger = (low[valid] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    late = trigger - valid >= t // 2  # the trigger lies in the window's second half
    new = np.append(True, (trigger[1:] != trigger[:-1]) | (late[1:] != late[:-1]) | (valid[1:] != valid[:-1] + 1))
    first = np.flatnonzero(new)
    lo, hi, q, late = valid[first], valid[np.append(first[1:], len(valid)) - 1], trigger[first], late[first]
    # What all windows with the trigger in that half have.
    begin = np.where(late, q - t // 2, q)
    own = mix(span_hashes(data, begin, np.where(late, q + W, q - t // 2 + 1 + length), seed=2) + late.astype(np.uint64))
    phrase = mix(span_hashes(data, lo, hi + length, seed=1) + (q - lo).astype(np.uint64))
    return np.searchsorted(bounds, lo, side="right") - 1, lo, hi, own, phrase


def _texts(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Whether each entry is the first with its keys."""
    order = np.lexsort(keys[::-1])
    same = np.ones(max(0, len(order) - 1), bool)
    for k in keys:
        s = k[order]
        same &= s[1:] == s[:-1]
    out = np.ones(len(order), bool)
    out[order[1:][same]] = False
    return out


def _parse(length: int):
    """``trigger, phrase, doc, packed`` of every phrase. A phrase whose equal was
    met earlier in the same batch is known to repeat: it needs no meeting, so it
    goes under a key of its own and frequent phrases don't crowd one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches):
            ids = batch.column(0).to_numpy()
            found = []
            for rows, offsets, data, bounds in pieces(_texts(batch.column(1)), length):
                piece, lo, hi, trigger, phrase = phrases(data, bounds, length)
                place = lo - bounds[piece] + np.array(offsets)[piece]
                found.append((ids[np.array(rows)[piece]], trigger, phrase, place, hi - lo))
            if not found:
                continue
            doc, trigger, phrase, place, span = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((phrase, trigger, place, doc))
            doc, trigger, phrase, place, span = (x[order] for x in (doc, trigger, phrase, place, span))
            once = np.ones(len(doc), bool)  # rows that repeat an id give their phrases once
            once[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1]) | (trigger[1:] != trigger[:-1]) | (phrase[1:] != phrase[:-1])
            doc, trigger, phrase, place, span = (x[once] for x in (doc, trigger, phrase, place, span))
            known = ~_firsts(trigger, phrase)
            trigger = np.where(known, mix(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64)), trigger)
            phrase = np.where(known, np.uint64(0), phrase)
            packed = (place << 10) | (span << 1) | known
            yield pa.RecordBatch.from_arrays([pa.array(trigger.view(np.int64)), pa.array(phrase.view(np.int64)), pa.array(doc), pa.array(packed)], names=["trigger", "phrase", "doc", "packed"])

    return run


def _resolve(crowded: int):
    """Marks of phrases from a partition sorted by trigger, phrase, document and
    place: every occurrence of a phrase but the first repeats; the firsts of a
    trigger with several phrases enter the dictionary. Of an unfinished trigger
    only its phrases' firsts are held, and not more than ``crowded`` of them."""

    def batch_of(trigger, doc, packed, first, many):
        key = np.where(first, trigger, 0)
        marks = ((packed >> 1) << 2) | (many.astype(np.int64) << 1) | first
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(key), pa.array(marks)], names=["doc", "key", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        held = (none, none, none)  # firsts of the unfinished trigger
        last, full, prev = None, False, None  # its last (trigger, phrase); whether it is crowded
        row = None  # the last row
        for batch in _with_end(batches):
            if batch is None:
                trigger = phrase = doc = packed = none
            else:
                trigger, phrase, doc, packed = (batch.column(k).to_numpy() for k in range(4))
            known = packed & 1 == 1
            no = np.zeros(len(trigger), bool)
            if known.any():
                yield batch_of(trigger[known], doc[known], packed[known], no[known], no[known])
                trigger, phrase, doc, packed = trigger[~known], phrase[~known], doc[~known], packed[~known]
            if len(trigger):  # the same phrase of the same place, from rows that repeat an id
                once = np.ones(len(trigger), bool)
                for x in (trigger, phrase, doc, packed):
                    once[1:] &= x[1:] == x[:-1]
                once[1:] = ~once[1:]
                once[0] = (trigger[0], phrase[0], doc[0], packed[0]) != row
                row = (trigger[-1], phrase[-1], doc[-1], packed[-1])
                trigger, phrase, doc, packed = trigger[once], phrase[once], doc[once], packed[once]
            if not len(trigger) and batch is not None:
                continue
            first = np.ones(len(trigger), bool)
            first[1:] = (trigger[1:] != trigger[:-1]) | (phrase[1:] != phrase[:-1])
            if len(trigger) and last is not None:
                first[0] = (trigger[0], phrase[0]) != last
            no = np.zeros(len(trigger), bool)
            yield batch_of(trigger[~first], doc[~first], packed[~first], no[~first], no[~first])
            t, d, p = (np.concatenate([h, x[first]]) for h, x in zip(held, (trigger, doc, packed), strict=True))
            was_full, n_open = full, 0
            if batch is not None:
                if last is None or trigger[-1] != last[0]:
                    full = False
                last = (trigger[-1], phrase[-1])
                n_open = int((t == trigger[-1]).sum())
                # A crowded trigger's firsts needn't wait for each other.
                full = full or n_open > crowded
                if full:
                    n_open = 0
            held = tuple(x[len(t) - n_open :] for x in (t, d, p))
            t, d, p = (x[: len(t) - n_open] for x in (t, d, p))
            _, of, n = np.unique(t, return_inverse=True, return_counts=True)
            many = n[of] > crowded if len(t) else np.zeros(0, bool)
            if len(t) and was_full and prev is not None:
                many |= t == prev
            if len(t) and full:
                many |= t == last[0]
            out = (n[of] > 1) | many if len(t) else many
            yield batch_of(t[out], d[out], p[out], np.ones(int(out.sum()), bool), many[out])
            prev = last[0] if last is not None else None

    return run


def _marks(marks: pa.Scalar) -> tuple[np.ndarray, ...]:
    """``key, place, span, first, crowded`` of a document's phrases."""
    key, packed = (marks.values.field(k).to_numpy(zero_copy_only=False) for k in range(2))
    return key, packed >> 11, (packed >> 2) & 511, packed & 1 == 1, (packed >> 1) & 1 == 1


def _dictionary(length: int):
    """Bytes of the phrases a document gives to the dictionary, ``span`` null; of phrases whose
    trigger is crowded every window goes as an entry under its own hash, unless an equal
    one came earlier in the batch: such windows are known to repeat and need no
    meeting, so runs of them go with their ``span`` and without bytes."""

    def entries(keys, docs, places, blobs, spans) -> pa.RecordBatch:
        cols = [pa.array(x, t) for x, t in zip((keys, docs, places, blobs, spans), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)]
        return pa.RecordBatch.from_arrays(cols, names=["key", "doc", "place", "bytes", "span"])

    def crowded_entries(crowd: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        h, d, p, at, windows, runs = _crowded_windows(crowd, length)
        for lo in range(0, len(h), 100_000):
            own = slice(lo, lo + 100_000)
            data = np.ascontiguousarray(windows[at[own]])
            blobs = pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(np.arange(0, data.size + 1, length, dtype=np.int32)), pa.py_buffer(data)])
            yield entries(h[own].view(np.int64), d[own], p[own], blobs, pa.nulls(len(data), pa.int64()))
        if len(runs[0]):
            spread = mix(runs[0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + runs[1].astype(np.uint64)).view(np.int64)
            yield entries(spread, runs[0], runs[1], pa.nulls(len(spread), pa.binary()), runs[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches):
            keys, docs, places, blobs, crowd, size = [], [], [], [], [], 0
            ids = batch.column(0).to_numpy()
            for i, text in enumerate(_texts(batch.column(1))):
                key, place, span, first, crowded = _marks(batch.column(2)[i])
                for k in np.flatnonzero(first & ~crowded):
                    keys.append(key[k])
                    places.append(place[k])
                    blobs.append(text[place[k] : place[k] + span[k] + length])
                docs += [ids[i]] * (len(keys) - len(docs))
                for k in np.flatnonzero(first & crowded):
                    crowd.append((ids[i], place[k], text[place[k] : place[k] + span[k] + length]))
                    size += len(crowd[-1][2])
                    if size > CROWD_BYTES:
                        yield from crowded_entries(crowd)
                        crowd, size = [], 0
            yield entries(keys, docs, places, blobs, [None] * len(keys))
            if crowd:
                yield from crowded_entries(crowd)

    return run


def _crowded_windows(crowd: list[tuple[int, int, bytes]], length: int) -> tuple:
    """``hash, doc, place, row`` of the windows of phrases ``doc, place, bytes`` that are the
    first with their bytes, the rows of all windows, and ``doc, place, span`` of the runs of
    all others. Windows of one hash are compared byte by byte with the first of them; those
    that differ from it stay as well."""
    which, offset, h = window_hashes([b for _, _, b in crowd], length)
    d = np.array([x[0] for x in crowd], np.int64)[which]
    p = np.array([x[1] for x in crowd], np.int64)[which] + offset
    order = np.lexsort((p, d, h))
    which, offset, h, d, p = (x[order] for x in (which, offset, h, d, p))
    head = np.append(True, h[1:] != h[:-1])
    of = np.flatnonzero(head)[np.cumsum(head) - 1]
    sizes = np.array([len(b) for _, _, b in crowd], np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(b"".join(b for _, _, b in crowd), np.uint8), length)
    at = (np.cumsum(sizes) - sizes)[which] + offset
    # The same place again, from rows that repeat an id, is no earlier one.
    known = ~head & ((d != d[of]) | (p != p[of]))
    maybe = np.flatnonzero(known)
    for lo in range(0, len(maybe), 100_000):
        some = maybe[lo : lo + 100_000]
        known[some] = (windows[at[some]] == windows[at[of[some]]]).all(axis=1)
    return h[~known], d[~known], p[~known], at[~known], windows, _runs(d[known], p[known])


def window_hashes(blobs: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``blob, offset, hash`` of all windows of the given byte strings."""
    sizes = np.array([len(b) for b in blobs], np.int64)
    data, begins = np.frombuffer(b"".join(blobs), np.uint8), np.cumsum(sizes) - sizes
    n = sizes - length + 1
    at = ragged_index(begins, n)
    which = np.repeat(np.arange(len(blobs)), n)
    return which, at - begins[which], span_hashes(data, at, at + length)


def _runs(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of consecutive window starts per document."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)) if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return doc[first], at[first], (at[last] - at[first]) if len(at) else at


def _sort_suffixes(length: int):
    """Repeats among the dictionary's phrases, from a partition sorted by key,
    document and place. What is held of the last key so far is only its entries
    that brought new suffixes, so entries that are single windows don't pile up. Runs
    that are known to repeat are passed on."""

    def repeats(key: np.ndarray, doc: np.ndarray, place: np.ndarray, blobs: list[bytes]):
        sizes = np.array([len(b) for b in blobs], np.int64)
        data, begins = np.frombuffer(b"".join(blobs), np.uint8), np.cumsum(sizes) - sizes
        n = sizes - length + 1
        at, which = ragged_index(begins, n), np.repeat(np.arange(len(blobs)), n)
        suffix = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, length)[at]).view(f"S{length}").ravel()
        d, p, g = doc[which], place[which] + at - begins[which], key[which]
        order = np.lexsort((p, d, suffix, g))  # the suffix array, key by key
        same = np.append(False, (g[order][1:] == g[order][:-1]) & (suffix[order][1:] == suffix[order][:-1]))
        news = np.bincount(which[order[~same]], minlength=len(blobs)) > 0
        return which[order[same]], d[order[same]], p[order[same]], news

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n_old = 0  # entries at the front that were answered before
        for batch in _with_end(b.slice(i, PORTION_ROWS) for b in batches for i in range(0, max(1, len(b)), PORTION_ROWS)):
            done = batch is None
            if not done:
                known = batch.column(4).is_valid().to_numpy(zero_copy_only=False)
                if known.any():
                    yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(known)) for k in (1, 2, 4)], names=["doc", "place", "span"])
                    batch = batch.filter(pa.array(~known))
                if len(batch):
                    held.append((*(batch.column(k).to_numpy() for k in range(3)), batch.column(3).to_pylist()))
            if not held or not (done or sum(len(x[0]) for x in held) - n_old >= 2000):
                continue
            key, doc, place = (np.concatenate([x[k] for x in held]) for k in range(3))
            blobs = [b for x in held for b in x[3]]
            entry, d, p, news = repeats(key, doc, place, blobs)
            fresh = entry >= n_old
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _runs(d[fresh], p[fresh])], names=["doc", "place", "span"])
            keep = np.flatnonzero((key == key[-1]) & news)
            held, n_old = [(key[keep], doc[keep], place[keep], [blobs[k] for k in keep])], len(keep)

    return run


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _answer(length: int):
    """Counts and remaining bytes of each document from its marks and repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches):
            out = []
            for i, text in enumerate(_texts(batch.column(1))):
                places, spans = [], []
                if batch.column(2)[i].is_valid:
                    _, place, span, first, _ = _marks(batch.column(2)[i])
                    places.append(place[~first])
                    spans.append(span[~first])
                if batch.column(3)[i].is_valid:
                    packed = batch.column(3)[i].values.to_numpy()
                    places.append(packed >> 10)
                    spans.append(packed & 1023)
                if not places:
                    out.append((len(text), 0, 0, text))
                    continue
                gone = removal_mask(len(text), np.concatenate(places), np.concatenate(spans), length)
                n_spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((len(text), int(gone.sum()), n_spans, np.frombuffer(text, np.uint8)[~gone].tobytes()))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def removal_mask(n: int, place: np.ndarray, span: np.ndarray, length: int) -> np.ndarray:
    """Which of ``n`` bytes the spans cover."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, np.minimum(place, n), 1)
    np.add.at(steps, np.minimum(place + span + length, n), -1)
    return np.cumsum(steps[:n]) > 0


def remove_repeats(docs: DataFrame, *, length: int = 100, id_col: str = "doc_id", text_col: str = "text", crowded: int = CROWDED) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (binary), one row per input row.

    Ids must be integers. A null or empty text has no bytes; rows with a null id
    neither lose bytes nor count as earlier; rows that share an id are one
    document: they are not held against each other, and spans found for the id
    apply to all its rows. Other columns are ignored; an empty table gives an
    empty result.

    The marks of repeating and dictionary phrases are written to the shared
    folder; the rest is one plan whose branches share the shuffle of the texts.
    """
    if not 2 * W <= length <= 500:
        raise ValueError("length must be 32 to 500 bytes")
    every = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    texts = every.where("doc IS NOT NULL")
    parse = texts.mapInArrow(_parse(length), "trigger long, phrase long, doc long, packed long")
    dealt = parse.repartition("trigger").sortWithinPartitions("trigger", "phrase", "doc", "packed")
    path = scratch_path(docs.sparkSession, "phrases")
    dealt.mapInArrow(_resolve(crowded), "doc long, key long, packed long").write.parquet(path)
    per_doc = docs.sparkSession.read.parquet(path).groupBy("doc").agg(F.collect_list(F.struct("key", "packed")).alias("marks"))
    entries = texts.join(per_doc, "doc").select("doc", "text", "marks").mapInArrow(_dictionary(length), "key long, doc long, place long, bytes binary, span long")
    sorted_entries = entries.repartition("key").sortWithinPartitions("key", "doc", "place")
    later = sorted_entries.mapInArrow(_sort_suffixes(length), "doc long, place long, span long")
    # Runs inside one phrase or window are shorter than 1024 windows.
    pieces_ = F.explode(F.sequence(F.lit(0), F.col("span"), F.lit(1000)))
    later = later.withColumn("o", pieces_).select("doc", (F.shiftleft(F.col("place") + F.col("o"), 10) + F.least(F.col("span") - F.col("o"), F.lit(999))).alias("piece"))
    repeats = later.groupBy("doc").agg(F.collect_list("piece").alias("repeats"))
    rows = texts.join(per_doc, "doc", "left").join(repeats, "doc", "left").select("doc", "text", "marks", "repeats")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    plain = every.where("doc IS NULL").select(F.col("doc").alias("doc_id"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.coalesce("text", F.lit("")).cast("binary").alias("kept"))
    return rows.mapInArrow(_answer(length), schema).unionByName(plain)


def op4_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[tuple[int, str | None]], length: int = 100) -> list[tuple[int, int, int, int, str]]:
    """The same result by a dictionary of all windows, for small tables."""
    seen: set[bytes] = set()
    out = []
    for i, t in sorted(texts):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if (s := b[p : p + length]) in seen:
                gone[p : p + length] = True
            seen.add(s)
        runs = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out
