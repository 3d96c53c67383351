"""Batches of texts as flat numpy arrays: code points, pre-tokens, hashes.

Small helpers for Arrow batches inside Spark tasks; every function is given a
bounded batch and keeps nothing between calls but constant tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters handled at a time; bounds the memory of the arrays below.
CHUNK_CHARS = 500_000

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0


@cache
def _classes() -> np.ndarray:
    """Class of every code point, from the Unicode properties the pattern names."""
    import regex

    every = "".join(map(chr, range(0x110000)))
    out = np.zeros(0x110000, np.uint8)
    for cls, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = cls
    return out


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python strings, null as empty."""
    return [t or "" for t in column.to_pylist()]


def text_slices(column: pa.Array, limit: int, rows: int = 1 << 30) -> Iterator[tuple[int, list[str]]]:
    """First row and texts of consecutive slices of a batch of about ``limit`` bytes
    and at most ``rows`` rows (one at least); only a slice's texts are Python strings."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for a, b in chunks(sizes, limit):
        for lo in range(a, b, rows):
            yield lo, texts_of(column.slice(lo, min(b, lo + rows) - lo))


def chunks(lengths: list[int], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of about ``limit`` characters, one row at least."""
    lo, total = 0, 0
    for i, n in enumerate(lengths):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(lengths):
        yield lo, len(lengths)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts together and the start of each (with the end)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), starts


def utf8_offsets(cps: np.ndarray) -> np.ndarray:
    """Byte offset of every code point in UTF-8 (with the end)."""
    out = np.empty(len(cps) + 1, np.int64)
    out[0] = 0
    size = np.ones(len(cps), np.int8)
    if len(cps) and cps.max() > 0x7F:
        size += cps > 0x7F
        size += cps > 0x7FF
        size += cps > 0xFFFF
    np.cumsum(size, out=out[1:])
    return out


def pretoken_starts(cps: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Start of every pre-token; they tile the texts.

    The classes follow public_tokenizers.PATTERN: runs of letters, numbers or
    other characters take one preceding space along; the last character of a run
    of white space stands alone or goes to what follows; and an apostrophe that
    starts a run may open one of seven contractions.
    """
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64)
    cls = _classes()[cps]
    first = np.zeros(n + 1, bool)
    first[doc_starts] = True
    run = np.empty(n, bool)
    run[0] = True
    np.not_equal(cls[1:], cls[:-1], out=run[1:])
    run |= first[:n]
    start = run.copy()
    # Non-space runs behind white space of the same document.
    at = np.flatnonzero(run & (cls != SPACE) & ~first[:n])
    at = at[cls[at - 1] == SPACE]
    start[at - 1] = True
    start[at] = cps[at - 1] != 32
    # Contractions.
    q = np.flatnonzero((cps == 39) & start & run)
    q = q[q + 1 < n]
    q = q[~first[q + 1]]
    if len(q):
        a = cps[q + 1]
        far = np.minimum(q + 2, n - 1)
        b = np.where((q + 2 < n) & ~first[far], cps[far], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        start[q[one | two] + 1] = False
        for cut in (q[one] + 2, q[two] + 3):
            cut = cut[cut < n]
            start[cut[cls[cut] == LETTER]] = True
    return np.flatnonzero(start)


#: Bytes of a span hashed block by block with others; longer spans are hashed one by one.
LONG_SPAN = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _blocks_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one integer, without a copy."""
    return np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of the bytes ``data[s:e]`` for all spans: blocks of eight bytes
    are mixed in one after another, XXH3 takes spans beyond ``LONG_SPAN``."""
    import xxhash

    size = ends - starts
    h = (size.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    blocks, live, done = _blocks_of(data), np.flatnonzero((size > 0) & (size <= LONG_SPAN)), 0
    while len(live):
        own = h[live] ^ (blocks[starts[live] + done] & _MASKS[np.minimum(size[live] - done, 8)])
        own *= np.uint64(0xBF58476D1CE4E5B9)
        own ^= own >> np.uint64(32)
        own *= np.uint64(0x94D049BB133111EB)
        h[live] = own ^ (own >> np.uint64(29))
        done += 8
        live = live[size[live] > done]
    long = np.flatnonzero(size > LONG_SPAN)
    if len(long):
        view, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_64_intdigest
        h[long] = np.fromiter((digest(view[a:b], seed) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)), np.uint64, len(long))
    return mix(h)


def same_spans(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, other: np.ndarray, at: np.ndarray, other_sizes: np.ndarray) -> np.ndarray:
    """Whether the bytes ``data[s:s + n]`` equal those of ``other`` at ``at``."""
    same = sizes == other_sizes
    a, b, done = _blocks_of(data), _blocks_of(other), 0
    live = np.flatnonzero(same & (sizes > 0))
    while len(live) and done < LONG_SPAN:
        differ = ((a[starts[live] + done] ^ b[at[live] + done]) & _MASKS[np.minimum(sizes[live] - done, 8)]) != 0
        same[live[differ]] = False
        done += 8
        live = live[~differ & (sizes[live] > done)]
    for i in live.tolist():
        same[i] = np.array_equal(data[starts[i] + done : starts[i] + sizes[i]], other[at[i] + done : at[i] + sizes[i]])
    return same


def distinct_spans(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``hash, span, entry``: the hash and the first span of every distinct byte
    string, by ascending hash, and each span's entry. Bytes are compared, so
    different strings of one hash are entries of their own."""
    if hashes is None:
        hashes = span_hashes(data, starts, starts + sizes)
    found, at, back = np.unique(hashes, return_index=True, return_inverse=True)
    rest = np.flatnonzero(at[back] != np.arange(len(hashes)))
    while len(rest := rest[~same_spans(data, starts[rest], sizes[rest], data, starts[at[back[rest]]], sizes[at[back[rest]]])]):
        more, first, own = np.unique(hashes[rest], return_index=True, return_inverse=True)
        back[rest] = len(at) + own
        found, at = np.concatenate([found, more]), np.concatenate([at, rest[first]])
    order = np.argsort(found, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return found[order], at[order], place[back]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ragged_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of the given spans, one span after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


class Words:
    """Distinct pre-tokens of a batch (as UTF-8 spans) and each document's parse.
    Pre-tokens are told apart by their bytes; hashes only order them."""

    def __init__(self, texts: list[str]):
        none = np.zeros(0, np.int64)
        doc_counts, hashes, blobs, sizes, entries = [none], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)], [none], []
        for lo, hi in chunks([len(t) for t in texts]):
            cps, doc_starts = code_points(texts[lo:hi])
            starts = pretoken_starts(cps, doc_starts)
            offsets = utf8_offsets(cps)
            data = np.frombuffer("".join(texts[lo:hi]).encode("utf-8", "surrogatepass"), np.uint8)
            begin = offsets[starts]
            size = np.diff(np.append(begin, len(data)))
            doc_counts.append(np.diff(np.searchsorted(starts, doc_starts)))
            h, at, entry = distinct_spans(data, begin, size)
            hashes.append(h)
            entries.append(entry.astype(np.uint32))
            sizes.append(size[at])
            blobs.append(data[ragged_index(begin[at], size[at])])
        size, blob = np.concatenate(sizes), np.concatenate(blobs)
        begin = np.cumsum(size) - size
        #: Hash, bytes and length of every distinct pre-token, by ascending hash.
        self.hashes, at, entry = distinct_spans(blob, begin, size, np.concatenate(hashes))
        self.sizes = size[at]
        self.blob = blob[ragged_index(begin[at], self.sizes)]
        entry, firsts = entry.astype(np.uint32), np.cumsum([len(h) for h in hashes])
        #: Pre-tokens of every document, as numbers of distinct pre-tokens.
        self.parse = np.concatenate([np.zeros(0, np.uint32), *(entry[f : f + len(h)][e] for f, h, e in zip(firsts[:-1], hashes[1:], entries, strict=True))])
        self.doc_counts = np.concatenate(doc_counts)
