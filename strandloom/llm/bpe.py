"""Byte-pair merges on ragged numpy arrays, and the vocabularies they use."""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np

from strandloom.llm.textbatch import ragged_index, same_spans

NO_RANK = np.int32(2**31 - 1)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(2**64 - 1)


class Merges:
    """Pair -> (rank, merged id), a flat open-addressing table."""

    def __init__(self, byte_ids: np.ndarray, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray, token_bytes: list[bytes]):
        self.byte_ids = byte_ids.astype(np.int32)
        self.token_bytes = token_bytes
        bits = max(10, int(np.ceil(np.log2(max(1, len(left)) * 8))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, _EMPTY, np.uint64)
        self.rank = np.full(1 << bits, NO_RANK, np.int32)
        self.merged = np.zeros(1 << bits, np.int32)
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = ((key * _MULT) >> self.shift).astype(np.int64)
        todo = np.arange(len(key))
        while len(todo):
            free = todo[self.keys[slot[todo]] == _EMPTY]
            _, pick = np.unique(slot[free], return_index=True)
            put = free[pick]
            self.keys[slot[put]], self.rank[slot[put]], self.merged[slot[put]] = key[put], rank[put], merged[put]
            todo = np.setdiff1d(todo, put)
            slot[todo] = (slot[todo] + 1) & self.mask

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or ``NO_RANK``) and merged id of each pair."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = ((key * _MULT) >> self.shift).astype(np.int64)
        held = self.keys[slot]
        miss = np.flatnonzero((held != key) & (held != _EMPTY))
        while len(miss):
            slot[miss] = (slot[miss] + 1) & self.mask
            held = self.keys[slot[miss]]
            miss = miss[(held != key[miss]) & (held != _EMPTY)]
        return np.where(self.keys[slot] == key, self.rank[slot], NO_RANK), self.merged[slot]


@lru_cache(maxsize=4)
def load_ranks(path: str) -> Merges:
    """A rank file: a pair merges if its bytes are a token, at that token's rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
    left, right, rank = [], [], []
    for token, r in ranks.items():
        for k in range(1, len(token)):
            a, b = ranks.get(token[:k]), ranks.get(token[k:])
            if a is not None and b is not None:
                left.append(a)
                right.append(b)
                rank.append(r)
    held = [b""] * (max(ranks.values()) + 1)
    for token, r in ranks.items():
        held[r] = token
    return Merges(np.array([ranks[bytes([i])] for i in range(256)]), np.array(left), np.array(right), np.array(rank, np.int32), np.array(rank, np.int32), held)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies:
    printable Latin-1 stands for itself, the rest follow from U+0100."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def load_json(path: str) -> tuple[Merges, tuple[tuple[str, int], ...]]:
    """A tokenizers file with a byte-level BPE model: merges by their order, and
    its added special strings."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    vocab, letters = whole["model"]["vocab"], byte_letters()
    merges = [m.split(" ") if isinstance(m, str) else m for m in whole["model"]["merges"]]
    held = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        held[i] = bytes(letters[c] for c in token)
    of_byte = {b: c for c, b in letters.items()}
    left, right = np.array([vocab[a] for a, _ in merges]), np.array([vocab[b] for _, b in merges])
    merged = np.array([vocab[a + b] for a, b in merges], np.int32)
    added = tuple((x["content"], x["id"]) for x in whole["added_tokens"])
    return Merges(np.array([vocab[of_byte[b]] for b in range(256)]), left, right, np.arange(len(merges), dtype=np.int32), merged, held), added


def merge_words(blob: np.ndarray, sizes: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words (bytes ``blob``, lengths ``sizes``) and tokens per word.

    Rank-synchronous: in each round every unfinished word merges all occurrences
    of its pair of lowest rank, from the left; ranks are looked up again only
    beside what merged; finished words leave the arrays.
    """
    n_words = len(sizes)
    counts = np.zeros(n_words, np.int64)
    done_word, done_ids = [], []
    sym = merges.byte_ids[blob]
    word = np.repeat(np.arange(n_words), sizes)
    n = len(sym)
    last = np.ones(n, bool)
    if n:
        last[:-1] = word[1:] != word[:-1]
    rank = np.full(n, NO_RANK, np.int32)
    target = np.zeros(n, np.int32)
    inner = np.flatnonzero(~last)
    rank[inner], target[inner] = merges.find(sym[inner], sym[inner + 1])
    while n:
        first = np.flatnonzero(np.append(True, last[:-1]))
        low = np.minimum.reduceat(rank, first)
        length = np.diff(np.append(first, n))
        live = low != NO_RANK
        if not live.all():  # finished words leave
            keep = np.repeat(live, length)
            done_word.append(word[~keep])
            done_ids.append(sym[~keep])
            sym, word, last, rank, target = sym[keep], word[keep], last[keep], rank[keep], target[keep]
            n = len(sym)
            if not n:
                break
            low, length = low[live], length[live]
        hit = rank == np.repeat(low, length)
        at = np.flatnonzero(hit)
        # In a run of overlapping occurrences every other one merges.
        fresh = np.append(True, (at[1:] != at[:-1] + 1) | last[at[:-1]])
        begin = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - begin) % 2 == 0]
        sym[at] = target[at]
        last[at] = last[at + 1]
        keep = np.ones(n, bool)
        keep[at + 1] = False
        place = np.cumsum(keep) - 1
        sym, word, last, rank, target = sym[keep], word[keep], last[keep], rank[keep], target[keep]
        n = len(sym)
        at = place[at]
        near = np.zeros(n, bool)
        near[at] = True
        near[np.maximum(at - 1, 0)] = True
        look = np.flatnonzero(near)
        end = last[look]
        rank[look[end]] = NO_RANK
        look = look[~end]
        rank[look], target[look] = merges.find(sym[look], sym[look + 1])
    if not done_word:
        return np.zeros(0, np.int32), counts
    word, ids = np.concatenate(done_word), np.concatenate(done_ids)
    order = np.argsort(word, kind="stable")
    counts += np.bincount(word, minlength=n_words)
    return ids[order], counts


def expand(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray, parse: np.ndarray) -> np.ndarray:
    """Ids of a parse: each entry is replaced by its word's ids."""
    return ids[ragged_index(starts[parse], counts[parse])]


class WordCache:
    """Ids of the words a worker has met, at most ``limit`` of them, none longer
    than ``LONGEST``; ``encode`` takes ``(blob, sizes)`` and gives ``(ids, counts)``.
    A cached word is used for the same bytes only, so results don't depend on what
    the cache holds."""

    LONGEST = 64

    def __init__(self, encode, limit: int = 400_000):
        self.encode, self.limit = encode, limit
        self.hashes = np.zeros(0, np.uint64)
        self.starts = self.counts = self.begins = self.sizes = np.zeros(0, np.int64)
        self.ids, self.blob = np.zeros(0, np.int32), np.zeros(0, np.uint8)

    def look(self, hashes: np.ndarray, blob: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``ids, starts, counts`` for words given by ascending hash."""
        at = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == hashes[inside]
        met = known.copy()
        begins = np.cumsum(sizes) - sizes
        known[met] = same_spans(blob, begins[met], sizes[met], self.blob, self.begins[at[met]], self.sizes[at[met]])
        new = ~known
        got, n_got = self.encode(blob[ragged_index(begins[new], sizes[new])], sizes[new])
        ids = np.concatenate([self.ids, got.astype(np.int32)])
        starts, counts = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        starts[known], counts[known] = self.starts[at[known]], self.counts[at[known]]
        starts[new], counts[new] = len(self.ids) + np.cumsum(n_got) - n_got, n_got
        keep = ~met & (sizes <= self.LONGEST)
        keep[1:] &= hashes[1:] != hashes[:-1]
        room = self.limit - len(self.hashes)
        if room > 0 and keep.any():
            keep = np.flatnonzero(keep)[:room]
            begun = len(self.blob) + np.cumsum(sizes[keep]) - sizes[keep]
            self.blob = np.concatenate([self.blob, blob[ragged_index(begins[keep], sizes[keep])]])
            placed = len(self.ids) + np.cumsum(counts[keep]) - counts[keep]
            self.ids = np.concatenate([self.ids, ids[ragged_index(starts[keep], counts[keep])]])
            for name, value in (("starts", placed), ("counts", counts[keep]), ("begins", begun), ("sizes", sizes[keep]), ("hashes", hashes[keep])):
                setattr(self, name, np.insert(getattr(self, name), at[keep], value))
        return ids, starts, counts


def split_special(texts: list[str], special: tuple[tuple[str, int], ...]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts cut at special strings: the parts, the row of each, and the number
    of special strings per row."""
    import re

    n_special = np.zeros(len(texts), np.int64)
    names = [s for s, _ in special]
    if not any(s in t for s in names for t in texts):
        return texts, np.arange(len(texts)), n_special
    pattern = re.compile("|".join(re.escape(s) for s in sorted(names, key=len, reverse=True)))
    parts, rows = [], []
    for i, t in enumerate(texts):
        own = pattern.split(t)
        n_special[i] = len(own) - 1
        parts += own
        rows += [i] * len(own)
    return parts, np.array(rows), n_special
