"""Personal data: fixed patterns and a linear-chain conditional random field.

The patterns find e-mail addresses, IP addresses, payment cards and phone
numbers. The field tags white-space separated tokens by word-shape features of a
token and its neighbours; it is trained by maximum likelihood on a small table
of labelled sentences and decoded by Viterbi over batches of lines as arrays.
Its spans are added where no pattern's span lies; theirs always stay.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.textbatch import code_points, text_slices
from strandloom.session import table

BASE_KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", "email", "ip", "card", "phone", "secret")
SHAPES, FLAGS, SIZES = 512, 512, 64
#: Bytes of text tagged at a time.
SLICE_BYTES = 600_000

# The patterns of the contract. Where a run of characters can't match from its
# start it can't from within, so starts inside a run are skipped; this keeps
# long runs linear. \G is the place behind the match before.
_EMAIL = regex.compile(r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the patterns, by start and then kind."""
    out = []
    if "@" in text:
        out += [(m.start(), m.end(), "email") for m in _EMAIL.finditer(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            if m.end() - m.start() < 14:
                continue
            d = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    order = {k: i for i, k in enumerate(BASE_KINDS)}
    return sorted(out, key=lambda s: (s[0], order[s[2]]))


@cache
def _char_classes() -> np.ndarray:
    """0 white space, 1 lower or other letter, 2 upper A-Z, 3 digit, then marks."""
    out = np.ones(0x110000, np.uint8)
    out[:0x80] = 15
    for lo, hi, c in ((48, 58, 3), (65, 91, 2), (97, 123, 1)):
        out[lo:hi] = c
    for i, ch in enumerate("@.-_+()=\"'"):
        out[ord(ch)] = 4 + i
    for ch in "\t\n\x0b\x0c\r ":
        out[ord(ch)] = 0
    return out


def tokens_of(cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each white-space separated token."""
    inside = np.concatenate([[False], _char_classes()[cps] > 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def shape_features(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Three categories of each token: its first runs of character classes, which
    classes it holds, and its length with its number of runs."""
    if not len(starts):
        return np.zeros((0, 3), np.int64)
    cls = _char_classes()[cps]
    bounds = np.column_stack([starts, ends]).ravel()
    if bounds[-1] == len(cls):
        cls = np.append(cls, 0)
    run = np.append(True, cls[1:] != cls[:-1])
    run[starts] = True
    runs = np.append(0, np.cumsum(run))
    n_runs = runs[ends] - runs[starts]
    where = np.flatnonzero(run)
    first = runs[starts]
    shape = np.zeros(len(starts), np.int64)
    for k in range(4):
        c = np.where(k < n_runs, cls[where[np.minimum(first + k, len(where) - 1)]], 0).astype(np.int64)
        shape = shape * 31 + c
    shape = (shape * 40503 >> 3) % SHAPES
    bit = np.zeros(16, np.int64)
    bit[[2, 3, 4, 5, 6, 7, 8, 11]] = 1 << np.arange(8)
    bit[1] = 256
    flags = np.bitwise_or.reduceat(bit[cls], bounds)[::2]
    size = np.minimum(np.log2(ends - starts).astype(np.int64), 7) * 8 + np.minimum(n_runs - 1, 7)
    return np.column_stack([shape, flags, size])


def stacked(features: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Feature rows of a token, the one before and the one behind on its line,
    as indices into one weight table."""
    n = len(features)
    widths = (SHAPES, FLAGS, SIZES)
    blocks, base = [], 0
    for shift in (0, 1, -1):
        moved = np.roll(features, shift, axis=0)
        edge = np.zeros(n, bool)
        if n and shift == 1:
            edge[0] = True
            edge[1:] = line[1:] != line[:-1]
        elif n and shift == -1:
            edge[-1] = True
            edge[:-1] = line[1:] != line[:-1]
        for k, w in enumerate(widths):
            blocks.append(np.where(edge, w, moved[:, k]) + base)
            base += w + 1
    return np.column_stack(blocks)


N_FEATURES = 3 * (SHAPES + FLAGS + SIZES + 3)


@dataclass(frozen=True)
class Crf:
    emit: np.ndarray  # feature x label
    move: np.ndarray  # label x label
    begin: np.ndarray

    def decode(self, features: np.ndarray, line: np.ndarray) -> np.ndarray:
        """Viterbi labels of all tokens; lines of like length advance together."""
        n, k = len(features), len(LABELS)
        labels = np.zeros(n, np.int64)
        if not n:
            return labels
        score = np.zeros((n, k), np.float32)
        for col in stacked(features, line).T:
            score += self.emit[col]
        first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
        length = np.diff(np.append(first, n))
        order = np.argsort(-length, kind="stable")
        first, length = first[order], length[order]
        back = np.zeros((n, k), np.int8)
        best = score[first] + self.begin
        for t in range(1, int(length[0])):
            live = int(np.searchsorted(-length, -t))  # lines longer than t
            step = best[:live, :, None] + self.move[None]
            at = first[:live] + t
            back[at] = step.argmax(axis=1)
            best[:live] = step.max(axis=1) + score[at]
        now = best.argmax(axis=1)
        for t in range(int(length[0]) - 1, -1, -1):
            live = int(np.searchsorted(-length, -t))
            at = first[:live] + t
            labels[at] = now[:live]
            now[:live] = back[at, now[:live]]
        return labels


def train(sentences: list[tuple[list[str], list[str]]], rounds: int = 120, l2: float = 1e-3, rate: float = 0.15) -> Crf:
    """Maximum likelihood by Adam over all sentences at once."""
    k = len(LABELS)
    number = {name: i for i, name in enumerate(LABELS)}
    text = "\n".join(" ".join(words) for words, _ in sentences)
    cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    starts, ends = tokens_of(cps)
    line = np.repeat(np.arange(len(sentences)), [len(w) for w, _ in sentences])
    x = stacked(shape_features(cps, starts, ends), line)
    gold = np.array([number[y] for _, labels in sentences for y in labels])
    n, t_max = len(sentences), max(len(w) for w, _ in sentences)
    first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    length = np.diff(np.append(first, len(line)))
    place = np.arange(len(line)) - first[line]
    mask = np.arange(t_max)[None, :] < length[:, None]
    inner = np.flatnonzero(place > 0)
    gold_move = np.zeros((k, k))
    np.add.at(gold_move, (gold[inner - 1], gold[inner]), 1)
    gold_begin = np.bincount(gold[first], minlength=k).astype(float)
    params = [np.zeros((N_FEATURES, k)), np.zeros((k, k)), np.zeros(k)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def soft(a, axis):
        top = a.max(axis=axis, keepdims=True)
        return (np.log(np.exp(a - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)

    for step in range(1, rounds + 1):
        emit, move, begin = params
        s = np.zeros((n, t_max, k))
        s[line, place] = emit[x].sum(axis=1)
        alpha, beta = np.zeros((n, t_max, k)), np.zeros((n, t_max, k))
        alpha[:, 0] = s[:, 0] + begin
        for t in range(1, t_max):
            a = soft(alpha[:, t - 1, :, None] + move[None], 1) + s[:, t]
            alpha[:, t] = np.where(mask[:, t, None], a, alpha[:, t - 1])
        for t in range(t_max - 2, -1, -1):
            b = soft(move[None] + (s[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None], b, 0)
        z = soft(alpha[:, -1], 1)
        p = np.exp(alpha + beta - z[:, None, None])
        g_move = gold_move.copy()
        for t in range(1, t_max):
            pair = np.exp(alpha[:, t - 1, :, None] + move[None] + (s[:, t] + beta[:, t])[:, None, :] - z[:, None, None])
            g_move -= pair[mask[:, t]].sum(axis=0)
        delta = -p[line, place]
        delta[np.arange(len(gold)), gold] += 1
        g_emit = np.zeros_like(emit)
        for col in x.T:
            np.add.at(g_emit, col, delta)
        grads = [g_emit - l2 * emit, g_move - l2 * move, gold_begin - p[:, 0].sum(axis=0) - l2 * begin]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            params[i] = params[i] + rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return Crf(params[0].astype(np.float32), params[1].astype(np.float32), params[2].astype(np.float32))


def labelled_sentences(n: int = 500, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """The training table: sentences of made-up words with personal data put in
    by rule, and as many without, among them marks that only look like it."""
    rnd = random.Random(seed)
    syllables = "an the re ou tion der schen le ment que los ción éa ü ing st er".split()
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))
    hexes = lambda k: "".join(rnd.choice("0123456789abcdef") for _ in range(k))
    caps = lambda k: "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(k))
    digits = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    low = lambda: re.sub(r"[^a-z]", "", word()) or "an"

    def private() -> tuple[list[str], str]:
        kind = rnd.choice(LABELS[1:])
        if kind == "email":
            return [f"{low()}.{rnd.randint(1, 99)}@{low()}{rnd.choice(['', '7'])}.{low()}.com"], kind
        if kind == "ip":
            return [".".join(str(rnd.randint(1, 255)) for _ in range(4))], kind
        if kind == "card":
            return ([digits(4) for _ in range(4)] if rnd.random() < 0.6 else ["-".join(digits(4) for _ in range(4))]), kind
        if kind == "phone":
            return rnd.choice([[f"+{rnd.randint(1, 9)}", f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"+{digits(2)}", digits(3), digits(3), digits(4)]]), kind
        name = rnd.choice(["password", "token", "api_key", "secret"])
        return rnd.choice([["AKIA" + caps(16)], [f"{name}={hexes(18)}"], [name, "=", f'"{hexes(40)}"'], ["ghp_" + caps(20)]]), kind

    def plain() -> str:
        w, r = word(), rnd.random()
        if r < 0.12:
            return w.capitalize()
        if r < 0.22:
            return w + rnd.choice([".", ",", ";"])
        if r < 0.26:
            return w + rnd.choice(["***", "###", "%%%", "$$$", "&&&", "!!!", "|"])
        if r < 0.30:
            return rnd.choice(["|", "-", "2.0.", "4.0.", "3.", "Version", "BY-NC", str(rnd.randint(1, 2030)), f"{rnd.randint(1, 9)}.{rnd.randint(0, 9)}", "https://example.org/a_b", w.upper(), f"({w})", f'"{w}"', f"{w}-{word()}"])
        return w

    out = []
    for i in range(n):
        words, labels = [], []
        for _ in range(rnd.randint(3, 14)):
            if i % 2 == 0 and rnd.random() < 0.2:
                own, kind = private()
                words += own
                labels += [kind] * len(own)
            else:
                words.append(plain())
                labels.append("O")
        if i % 2 == 0 and all(y == "O" for y in labels):
            own, kind = private()
            words, labels = words + own, labels + [kind] * len(own)
        out.append((words, labels))
    return out


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_sentences(), "tokens array<string>, labels array<string>")


def fit(labelled: DataFrame, max_sentences: int = 5000) -> Crf:
    """Trains on the driver from a table of at most ``max_sentences`` sentences."""
    rows = labelled.select("tokens", "labels").limit(max_sentences + 1).collect()
    if len(rows) > max_sentences:
        raise ValueError(f"the labelled table has more than {max_sentences} sentences")
    return train(sorted((list(r["tokens"]), list(r["labels"])) for r in rows))


def crf_spans(texts: list[str], crf: Crf) -> list[list[tuple[int, int, str]]]:
    """Spans of tagged tokens per text, without marks at their ends."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    cps, bounds = code_points([t + "\n" for t in texts])
    starts, ends = tokens_of(cps)
    if not len(starts):
        return out
    line = np.cumsum(cps == 10)[starts]
    labels = crf.decode(shape_features(cps, starts, ends), line)
    hit = np.flatnonzero(labels)
    if not len(hit):
        return out
    new = np.append(True, (hit[1:] != hit[:-1] + 1) | (labels[hit[1:]] != labels[hit[:-1]]) | (line[hit[1:]] != line[hit[:-1]]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(hit)) - 1
    for a, b in zip(hit[first].tolist(), hit[last].tolist(), strict=True):
        doc = int(np.searchsorted(bounds, starts[a], side="right")) - 1
        lo, hi = int(starts[a] - bounds[doc]), int(ends[b] - bounds[doc])
        while hi > lo and texts[doc][hi - 1] in ".,;:!?":
            hi -= 1
        if hi > lo and any(c.isdigit() for c in texts[doc][lo:hi]):
            out[doc].append((lo, hi, LABELS[int(labels[a])]))
    return out


def apart(spans: list[tuple[int, int, str]], taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans that overlap none of those taken: of these the farthest end so far
    tells whether any that starts before a span's end reaches into it."""
    taken = sorted(taken)
    starts, reach = [s for s, _, _ in taken], list(accumulate((e for _, e, _ in taken), max))
    return [x for x in spans if not (n := bisect_left(starts, x[1])) or reach[n - 1] <= x[0]]


def all_spans(texts: list[str], crf: Crf) -> tuple[list[list[tuple[int, int, str]]], list[list[tuple[int, int, str]]]]:
    """Pattern spans, and all spans in order, of each text."""
    base = [base_spans(t) for t in texts]
    every = []
    order = {k: i for i, k in enumerate((*BASE_KINDS, "secret"))}
    for own, more in zip(base, crf_spans(texts, crf), strict=True):
        free = apart(more, own) if own else more
        every.append(sorted(own + free, key=lambda s: (s[0], order[s[2]], s[1])))
    return base, every


SPANS = "array<struct<start:bigint,end:bigint,kind:string>>"


def find(docs: DataFrame, crf: Crf, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, text, base, spans`` and the columns ``keep``, one row per input
    row; the spans are ``(start, end, kind)`` in code points, end exclusive.

    Null and empty texts have no spans; null ids are carried; repeated rows give
    repeated results; an empty table gives an empty result.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"), *keep)
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))
    schema = T.StructType([*rows.schema.fields, T.StructField("base", span), T.StructField("spans", span)])
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in text_slices(batch.column(0), SLICE_BYTES):
                lists = all_spans(texts, crf)
                cols = [pa.array([[{"start": s, "end": e, "kind": k} for s, e, k in own] for own in x], arrow) for x in lists]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, len(texts)) for c in batch.columns), *cols], names=schema.names)

    return rows.mapInArrow(run, schema)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping
    spans the union goes, under the first one's kind."""
    out, at = [], 0
    for s, e, kind in sorted(spans):
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, crf: Crf, *, text_col: str = "text") -> DataFrame:
    """The input with personal data in its texts replaced; null stays null."""
    at, schema = docs.columns.index(text_col), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in text_slices(batch.column(at), SLICE_BYTES):
                some = batch.slice(lo, len(texts))
                _, spans = all_spans(texts, crf)
                new = [redacted(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
                null = some.column(at).is_null().to_numpy(zero_copy_only=False)
                cols = list(some.columns)
                cols[at] = pa.array(new, batch.schema.field(at).type, mask=null)
                yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return docs.mapInArrow(run, schema)


def digest_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), fit(labelled_table(spark)))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[number(k) for k in BASE_KINDS], F.sha2(digest_text(F.col("base")), 256).alias("base_sha256"), digest_text(F.col("spans")).alias("spans"))


def base_digest(text: str | None) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in base_spans(text or "")).encode()).hexdigest()
