"""Ranked lexical search against a plain scoring of every document, and SQL."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from strandloom.llm import search
from tests.compare import connect, spark_rows, sql_rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=50):
    held = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in held), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    wanted = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in wanted.items():
        scores = []
        for i, w in held:
            tf, score = Counter(w), 0
            m = 50 + (50 * len(w) * n_docs) // n_terms if n_terms else 0
            for t in own & set(tf):
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 20 * m))
            if score > 0 and i is not None:
                scores.append((-score, i))
        out += [(item, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scores)[:top])]
    return sorted(out)


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, item_id string"),
        spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, rank int, doc_id int"),
    )


def corpus(seed, n, words, size):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)]
    return [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(size)))) for i in range(n)]


EDGE = [
    (1, None), (2, ""), (3, "Alpha beta, ALPHA-gamma!"), (4, "été Été ÉTÉ naïve"), (5, "alpha " * 30_000 + "delta"), (6, "alpha beta"), (6, "alpha beta"), (None, "alpha beta gamma delta"),
    (8, "_alpha_ `beta` 123 x1"), (-7, "alpha beta"), (9, ". , ;"), (10, "K alpha"),
]
CASES = {
    "edge": (EDGE, [(1, "alpha beta"), (2, None), (3, ""), (4, "ÉTÉ été 123"), (5, "absent words"), (None, "alpha"), (6, "delta"), (6, "gamma alpha alpha"), (7, "x " * 3000 + "alpha")]),
    "ties": ([(i * 7 % 400, "same words here") for i in range(400)] + [(1000 + i, f"same x{i}") for i in range(50)], [(1, "same words"), (2, "here x3")]),
    "random": (corpus(1, 500, 60, 40), corpus(2, 40, 80, 12)),
    "no documents": ([], [(1, "a")]),
    "no items": ([(1, "a")], []),
}


@pytest.mark.parametrize("case", CASES)
def test_equals_plain_scoring(spark, monkeypatch, case):
    docs, items = CASES[case]
    got = search.search(*frames(spark, docs, items))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, items)


def blocks_of(docs, size):
    held = [terms(t) for _, t in docs]
    n_docs, n_terms = sum(map(bool, held)), sum(map(len, held))
    return [search.index_block([i for i, _ in docs[a : a + size]], [(t or "").encode() for _, t in docs[a : a + size]], n_docs, n_terms) for a in range(0, len(docs), size)], n_docs


@pytest.mark.parametrize(("step", "cells"), [(1, 10**6), (7, 40), (256, 200_000)])
def test_steps_and_blocks_of_any_size(monkeypatch, step, cells):
    monkeypatch.setattr(search, "STEP_RANGES", step)
    monkeypatch.setattr(search, "STEP_CELLS", cells)
    docs, items = corpus(3, 300, 50, 30), corpus(4, 12, 60, 10)
    queries = search.Queries.of([[t] for _, t in items])
    for size in (1, 9, 300):
        blocks, n_docs = blocks_of(docs, size)
        df = sum(np.where(r >= 0, np.frombuffer(b[4], "<i4")[r] if len(b[4]) else 0, 0) for b in blocks for r in [queries.rows_in(b[2], b[3])])
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()])
        best = [search.Best(5) for _ in items]
        for b in blocks:
            rows = queries.rows_in(b[2], b[3])
            if len(b[6]):
                treap = search.read_treap(b[0], *b[5:8])
                for own, item in zip(queries.items, best, strict=True):
                    if len(own := own[rows[own] >= 0]):
                        search.descend(treap, np.frombuffer(b[1], "<i8"), rows[own], weights[own], item)
        got = sorted((items[k][0], j + 1, i, s) for k, x in enumerate(best) for j, (s, i) in enumerate(zip(x.scores.tolist(), x.ids.tolist(), strict=True)))
        assert got == brute(docs, items, 5)


def test_bounds_leave_most_ranges_closed():
    docs = [(i, f"common words of document {i}") for i in range(4000)] + [(4000 + i, "needle " * (i + 1)) for i in range(10)]
    blocks, n_docs = blocks_of(docs, 5000)
    queries = search.Queries.of([["needle common"]])
    rows = queries.rows_in(blocks[0][2], blocks[0][3])[queries.items[0]]
    best = search.Best(5)
    weights = np.where(rows > 10, 8000, 300)  # the rarer term has the later row
    opened = search.descend(search.read_treap(blocks[0][0], *blocks[0][5:8]), np.frombuffer(blocks[0][1], "<i8"), rows, weights, best)
    assert len(best.ids) == 5 and set(best.ids.tolist()) <= set(range(4000, 4010)) and opened < 2000


def test_words_of_one_hash_are_told_apart(spark, monkeypatch):
    from strandloom.llm import textbatch

    whole = textbatch.span_hashes
    few = lambda data, starts, ends, seed=0: whole(data, starts, ends, seed) & np.uint64(7)
    monkeypatch.setattr(search, "span_hashes", few)
    monkeypatch.setattr(textbatch, "span_hashes", few)
    docs, items = corpus(5, 60, 40, 20), corpus(6, 10, 50, 8)
    blocks, _ = blocks_of(docs, 60)
    queries = search.Queries.of([[t] for _, t in items])
    rows, n = queries.rows_in(blocks[0][2], blocks[0][3]), np.frombuffer(blocks[0][2], "<i4")
    ends = np.cumsum(n)
    for k, row in enumerate(rows.tolist()):
        word = queries.data[queries.starts[k] : queries.starts[k] + queries.sizes[k]].tobytes()
        held = [blocks[0][3][e - x : e] for e, x in zip(ends.tolist(), n.tolist(), strict=True)]
        assert (row >= 0) == (word in held) and (row < 0 or held[row] == word)


def test_several_passes_over_the_index(spark, monkeypatch):
    monkeypatch.setattr(search, "PASS_ITEMS", 7)
    docs, items = corpus(7, 200, 60, 30), corpus(8, 20, 70, 10)
    assert sorted(tuple(r) for r in search.search(*frames(spark, docs, items)).collect()) == brute(docs, items)


def test_query_equals_sql(spark):
    columns, rows = sql_rows(connect("/root/testdata/sf0.001"), search.ORACLE_SQL)
    df = search.op11_lexical_search(spark, "/root/testdata/sf0.001")
    assert sorted(df.columns) == columns and spark_rows(df) == rows
