"""Near duplicates, repeated strings, contamination against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from strandloom.llm import decontaminate, repeats, simhash
from strandloom.llm.textbatch import span_hashes


def brute_fingerprint(text, k=3):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    sh = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def components(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(n)]


def words(rnd, n):
    return [rnd.choice("alpha beta gamma delta épsilon zeta eta theta".split()) + str(rnd.randint(0, 60)) for _ in range(n)]


def near_table():
    rnd = random.Random(5)
    rows = [(100, None), (101, ""), (102, "\t \n"), (103, "One two"), (103, "One two"), (104, "ONE  two"), (105, "É x y"), (106, "é x y")]
    for g in range(6):
        base = words(rnd, 300)
        for c in range(6):
            own = list(base)
            for _ in range(c):
                own[rnd.randrange(300)] = "edit"
            rows.append((200 + 10 * g + c, " ".join(own)))
    return rows


def test_simhash_equals_brute_force(spark):
    rows = near_table()
    got = simhash.near_duplicates(spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, fp int")).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    comp = components(len(rows), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 3)
    name = {c: min(rows[i][0] for i in range(len(rows)) if comp[i] == c) for c in comp}
    want = sorted((i, f if f < 2**63 else f - 2**64, name[c]) for (i, _), f, c in zip(rows, fps, comp, strict=True))
    assert sorted(map(tuple, got)) == want


def test_long_documents_are_counted_in_pieces():
    t = " ".join(words(random.Random(1), 1000))
    h = np.concatenate([simhash.shingle_hashes(t), simhash.shingle_hashes("a b c d")])
    assert simhash.fingerprints_of(h, np.array([998, 0, 2])).tolist() == [brute_fingerprint(t), 0, brute_fingerprint("a b c d")]


@pytest.mark.parametrize("hot", [4096, 3])
def test_links_of_crowded_buckets(spark, hot):
    rng = np.random.default_rng(0)
    one = lambda: np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)
    centres = rng.integers(0, 2**63, 30, dtype=np.uint64)
    x = np.unique(np.concatenate([centres, *[centres ^ one() ^ one() for _ in range(12)], *[centres ^ one() ^ one() ^ one() for _ in range(6)]]))
    got = simhash.fingerprint_links(spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long"), hot=hot).collect()
    at = {int(v): i for i, v in enumerate(x.view(np.int64))}
    links = {(at[r.a], at[r.b]) for r in got} | {(at[r.b], at[r.a]) for r in got}
    assert all(bin(int(x[i]) ^ int(x[j])).count("1") <= 3 for i, j in links)
    want = components(len(x), lambda i, j: bin(int(x[i]) ^ int(x[j])).count("1") <= 3)
    assert components(len(x), lambda i, j: (i, j) in links) == want


def test_query_names_and_formats(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{d}/documents.parquet' ORDER BY doc_id").fetchall()
    fps = [brute_fingerprint(t) for _, t in rows]
    comp = components(len(rows), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 3)
    want = [(i, f"{f:016x}", rows[c][0]) for (i, _), f, c in zip(rows, fps, comp, strict=True)]
    got = simhash.op5_simhash(spark, d)
    assert got.columns == ["doc_id", "fingerprint", "component_id"] and sorted(map(tuple, got.collect())) == want


def brute_kept(rows):
    """Ids of the smallest document of each group of a similarity of 0.8; ids are distinct."""
    rows = sorted(rows, key=lambda r: r[0])
    sets = [set(simhash.shingle_hashes(t or "", 5).tolist()) for _, t in rows]
    near = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    return sorted({rows[c][0] for c in components(len(rows), near)})


@pytest.mark.parametrize(("hot", "block"), [(50_000, 4_000_000), (3, 3000)])
def test_one_document_of_each_group_stays(spark, hot, block):
    rows = near_table()
    docs = spark.createDataFrame([*((i, t, 7) for i, t in rows), (None, "lost id", 7), (None, "lost id", 7), (900, "row b", 1), (900, "row a", 2), (900, "row a", 3)], "doc_id long, text string, fp int")
    kept = simhash.drop_similar(docs, hot=hot, block_chars=block).collect()
    ids = [r.doc_id for r in kept]
    assert sorted(k for k in ids if k is not None) == sorted([*brute_kept(dict(rows).items()), 900]) and ids.count(None) == 2
    # Of two texts of 300 words that differ in one word, one stays; of rows of one id that of the smallest text.
    assert not {k for k in ids if k and 200 <= k < 900 and k % 10 == 1} and [r.text for r in kept if r.doc_id == 900] == ["row a"]


def jaccard(a, b, k=5):
    a, b = (set(simhash.shingle_hashes(x, k).tolist()) for x in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def edited_pairs(seed, sizes, n):
    """Pairs of texts, the second with some words replaced or cut off, with their similarity."""
    rnd, pairs = random.Random(seed), []
    while len(pairs) < n:
        a = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice(sizes))]
        b = a[: len(a) - rnd.randrange(1 + len(a) // 6)]
        for _ in range(rnd.randrange(1 + len(a) // 30)):
            b[rnd.randrange(len(b))] = f"x{rnd.randrange(10**6)}"
        j = jaccard(" ".join(a), " ".join(b))
        if 0.7 <= j < 0.9:
            pairs.append((" ".join(a), " ".join(b), j))
    return pairs


@pytest.mark.parametrize(
    ("sizes", "hot", "block", "segments", "least"),
    [((8, 9, 12, 20, 35, 42), 50_000, 4_000_000, None, 0.995), ((60, 150, 400), 50_000, 4_000_000, None, 0.98), *(((60, 150, 400), 50_000, 4_000_000, segments, 0.98) for segments in ((21, 18), (24, 27), (28, 47))), ((60, 150), 3, 500, None, 0.98)],
)
def test_pairs_are_dropped_by_their_jaccard_similarity(spark, sizes, hot, block, segments, least):
    pairs = edited_pairs(11, sizes, 500)
    docs = spark.createDataFrame([(2 * i + s, p[s]) for i, p in enumerate(pairs) for s in (0, 1)], "doc_id long, text string")
    kept = {r.doc_id for r in simhash.drop_similar(docs, hot=hot, block_chars=block, segments=segments).collect()}
    assert all(2 * i in kept for i in range(len(pairs)))
    similar = [2 * i + 1 not in kept for i, p in enumerate(pairs) if p[2] >= 0.8]
    assert not any(2 * i + 1 not in kept for i, p in enumerate(pairs) if p[2] < 0.8)
    assert len(similar) > 100 and np.mean(similar) >= least


def test_unrelated_documents_are_no_candidates():
    """Balls of unrelated fingerprints meet in proportion to the square of their number;
    the pairs that do are not within the candidates' bits."""
    rng = np.random.default_rng(2)
    n = 60_000
    votes, counts = rng.binomial(200, 0.5, (n, 64 * simhash.WORDS)).astype(np.int32), np.full(n, 200)
    balls = simhash.weak_balls(votes, counts, 18, 12)
    fps = np.packbits(2 * votes > counts[:, None], axis=1, bitorder="little").view("<u8")
    order = np.argsort(balls.ravel(), kind="stable")
    bucket, doc = balls.ravel()[order], np.repeat(np.arange(n), balls.shape[1])[order]
    met, closest = 0, 256
    for step in range(1, 30):
        same = bucket[step:] == bucket[:-step]
        a, b = doc[:-step][same], doc[step:][same]
        met += len(a)
        closest = min(closest, np.bitwise_count(fps[a] ^ fps[b]).sum(axis=1)[a != b].min(initial=256))
    # 16 million documents meet 70,000 times as many pairs: at 75 bits, one of 10^10 of these.
    assert met > 1_000_000 and closest > simhash.CANDIDATE_BITS + 5


def test_large_groups_are_dealt_into_blocks(spark):
    rnd = random.Random(4)
    base = words(rnd, 200)
    docs = [(i, " ".join([*base[:k], f"edit{i}", *base[k + 1 :]])) for i, k in enumerate(rnd.choices(range(200), k=60))]
    got = simhash.drop_similar(spark.createDataFrame(docs, "doc_id long, text string"), hot=8, block_chars=9000).collect()
    assert [r.doc_id for r in got] == [0] and jaccard(docs[0][1], docs[1][1]) > 0.8


def test_near_copies_share_their_links(spark):
    """Each of the 60 balls of a near copy meets the group; a forest of each bucket must not
    give links of its own."""
    rnd = random.Random(6)
    base = words(rnd, 300)
    docs = [(i, " ".join([*base[:k], f"edit{i}", *base[k + 1 :]])) for i, k in enumerate(rnd.choices(range(300), k=400))]
    rnd.shuffle(docs)
    sets = simhash.shingle_sets(spark.createDataFrame(docs, "doc_id long, text string").repartition(6)).withColumnRenamed("doc_id", "id")
    assert simhash.candidate_links(sets).distinct().count() < 3 * len(docs)


def test_simhash_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def repeat_table():
    rnd = random.Random(3)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(3000))
    rows = [(500, None), (501, ""), (502, "q" * 5000), (503, "q" * 5000), (504, "é" * 80), (505, "x" * 99), (506, "x" * 99)]
    for i in range(120):
        s = ""
        while len(s) < rnd.choice([50, 99, 100, 101, 400, 1500]):
            k = rnd.randint(0, 2900)
            s += base[k : k + rnd.randint(1, 300)] if rnd.random() < 0.7 else rnd.choice(["a" * rnd.randint(1, 400), "ab" * 90, "é" * 70, "xyz"])
        rows.append((i, s))
    return rows


@pytest.mark.parametrize(("crowded", "chunk"), [(20_000, 2_000_000), (2, 700)])
def test_repeats_equal_brute_force(spark, monkeypatch, crowded, chunk):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", chunk)
    rows = repeat_table()
    df = spark.createDataFrame([(t, i, 5) for i, t in rows], "text string, doc_id long, place int").repartition(3)
    got = repeats.remove_repeats(df, crowded=crowded).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert sorted(map(tuple, got.collect())) == repeats.brute_force(rows)


def test_repeats_of_the_query(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{d}/documents.parquet'").fetchall()
    assert sorted(map(tuple, repeats.op4_repeat_removal(spark, d).collect())) == repeats.brute_force(rows)


def test_equal_windows_of_crowded_phrases_meet_once_a_batch():
    rnd, length = random.Random(8), 100
    base = "".join(rnd.choice("abcdefgh") for _ in range(170)).encode()
    texts = [base[: 3 * i] + bytes([65 + i]) + base[3 * i + 1 :] for i in range(50)]
    marks = [[{"key": 7, "packed": (0 << 11) | ((170 - length) << 2) | 3}]] * len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([t.decode() for t in texts]), pa.array(marks, pa.list_(pa.struct([("key", pa.int64()), ("packed", pa.int64())])))], names=["doc", "text", "marks"])
    rows = pa.Table.from_batches(list(repeats._dictionary(length)(iter([batch])))).to_pylist()
    entries, runs = [r for r in rows if r["bytes"] is not None], [r for r in rows if r["bytes"] is None]
    assert sorted(r["bytes"] for r in entries) == sorted({t[p : p + length] for t in texts for p in range(71)})
    assert len(entries) + sum(r["span"] + 1 for r in runs) == 50 * 71 and len(runs) <= 100
    first = {}
    for i, t in enumerate(texts):
        for p in range(71):
            first.setdefault(t[p : p + length], (i, p))
    assert {(r["doc"], r["place"]) for r in entries} == set(first.values())


def test_phrases_that_share_a_trigger_alone_do_not_meet():
    """One trigger in 300 contexts was one key: the more texts, the more windows were dealt out one by one."""
    rnd = np.random.default_rng(5)
    some = rnd.integers(97, 123, 50_000 + repeats.W, dtype=np.uint8)
    at = np.arange(50_000)
    low = int(span_hashes(some, at, at + repeats.W).argmin())
    size = 200 + repeats.W
    texts = [np.concatenate([rnd.integers(97, 123, 100, dtype=np.uint8), some[low : low + repeats.W], rnd.integers(97, 123, 100, dtype=np.uint8)]) for _ in range(300)]
    piece, lo, hi, key, _ = repeats.phrases(np.concatenate(texts), np.arange(301) * size, 100)
    assert len(set(zip(key.tolist(), piece.tolist(), strict=True))) == len(set(key.tolist()))
    covered = sorted((p, w - p * size) for p, a, b in zip(piece.tolist(), lo.tolist(), hi.tolist(), strict=True) for w in range(a, b + 1))
    assert covered == [(p, w) for p in range(300) for w in range(size - 99)]


def test_crowded_windows_are_given_in_portions(monkeypatch):
    monkeypatch.setattr(repeats, "CROWD_BYTES", 5_000)
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abcdefgh") for _ in range(170)) for _ in range(200)]
    marks = [[{"key": 7, "packed": (70 << 2) | 3}]] * 200
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(texts), pa.array(marks, pa.list_(pa.struct([("key", pa.int64()), ("packed", pa.int64())])))], names=["doc", "text", "marks"])
    out = list(repeats._dictionary(100)(iter([batch])))
    assert sum(len(b) for b in out) == 200 * 71 and max(len(b) for b in out) < 2_500


def test_repeated_ids_and_null_ids(spark):
    rnd = random.Random(1)
    t = "".join(rnd.choice("abcdef") for _ in range(300))
    got = repeats.remove_repeats(spark.createDataFrame([(1, t), (1, t), (None, t), (2, t)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (1, 0), (1, 0), (2, 300)]
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def passages():
    rnd = random.Random(9)
    items = [(i, " ".join(words(rnd, n))) for i, n in enumerate([14, 20, 37, 55, 6, 5, 3])] + [(90, None), (91, ""), (92, "...")]
    docs = []
    for i, t in items[:7]:
        noise = lambda: " ".join(words(rnd, 40))
        docs.append((i, f"{noise()} {t.upper()}, {noise()}"))
        w = t.split()
        if len(w) >= 14:
            for k in range(3, len(w), 8):
                w[k] = "SUBSTITUTED"
            docs.append((100 + i, f"{noise()}\n{' '.join(w)}\n{noise()}"))
    docs += [(200 + k, " ".join(words(rnd, 300))) for k in range(20)] + [(300, None), (301, ""), (0, docs[0][1]), (None, docs[0][1])]
    return docs, items


def brute_overlap(doc, item):
    split = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    d, w = split(doc), split(item)
    return max((sum(1 for k in range(len(w)) if 0 <= s + k < len(d) and d[s + k] == w[k]) / len(w) for s in range(-len(w) + 1, len(d))), default=0) if w else 0


def test_passages_with_substitutions_are_found(spark):
    docs, items = passages()
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.overlap for r in decontaminate.contaminated(d, b).collect()}
    planted = {(i, i) for i in range(7)} | {(100 + i, i) for i in range(4)}
    assert planted <= set(got)
    texts = {}
    for i, t in docs:
        texts.setdefault(i, []).append(t)
    exact = {(i, j): max(brute_overlap(t, u) for t in own) for i, own in texts.items() for j, u in items if i is not None}
    assert {k: v for k, v in exact.items() if v >= 0.5 and dict(items)[k[1]].count(" ") > 11} == {k: v for k, v in got.items() if dict(items)[k[1]].count(" ") > 11}
    assert all(got[k] <= exact[k] + 1e-9 for k in got)
    # Rows without an id are judged by their texts.
    kept = decontaminate.decontaminate(d.unionByName(spark.createDataFrame([(None, "clean text", 1)], d.schema)), b).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in kept) == sorted([(i, t or "") for i, t in docs if i is not None and not any(k[0] == i for k in got)] + [(-1, "clean text")])


def test_recall_of_random_substitutions(spark):
    rnd = random.Random(21)
    items = [(i, " ".join(words(rnd, rnd.randint(12, 60)))) for i in range(300)]
    docs = []
    for rate in (10, 20, 30, 40, 45):
        for i, t in items:
            own = [f"sub{rnd.randrange(999)}" if rnd.randrange(100) < rate else w for w in t.split()]
            docs.append((1000 * rate + i, " ".join([*words(rnd, 30), *own, *words(rnd, 30)])))
    got = {(r.doc_id, r.item_id): r.overlap for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for rate in (10, 20, 30, 40, 45):
        want = {(i, i % 1000): v for i, t in docs if i // 1000 == rate and (v := brute_overlap(t, items[i % 1000][1])) >= 0.5}
        same = [got.get(k) == pytest.approx(v) for k, v in want.items()]
        assert len(want) > 100 and np.mean(same) >= (0.99 if rate <= 20 else 0.95 if rate <= 40 else 0.9), (rate, np.mean(same))


PHRASE = "which of the following statements is correct about"


@pytest.mark.parametrize("n", [40, 160])
def test_a_common_phrase_meets_no_item(spark, n):
    """Documents and items that share a phrase only: diagonals grow with the documents,
    not with the pairs, and what they hold of one item is found as before."""
    rnd = random.Random(n)
    words = lambda rnd, k: [f"w{rnd.randrange(10**5)}" for _ in range(k)]
    items = [(i, " ".join([*words(rnd, 5), PHRASE, *words(rnd, 8)])) for i in range(n)]
    docs = [(i, " ".join([*words(rnd, 30), PHRASE, *words(rnd, 30)])) for i in range(n)]
    # Eleven words of twenty: the phrase and three of the others, each next to no equal one.
    kept = lambda t, at: " ".join(w if 5 <= k < 12 or k in at else "other" for k, w in enumerate(t.split()))
    docs += [(1000 + i, " ".join([*words(rnd, 30), kept(t, {1, 3, 14, 16}), *words(rnd, 30)])) for i, t in items[:20]]
    d, b = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(items, "id long, text string")
    wanted = decontaminate._wanted(d, b, decontaminate.MASKS, len(decontaminate.MASKS), 0.5)
    assert wanted.count() < 2 * len(docs)
    got = {(r.doc_id, r.item_id): r.n_equal for r in decontaminate.contaminated(d, b, id_col="id", item_col="id").collect()}
    want = {(i, j): round(v * len(u.split())) for i, t in docs if i >= 1000 for j, u in items if (v := brute_overlap(t, u)) >= 0.5}
    assert {(1000 + i, i) for i in range(20)} <= set(want) and got == want


def test_items_that_are_mostly_a_common_phrase(spark):
    rnd = random.Random(5)
    items = [(i, f"{PHRASE} {' '.join(words(rnd, 4))}") for i in range(40)]
    docs = [(i, " ".join([*words(rnd, 20), PHRASE, *words(rnd, 20)])) for i in range(5)]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert got.count() == 5 * 40  # the phrase alone is more than half of each


def test_inserted_and_missing_words_do_not_hide_a_passage(spark):
    rnd = random.Random(6)
    items = [(i, " ".join(words(rnd, 45))) for i in range(30)]
    docs = []
    for i, t in items:
        w = t.split()
        docs.append((i, " ".join([*words(rnd, 20), *w[:15], "inserted", *w[15:30], "inserted", *w[30:], *words(rnd, 20)])))
        docs.append((100 + i, " ".join([*words(rnd, 20), *w[:14], *w[16:29], *w[30:], *words(rnd, 20)])))
    got = {(r.doc_id, r.item_id): r.n_equal for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    # A missing word may be met by chance at its place on another diagonal.
    assert set(got) == {(i, i) for i in range(30)} | {(100 + i, i) for i in range(30)}
    assert all(n == 45 if i < 100 else 42 <= n < 45 for (i, _), n in got.items())


def test_repeated_items_with_different_texts(spark):
    rnd = random.Random(7)
    a, b = " ".join(words(rnd, 20)), " ".join(words(rnd, 30))
    docs = spark.createDataFrame([(1, a), (2, b), (3, f"{a} {b}"), (4, "clean text")], "doc_id long, text string")
    got = decontaminate.contaminated(docs, spark.createDataFrame([(5, a), (5, b), (5, a)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.overlap) for r in got) == [(1, 5, 1.0), (2, 5, 1.0), (3, 5, 1.0)]


def test_long_documents_and_clashing_columns(spark, monkeypatch):
    rnd = random.Random(2)
    item = " ".join(words(rnd, 40))
    d = spark.createDataFrame([(1, " ".join([*words(rnd, 200_000), item, *words(rnd, 1000)]), 5, "x"), (2, item, 5, "x"), (3, "short", 5, "x")], "doc_id long, text string, item_key int, wanted string")
    b = spark.createDataFrame([(7, item), (7, item), (8, "other words " * 9)], "item_id long, text string")
    for most in (decontaminate.MAX_BROADCAST, 0):
        monkeypatch.setattr(decontaminate, "MAX_BROADCAST", most)
        got = sorted(map(tuple, decontaminate.contaminated(d, b).collect()))
        assert got == [(1, 7, 40, 40, 1.0, 200_000), (2, 7, 40, 40, 1.0, 0)]
        assert [r.doc_id for r in decontaminate.decontaminate(d, b).collect()] == [3]


def test_decontamination_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(d, b).count() == 0 and decontaminate.contaminated(d.where("false"), d.select(F.col("doc_id").alias("item_id"), "text")).count() == 0


def test_very_long_texts(spark):
    rnd = random.Random(8)
    long = " ".join(words(rnd, 120_000))
    rows = [(1, long), (2, long + " tail"), (3, "x" * 400_000), (4, "one two three")]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: brute_fingerprint(t) for i, t in rows if i > 2}
    assert all(got[i].fp % (1 << 64) == f for i, f in want.items()) and bin(got[1].fp ^ got[2].fp).count("1") <= 3 and got[2].component_id == 1
    assert sorted(r.doc_id for r in simhash.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [1, 3, 4]
