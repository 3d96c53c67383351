"""Tokenizer operators against the public libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandloom.llm import bpe, bpe_codec, textbatch, token_counts, token_files

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    (5, "Hello world, it's we'll they've 'tis O'sullivan 123 ４５ x² \n\n  two  spaces\t\ttab  nbsp em"), (3, None), (4, ""), (9, " "), (8, "\n \n"), (7, "中文字符 mit deutschen Wörtern 😀😀"),
    (6, "<|endoftext|>a<|endoftext|> b"), (2, "a" * 5000), (2, "a" * 5000), (None, "no id"), (10, "the " * 20000), (11, "''s 's 'S \n's x's'll"), (12, "\x1c\x1d\x85 ​﻿"),
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, ids string, n_tokens int")


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tuple(map(str, r[1:]))))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=4))
def test_batches_equal_both_libraries(texts):
    global _tik, _lib
    if "_tik" not in globals():
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
        _tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _lib = Tokenizer.from_file(JSON)
    texts = [t for t in texts if t.isprintable() or all(ord(c) < 0x3000 for c in t)]
    w = textbatch.Words(texts)
    for merges, want in ((bpe.load_ranks(RANKS), [_tik.encode_ordinary(t) for t in texts]), (bpe.load_json(JSON)[0], [e.ids for e in _lib.encode_batch(texts, add_special_tokens=False)])):
        ids, counts = bpe.merge_words(w.blob, w.sizes, merges)
        flat = bpe.expand(ids, np.cumsum(counts) - counts, counts, w.parse)
        assert flat.tolist() == [i for x in want for i in x]


def test_words_are_distinct_across_chunks(monkeypatch):
    monkeypatch.setattr(textbatch, "CHUNK_CHARS", 50)
    rnd = random.Random(0)
    texts = [" ".join(rnd.choice(["alpha", "beta", "gamma-delta"]) for _ in range(9)) for _ in range(40)]
    w = textbatch.Words(texts)
    words = [bytes(x).decode() for x in np.split(w.blob, np.cumsum(w.sizes)[:-1])]
    assert len(set(words)) == len(words) <= 9
    assert ["".join(words[k] for k in p) for p in np.split(w.parse, np.cumsum(w.doc_counts)[:-1])] == texts


def test_counts(spark, library):
    got = token_counts.count_tokens(docs(spark), tokenizer_path=JSON)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in TEXTS]
    assert order(map(tuple, got.collect())) == order(want)


def test_codec_round_trip(spark, tik):
    for n in (1, 7):
        got = bpe_codec.digests(bpe_codec.decode(bpe_codec.encode(docs(spark), ranks_path=RANKS, n_buckets=n), ranks_path=RANKS))
        want = []
        for i, t in TEXTS:
            ids = tik.encode_ordinary(t or "")
            want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
        assert order(map(tuple, got.collect())) == order(want)


def test_packing_round_trips():
    for a in ([], [0], [255, 256, 65536, 2**31], list(range(1000))):
        assert bpe_codec.unpack(bpe_codec.pack(np.array(a, np.int64))).tolist() == a


def test_token_files(spark, library, tmp_path):
    path = str(tmp_path / "orc")
    token_files.write_token_files(docs(spark), path, tokenizer_path=JSON)
    back = token_files.read_token_files(spark, path, docs(spark).schema["doc_id"].dataType)
    got = token_files.id_checksums(back).collect()
    start, want = 0, []
    for i, t in sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert back.where("doc_id = 7").count() == 1


def scanned_rows(df):
    """Rows that the ORC reader of an executed plan gave."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []
    leaves = plan.collectLeaves()
    for i in range(leaves.size()):
        m = leaves.apply(i).metrics().get("numOutputRows")
        if m.isDefined():
            found.append(m.get().value())
    return sum(found)


def test_token_files_are_indexed(spark, tmp_path):
    """A filter on the id reads one row group by the index, and none by the Bloom filter
    where the id lies inside a group's range but isn't in it."""
    import pyarrow.orc as orc

    path = str(tmp_path / "orc")
    rows = spark.range(0, 120_000, 2).selectExpr("id AS doc_id", "concat('text of document ', id) AS text").coalesce(1)
    token_files.write_token_files(rows, path, tokenizer_path=JSON, stripe_bytes=1 << 16)
    parts = sorted((tmp_path / "orc").glob("part-*.orc"))
    f = orc.ORCFile(str(parts[0]))
    assert f.row_index_stride == 10_000 and "ids" in f.schema.names and f.compression == "ZSTD"
    total = sum(orc.ORCFile(str(p)).nrows for p in parts)
    assert total == 60_000
    read = lambda cond: spark.read.orc(path).where(cond).select("doc_id", "n_tokens")
    with_aqe = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        one, none = read("doc_id = 70000"), read("doc_id = 70001")
        assert one.count() == 1 and 0 < scanned_rows(one) <= 10_000
        assert none.count() == 0 and scanned_rows(none) < scanned_rows(one)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", with_aqe)


def test_empty_tables(spark, tmp_path):
    none = docs(spark, [])
    assert token_counts.count_tokens(none, tokenizer_path=JSON).count() == 0
    assert bpe_codec.encode(none, ranks_path=RANKS).count() == 0
    token_files.write_token_files(none, str(tmp_path / "e"), tokenizer_path=JSON)
    assert token_files.read_token_files(spark, str(tmp_path / "e"), none.schema["doc_id"].dataType).count() == 0


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


STRUCTURED = [(20 + k, f"{w}\n{w.translate(str.maketrans('ab', 'ba'))}") for k, w in enumerate(map(thue_morse, (1024, 4096)))]


def expected(encode, rows):
    out = []
    for i, t in rows:
        ids = encode(t or "")
        out.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return out


@pytest.mark.parametrize("weak", [False, True])
def test_words_of_one_hash_stay_apart(spark, library, tik, monkeypatch, weak):
    """Structured words, and every word under a hash of three bits."""
    if weak:
        monkeypatch.setattr(textbatch, "mix", lambda h: h & np.uint64(7))
    rows = TEXTS + STRUCTURED
    texts = [t or "" for _, t in rows]
    w = textbatch.Words(texts)
    words = [bytes(x) for x in np.split(w.blob, np.cumsum(w.sizes)[:-1])]
    assert len(set(words)) == len(words)
    assert ["".join(words[k].decode() for k in p) for p in np.split(w.parse, np.cumsum(w.doc_counts)[:-1])] == texts
    token_counts._cache.cache_clear()
    token_files._cache.cache_clear()
    for _ in range(2):  # with an empty and a filled cache
        assert token_counts.count_batch(texts, JSON).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
        ids, n = token_files.encode_batch(texts, JSON, 2)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    merges = bpe.load_ranks(RANKS)
    known = bpe.WordCache(lambda blob, sizes: bpe.merge_words(blob, sizes, merges), limit=9)
    for _ in range(3):
        ids, starts, counts = known.look(w.hashes, w.blob, w.sizes)
        flat = bpe.expand(ids, starts, counts, w.parse).tolist()
        assert flat == [i for t in texts for i in tik.encode_ordinary(t)]
    token_counts._cache.cache_clear()
    token_files._cache.cache_clear()


def test_structured_words_through_the_codec(spark, tik):
    got = bpe_codec.digests(bpe_codec.decode(bpe_codec.encode(docs(spark, STRUCTURED), ranks_path=RANKS), ranks_path=RANKS))
    assert sorted(map(tuple, got.collect())) == expected(tik.encode_ordinary, STRUCTURED)


def test_registered_queries_equal_the_libraries(spark, library, tik):
    import duckdb

    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()
    assert sorted(map(tuple, bpe_codec.op7_bpe_codec(spark, sf).collect())) == expected(tik.encode_ordinary, rows)
    plain = [library.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    counts = [(i, len((t or "").encode()), len(x), len(x) > 1024) for (i, t), x in zip(rows, plain, strict=True)]
    assert sorted(map(tuple, token_counts.op8_token_counts(spark, sf).collect())) == counts
    start, want = 0, []
    for (i, _), x in zip(rows, plain, strict=True):
        want.append((i, start, len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())))
        start += len(x) + 1
    assert sorted(map(tuple, token_files.op10_token_files(spark, sf).collect())) == want


def test_decoding_in_slices(spark, tik, monkeypatch):
    monkeypatch.setattr(bpe_codec, "SLICE_WORDS", 40)
    tokens = bpe_codec.encode(docs(spark), ranks_path=RANKS)
    assert order(map(tuple, bpe_codec.digests(bpe_codec.decode(tokens, ranks_path=RANKS)).collect())) == order(expected(tik.encode_ordinary, TEXTS))
