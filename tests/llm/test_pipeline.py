"""The pipeline held against its operators' plain versions, stage by stage."""

import hashlib

import public_tokenizers as P
import pytest

import corpus_pipeline
from strandloom.llm import language, pii
from tests.llm.test_search import brute_kept, brute_overlap
from tests.llm.test_tokens import RANKS

SF = "/root/testdata/sf0.001"


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "pii", "encoding"]


def test_pipeline_equals_brute_force(spark):
    import base64

    import tiktoken

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs.where(~language.held_out()))
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    lang, _, rejected = model.predict([t or "" for _, t in rows])
    rows = [r for r, x in zip(rows, rejected, strict=True) if not x]
    first = set(brute_kept(rows))
    rows = [r for r in rows if r[0] in first]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in rows if not any(brute_overlap(t, x) >= 0.5 for x in items)]
    crf = pii.train(sorted(pii.labelled_sentences()))
    _, spans = pii.all_spans([t for _, t in rows], crf)
    rows = [(i, pii.redacted(t, s)) for (i, t), s in zip(rows, spans, strict=True)]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in rows:
        ids = enc.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(want)


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns_of_clashing_names(spark, k):
    """Extra columns called like results or helpers of the operators come back unharmed."""
    names = ["score", "lang_pred", "rejected", "fp1", "component", "n", "id", "wanted", "item_id", "spans", "base", "found"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", *(f"concat('{c}', doc_id) AS {c}" for c in names))
    out = corpus_pipeline.STAGES[k][1](spark, docs, SF)
    assert out.columns == docs.columns
    rows = out.select("doc_id", *names).collect()
    assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in names)


@pytest.mark.parametrize("k", range(5))
def test_stages_take_edge_rows(spark, k):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    edge = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", None, 0), (10**6 + 1, "", "en", None, 0), (None, "a text without an id", "en", "s", 20)], docs.schema)
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs.unionByName(edge), SF)
    assert out.count() > 0
    if k < 4:
        assert out.columns == docs.columns
    assert stage(spark, docs.where("false"), SF).count() == 0
