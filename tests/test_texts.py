"""Queries on texts that the driver's small tables don't hold, against their SQL."""

import hashlib

import duckdb
import pytest

from strandloom.operators import sequences
from strandloom.plans.catalog import ORACLES, QUERIES
from tests.compare import spark_rows, sql_rows


@pytest.fixture
def same_as_sql(spark, tmp_path):
    """Compares a query with its SQL on documents of the given texts, ids from 0."""

    def compare(name, texts):
        rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet", mode="overwrite")
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        found = spark_rows(QUERIES[name](spark, str(tmp_path)))
        assert found == sql_rows(con, ORACLES[name])[1]
        return found

    return compare


def test_frequencies_that_are_ties_round_as_in_sql(same_as_sql):
    """164 / 2560 is 0.0640625, of which the product with a million is below the tie."""
    rows = same_as_sql("a19_kmer_frequencies", ["H" * 83 + "f" * 1198, "one of 3-letter words"])
    assert ("0", repr("0.064062").strip("'"), repr("AAA"), "164") in rows


@pytest.mark.parametrize("name", ["a19_kmer_frequencies", "s11_stockholm", "s11_alignment_depth"])
def test_empty_and_short_texts(same_as_sql, name):
    assert same_as_sql(name, ["", "x", "xy", "", "several words"])


def test_place_hashes_are_md5_of_many_rows_at_once(monkeypatch):
    """A call a letter took 1.4 microseconds."""
    monkeypatch.setattr(sequences, "PLACES", 300)
    heads, sizes = ["gc:1", "m", "x" * 38, "y" * 39, "é", "", "gc:7"], [5, 1003, 200, 150, 299, 3, 0]
    got = list(sequences._place_hashes(heads, sizes))
    for (one, other), head, n in zip(got, heads, sizes, strict=True):
        whole = [hashlib.md5(f"{head}:{p}".encode()).digest() for p in range(n)]
        assert [a.to_bytes(8, "big") + b.to_bytes(8, "big") for a, b in zip(one.tolist(), other.tolist(), strict=True)] == whole


@pytest.mark.parametrize("name", ["e13_mono_shuffle", "e13_gc_matched"])
def test_decoys_of_texts_of_many_lengths(same_as_sql, name):
    assert len(same_as_sql(name, ["a", "bc", "x" * 600, "some words, é and more\n" * 300])) == 4


def test_match_columns_of_whole_texts(same_as_sql):
    """Random sequences of up to 2,048 letters stood for the texts."""
    rows = same_as_sql("c02_match_columns", ["abc " * 700, *["x", "some words"] * 30])
    assert max(len(r[0]) for r in rows) > 4_000
