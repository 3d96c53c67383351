"""License scan and quality rules on small tables with defined results."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandloom.llm import licenses, quality
from tests.compare import connect, spark_rows, sql_rows

EDGE = [
    (1, None), (2, ""), (3, "Released under the MIT License. Released UNDER the mit, license!"), (4, "apache license version 2"), (5, "under the mit licence"),
    (6, "x " * 30000 + "CC-BY-NC 4.0"), (6, "x " * 30000 + "CC-BY-NC 4.0"), (None, "cc by nc"), (8, "lKcense under the Kmit license"), (9, "under the mit"),
    (10, "cc cc by nc by nc"), (11, "This work is licensed under the GNU General Public License, version 3."), (12, "été under the mit licenseé"),
]
SCHEMA = "doc_id long, text string, words int, hits string, spans string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], SCHEMA)


def brute_license(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    found = [(s, label) for label, p in (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")) for s in range(len(w)) if w[s : s + len(p.split())] == p.split()]
    starts = [s for s, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_license_base_on_edge_cases(spark):
    got = licenses.scan_licenses(table(spark, EDGE)).collect()
    key = lambda r: (r[0] is not None, r[0] or 0)
    want = sorted(((i, *brute_license(t)) for i, t in EDGE), key=key)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=key) == want
    by = {r.doc_id: r for r in got}
    assert by[11].labels == "gpl-3" and by[11].base_labels == "" and by[1].score == 0 and by[3].score == 1
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) for r in got if r.base_labels)


def test_license_empty_table(spark):
    assert licenses.scan_licenses(table(spark, [])).count() == 0


def test_license_equals_sql(spark):
    con = connect("/root/testdata/sf0.001")
    df = licenses.op1_license_scan(spark, "/root/testdata/sf0.001")
    columns, rows = sql_rows(con, licenses.ORACLE_SQL)
    assert sorted(df.columns) == columns and spark_rows(df) == rows


def brute_counts(x):
    w = re.findall(r"[^\x20\x09-\x0D]+", x or "")
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(win)
    covered = {i + k for i, q in enumerate(win) if c[q] > 1 for k in range(3)}
    lines = [y for y in (x or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x or "")), len(lines) - len(set(lines)), len(covered)


TEXTS = [(1, None), (2, ""), (3, " \n\t"), (4, "a b c a b c d"), (5, "\n".join(["x y", "x y", "", "z"])), (6, "é#ü $" * 40), (7, "w " * 40000), (11, " ".join(f"v{i}" for i in range(32_700)) + " a b c d a b c"), (12, " ".join(f"v{i}" for i in range(32_900)) + " a b c d a b c"), (8, "a a a a"), (8, "a a a a"), (None, "one two"), (9, " ".join(f"w{i % 70}" for i in range(200)))]


@pytest.mark.parametrize("most", [quality.MAX_BROADCAST, 0])
def test_quality_counts(spark, monkeypatch, most):
    monkeypatch.setattr(quality, "MAX_BROADCAST", most)
    docs = table(spark, TEXTS)
    trusted = spark.createDataFrame([(9,), (9,), (None,)], "doc_id long")
    got = quality.quality_rules(docs, trusted).collect()
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=key) == sorted(((i, *brute_counts(t)) for i, t in TEXTS), key=key)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_windows_of_one_short_hash_stay_apart(spark):
    """Hashes that agree in their low 49 bits only: the packed sort sees them, whole hashes decide."""
    high = 1 << 52
    for w in ([5, 5 + high, 9, 9], [5, 5 + high, 5, 9], [5, 5 + high, 7, 7, 9], [3, 3, 3, 8], [1, 2]):
        df = spark.createDataFrame([(w,)], "w array<long>").withColumn("p", quality.repeated_places(F.col("w")))
        got = df.select(quality.repeated_words(F.col("w"), F.col("p"))).first()[0]
        assert got == len({i + k for i, h in enumerate(w) if w.count(h) > 1 for k in range(3)}), w


def test_quality_score_is_the_mean_log_ratio(spark):
    docs = [(i, " ".join(f"w{(i * 7 + k * k) % 23}" for k in range(60))) for i in range(12)]
    got = {r.doc_id: r.llr for r in quality.quality_rules(table(spark, docs), spark.createDataFrame([(i,) for i in range(0, 12, 3)], "id long"), n_buckets=64).collect()}
    h = {r.w: r.h for r in spark.createDataFrame([(f"w{i}",) for i in range(23)], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    pairs = {(r.a, r.b): r.h for r in spark.createDataFrame([(a, b) for a in h for b in h], "a string, b string").select("a", "b", F.xxhash64(F.xxhash64("a"), F.xxhash64("b")).alias("h")).collect()}
    grams = {i: [h[w] % 64 for w in t.split()] + [pairs[p] % 64 for p in zip(t.split(), t.split()[1:], strict=False)] for i, t in docs}
    raw = Counter(b for g in grams.values() for b in g)
    target = Counter(b for i, g in grams.items() if i % 3 == 0 for b in g)
    ratio = quality.log_ratios([target[b] for b in range(64)], [raw[b] for b in range(64)])
    for i, g in grams.items():
        assert got[i] == pytest.approx(sum(ratio[b] for b in g) / len(g))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_quality_verdict_against_labels(spark, sf):
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    rows = quality.op2_quality_rules(spark, f"/root/testdata/{sf}").where("not base_failed").join(labels, "doc_id").collect()
    junk = [r.kept for r in rows if r.quality == 0]
    good = [r.kept for r in rows if r.quality == 1 and not r.toxic]
    assert len(junk) > 20 and sum(junk) <= 0.02 * len(junk)
    assert len(good) > 200 and sum(good) >= 0.99 * len(good)


def test_quality_verdict_on_labels_it_has_not_seen(spark):
    """Target, threshold and raw counts from even ids only count as labels; odd ids are judged."""
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    even = labels.where("doc_id % 2 = 0")
    got = quality.quality_rules(spark.read.parquet(f"{d}/documents.parquet"), quality.trusted_ids(even), junk=quality.junk_ids(even))
    rows = got.where("not base_failed").join(labels.where("doc_id % 2 = 1"), "doc_id").select("kept", "quality", "toxic").collect()
    junk = [r.kept for r in rows if r.quality == 0]
    good = [r.kept for r in rows if r.quality == 1 and not r.toxic]
    print("held out: kept", sum(junk), "of", len(junk), "junk,", sum(good), "of", len(good), "good")
    assert len(junk) > 50 and sum(junk) <= 0.05 * len(junk)
    assert len(good) > 500 and sum(good) >= 0.97 * len(good)


def test_quality_cut():
    assert quality.best_cut({-90: (0, 5), -60: (1, 0), -40: (9, 1)}) == pytest.approx(-0.089)
    assert quality.best_cut({-90: (0, 5)}) is None and quality.best_cut({}) is None


def test_quality_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert quality.quality_rules(table(spark, []), none).count() == 0
    assert quality.quality_rules(table(spark, TEXTS), none).count() == len(TEXTS)


def test_native_operators_run_no_python(spark):
    docs = table(spark, TEXTS)
    for df in (licenses.scan_licenses(docs), quality.quality_rules(docs, docs.select("doc_id"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
