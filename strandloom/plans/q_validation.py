"""Queries for gates, censuses and populations."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import admission as A
from strandloom.operators import cohorts as H
from strandloom.functions import loci as L
from strandloom.operators import validation as C
from strandloom.plans import views as V
from strandloom.plans.registry import query
from strandloom.session import table

def _n():
    return F.count(F.lit(1))



@query("f01_parse_gate", "SELECT count(*) AS n_rows, 5::BIGINT AS n_columns, count(*) = (SELECT max(doc_id) + 1 FROM documents) AS ok FROM documents")
def f01(spark, d):
    docs = table(spark, d, "documents")
    expected = docs.agg(F.max("doc_id") + 1).first()[0]
    return C.parse_gate(docs, rows=expected, columns=5)


_CELL = "CASE WHEN p_partkey % 50 = 0 THEN '0' WHEN p_partkey % 77 = 0 THEN ' ' WHEN p_partkey % 91 = 0 THEN 'x7' ELSE {c} END"


@query("f02_sentinel_numbers", f"SELECT p_partkey, nullif(TRY_CAST(trim(c) AS BIGINT), 0) AS value, c IS NOT NULL AND trim(c) <> '' AND TRY_CAST(trim(c) AS BIGINT) IS NULL AS junk FROM (SELECT p_partkey, {_CELL.format(c='CAST(p_size AS VARCHAR)')} AS c FROM part)")
def f02(spark, d):
    value, junk = L.sentinel_number("c", 0)
    return table(spark, d, "part").selectExpr("p_partkey", f"{_CELL.format(c='cast(p_size AS string)')} AS c").select("p_partkey", value.alias("value"), junk.alias("junk"))


@query("f03_vocabulary", "SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('view', 'click', 'signup') GROUP BY event_type")
def f03(spark, d):
    allowed = spark.createDataFrame([("view",), ("click",), ("signup",)], "w string")
    return C.outside_vocabulary(table(spark, d, "events"), "event_type", allowed)


@query("f04_null_tokens", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE c_mktsegment END AS segment, CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS flag FROM customer")
def f04(spark, d):
    c = table(spark, d, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 8 = 3 THEN 'NaN' WHEN c_custkey % 8 = 7 THEN ' None ' ELSE concat(' ', c_mktsegment) END AS seg", "CASE c_custkey % 4 WHEN 0 THEN 'True' WHEN 1 THEN 'no' WHEN 2 THEN '<NA>' ELSE '' END AS tok")
    return c.select("c_custkey", L.clean_null("seg").alias("segment"), L.tri_state("tok").alias("flag"))


_REASONS = [("empty_id", "l_orderkey % 61 = 0"), ("masked", "l_partkey % 7 = 0"), ("control", "l_suppkey % 11 = 0"), ("short", "l_quantity < 3"), ("long", "l_quantity > 48"), ("alphabet", "l_linenumber = 5")]
_REASON_SQL = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in _REASONS) + " ELSE 'admitted' END"


@query("f10_pool_admission", f"SELECT reason, count(*) AS n FROM (SELECT {_REASON_SQL} AS reason FROM lineitem) GROUP BY reason")
def f10(spark, d):
    rules = [(n, F.expr(c)) for n, c in _REASONS]
    return table(spark, d, "lineitem").select(C.first_reason(rules).alias("reason")).groupBy("reason").agg(_n().alias("n"))


@query("f10_duplicate_ids", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def f10b(spark, d):
    return C.duplicates(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("f11_eligibility", "SELECT source, refusal, count(*) AS n FROM (SELECT source, CASE WHEN quality IS NULL THEN 'unlabelled' WHEN toxic = 1 THEN 'toxic' WHEN n_chars < 200 THEN 'short' WHEN lang <> 'en' THEN 'language' ELSE 'eligible' END AS refusal FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY source, refusal")
def f11(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", "n_chars", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    rules = [("unlabelled", F.expr("quality IS NULL")), ("toxic", F.expr("toxic = 1")), ("short", F.expr("n_chars < 200")), ("language", F.expr("lang <> 'en'"))]
    return A.refusal_census(rows, rules, kept="eligible", by=["source"])


@query("f12_host_admission", V.with_views("splits", """WITH held AS (SELECT DISTINCT genus FROM splits WHERE heldout), hp AS (SELECT phylum FROM clades GROUP BY phylum HAVING count(*) < 250)
SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN family = 'MACHINERY' THEN 'unresolved' WHEN genus IN (SELECT genus FROM held) THEN 'heldout_genus' WHEN phylum IN (SELECT phylum FROM hp) THEN 'heldout_phylum' ELSE 'admitted' END AS verdict FROM clades) GROUP BY verdict"""))
def f12(spark, d):
    """Unresolvable lineage first, then each held-out rank."""
    c = V.clades(spark, d)
    genera = V.splits(spark, d).where("heldout").select("genus").distinct().withColumn("hg", F.lit(True))
    phyla = c.groupBy("phylum").agg(_n().alias("k")).where("k < 250").select("phylum", F.lit(True).alias("hp"))
    rules = [("unresolved", F.expr("family = 'MACHINERY'")), ("heldout_genus", F.col("hg")), ("heldout_phylum", F.col("hp"))]
    return c.join(genera, "genus", "left").join(phyla, "phylum", "left").select(C.first_reason(rules).alias("verdict")).groupBy("verdict").agg(_n().alias("n"))


@query("f13_rungs", V.with_views("splits", "SELECT record, CASE WHEN nested_train AND calib THEN 'calibration' WHEN nested_train THEN 'train' WHEN heldout THEN 'out_of_distribution' WHEN fold = 'train' THEN 'excluded' ELSE 'in_distribution' END AS rung FROM splits"))
def f13(spark, d):
    s = V.splits(spark, d)
    return H.rungs(s, fold="fold", train="train", nested="nested_train", calibration="calib", heldout="heldout").select("record", "rung")


@query("f14_hash_column", V.with_views("loci", "SELECT count(*) AS n, count(*) FILTER (WHERE regexp_full_match(h, '[0-9a-f]{64}')) AS n_hex, count(*) FILTER (WHERE flag IN ('A', 'N', 'R')) AS n_flag FROM (SELECT CASE WHEN lo1 % 10 = 0 THEN upper(sha256(locus_id)) ELSE sha256(locus_id) END AS h, flag FROM loci)"))
def f14(spark, d):
    rows = V.loci(spark, d).selectExpr("if(lo1 % 10 = 0, upper(sha2(locus_id, 256)), sha2(locus_id, 256)) AS h", "flag")
    return rows.agg(_n().alias("n"), F.count_if(F.col("h").rlike("^[0-9a-f]{64}$")).alias("n_hex"), F.count_if(F.col("flag").isin("A", "N", "R")).alias("n_flag"))


@query("f16_clauses", "SELECT source, count(*) AS n, bool_and(n_chars > 0) AS has_text, bool_and(lang IN ('en', 'fr', 'de', 'es')) AS known_lang, bool_and(n_chars < 20000) AS bounded, bool_and(n_chars > 0) AND bool_and(lang IN ('en', 'fr', 'de', 'es')) AND bool_and(n_chars < 20000) AS passed FROM documents GROUP BY source")
def f16(spark, d):
    return C.clauses(table(spark, d, "documents").select("source", "n_chars", "lang"), {"has_text": F.expr("n_chars > 0"), "known_lang": F.col("lang").isin("en", "fr", "de", "es"), "bounded": F.expr("n_chars < 20000")}, "source")


@query("f17_leak_report", V.with_views("splits", """WITH p AS (SELECT cluster_id, count(DISTINCT fold) AS folds, bool_or(nested_train) AS a, bool_or(heldout) AS h, bool_or(fold = 'test' AND nested_train) AS tt, min(calib) AS c0, max(calib) AS c1 FROM splits GROUP BY cluster_id)
SELECT (SELECT count(*) FROM p WHERE folds > 1) AS clusters_across_folds, (SELECT count(*) FROM p WHERE c0 <> c1) AS clusters_across_calib, (SELECT count(*) FROM p WHERE a AND h) AS clusters_train_and_heldout, (SELECT count(*) FROM p WHERE tt) AS clusters_test_and_train,
count(*) FILTER (WHERE calib AND fold <> 'train') AS calib_outside_train, count(*) FILTER (WHERE nested_train AND heldout) AS heldout_in_train, count(*) FILTER (WHERE nested_train AND fold <> 'train') AS train_outside_fold, count(*) FILTER (WHERE fold IS NULL OR cluster_id IS NULL) AS unassigned, count(*) - count(DISTINCT record) AS repeated_records, count(*) FILTER (WHERE fold NOT IN ('train', 'val', 'test')) AS unknown_folds FROM splits"""))
def f17(spark, d):
    return C.leak_report(V.splits(spark, d))


@query("f18_populations", V.with_views("splits", """WITH graded AS (SELECT DISTINCT cluster_id FROM splits WHERE fold = 'test'), val AS (SELECT DISTINCT cluster_id FROM splits WHERE fold = 'val'), big AS (SELECT genus FROM splits WHERE heldout GROUP BY genus HAVING count(*) >= 50)
SELECT population, count(*) AS n, count(DISTINCT cluster_id) AS n_clusters FROM (
SELECT 'train' AS population, cluster_id FROM splits WHERE nested_train AND cluster_id NOT IN (SELECT cluster_id FROM graded) AND cluster_id NOT IN (SELECT cluster_id FROM val)
UNION ALL SELECT 'selection', cluster_id FROM splits WHERE fold = 'val' UNION ALL SELECT 'graded', cluster_id FROM splits WHERE cluster_id IN (SELECT cluster_id FROM graded)
UNION ALL SELECT 'heldout', cluster_id FROM splits WHERE heldout AND genus IN (SELECT genus FROM big)) GROUP BY population"""))
def f18(spark, d):
    """Train minus selection and graded clusters; selection; graded closure; held-out orders of a minimum size."""
    p = H.populations(V.splits(spark, d), cluster="cluster_id", fold="fold", nested="nested_train", heldout="heldout", unit="genus", minimum=50)
    return p.groupBy("population").agg(_n().alias("n"), F.count_distinct("cluster_id").alias("n_clusters"))


@query("f19_background_capacity", V.with_views("contigs", "SELECT m AS margin, count(*) AS n, count(*) FILTER (WHERE length(seq) >= 2 * m + 64) AS n_fit, round(avg(length(repeat('.', length(seq)))), 6) AS mean_label FROM contigs, (VALUES (16), (64), (256), (512)) v(m) GROUP BY m"))
def f19(spark, d):
    """All-background labels, and how many records have room for a window and two margins."""
    margins = F.explode(F.array(*[F.lit(m) for m in (16, 64, 256, 512)]))
    c = V.contigs(spark, d).withColumn("labels", F.expr("repeat('.', length(seq))")).withColumn("margin", margins)
    return c.groupBy("margin").agg(_n().alias("n"), F.count_if(F.length("seq") >= 2 * F.col("margin") + 64).alias("n_fit"), F.round(F.avg(F.length("labels")), 6).alias("mean_label"))


@query("f20_covering_subset", V.with_views("clades", "SELECT record, family FROM (SELECT *, row_number() OVER (PARTITION BY family, phylum ORDER BY md5(concat('f20:', record)), record) AS r FROM clades) WHERE r <= 3"))
def f20(spark, d):
    """A small deterministic subset with a minimum of every class."""
    return H.covering_subset(V.clades(spark, d), cls=["family", "phylum"], id_col="record", minimum=3, seed="f20").select("record", "family")


@query("f20_coverage_report", V.with_views("clades", "WITH s AS (SELECT *, row_number() OVER (PARTITION BY family, phylum ORDER BY md5(concat('f20:', record)), record) <= 3 AS chosen FROM clades) SELECT family, phylum, count(*) AS n, count(*) FILTER (WHERE chosen) AS n_subset, count(*) FILTER (WHERE chosen AND record % 10 = 0) AS n_leaked, count(*) FILTER (WHERE chosen) >= least(count(*), 3) AS covered FROM s GROUP BY ALL"))
def f20b(spark, d):
    """Coverage of every class and members of the subset that another split holds."""
    c = V.clades(spark, d)
    chosen = H.covering_subset(c, cls=["family", "phylum"], id_col="record", minimum=3, seed="f20")
    return H.coverage_report(c, chosen, cls=["family", "phylum"], id_col="record", minimum=3, forbidden=c.where("record % 10 = 0"))


@query("f21_heldout_carve", """WITH j AS (SELECT d.doc_id, md5(d.text) AS h, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)), dup AS (SELECT h FROM j GROUP BY h HAVING count(*) > 1)
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN h IN (SELECT h FROM dup) THEN 'duplicate_digest' WHEN quality IS NULL THEN 'no_label' WHEN toxic = 1 THEN 'refused' ELSE 'query' END AS reason FROM j) GROUP BY reason""")
def f21(spark, d):
    j = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h")).join(table(spark, d, "labels"), "doc_id", "left")
    rules = [("no_label", F.expr("quality IS NULL")), ("refused", F.expr("toxic = 1"))]
    return A.heldout_carve(j, rules, digest="h").groupBy("reason").agg(_n().alias("n"))


@query("f22_checked_evidence", V.with_views("scored", "SELECT id, CASE WHEN s1 >= 600 THEN 'passed' ELSE 'failed' END AS status, round(s1 / 1000.0, 6)::DOUBLE AS posterior, (s1 >= 600) = (y = 1) AS agrees FROM scored"))
def f22(spark, d):
    """Posterior in [0, 1] and not NaN, status within its words, status derived again."""
    e = V.scored(spark, d).selectExpr("id", "y", "s1 / 1000D AS posterior", "if(s1 >= 600, 'passed', 'failed') AS status")
    held = A.checked_evidence(e, status="status", posterior="posterior", at_least=0.6)
    return held.select("id", "status", F.round("posterior", 6).alias("posterior"), (F.col("derived") == (F.col("y") == 1)).alias("agrees"))


_FR = "concat(CASE WHEN {c} IS NULL THEN 'n;' ELSE concat('{k}', length(CAST({c} AS VARCHAR)), ':', CAST({c} AS VARCHAR), ';') END)"
_CELLS = (("i", "o_orderkey"), ("s", "o_orderstatus"), ("s", "nullif(o_orderpriority, $$5-LOW$$)"), ("b", "o_orderkey % 2 = 0"), ("s", "CAST(o_orderkey AS VARCHAR)"))


@query("e01_record_hash", f"SELECT o_orderkey, sha256(concat({', '.join(_FR.format(k=k, c=c) for k, c in _CELLS)})) AS h FROM orders")
def e01(spark, d):
    """Kinds are tagged: an integer and the string of its digits differ."""
    return table(spark, d, "orders").select("o_orderkey", L.row_hash([F.col("o_orderkey"), F.col("o_orderstatus"), F.nullif("o_orderpriority", F.lit("5-LOW")), F.expr("o_orderkey % 2 = 0"), F.col("o_orderkey").cast("string")]).alias("h"))


@query("e01_table_digest", V.digest_sql("SELECT sha256(concat(c_custkey, ':', c_name)) AS h FROM customer"))
def e01b(spark, d):
    """Order-independent digest in three levels: buckets of hashes, then of buckets."""
    from strandloom.operators.selection import table_digest

    return table_digest(table(spark, d, "customer").select(F.expr("sha2(concat(c_custkey, ':', c_name), 256)").alias("h")))


@query("a01_composition", V.with_views("clades", "SELECT coalesce(nullif(family, 'BUILDING'), '(missing)') AS family, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM clades), 6) AS share FROM clades GROUP BY 1"))
def a01(spark, d):
    return C.census(V.clades(spark, d).withColumn("family", F.nullif("family", F.lit("BUILDING"))), "family").withColumn("share", F.round("share", 6))


@query("a09_status_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM orders), 6) AS share FROM orders GROUP BY ALL")
def a09(spark, d):
    return C.census(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority").withColumn("share", F.round("share", 6))


@query("a10_percentiles", "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.9), 4) AS p90, round(quantile_disc(o_totalprice, 0.9), 4) AS rank90, count(*) AS n FROM orders GROUP BY o_orderpriority")
def a10(spark, d):
    """Linear-interpolated and nearest-rank percentiles."""
    from strandloom.operators.statistics import linear_percentiles, nearest_rank

    o = table(spark, d, "orders").select("o_orderpriority", "o_totalprice", "o_orderkey")
    lin = linear_percentiles(o, "o_totalprice", {"p50": 0.5, "p90": 0.9}, by=["o_orderpriority"], id_col="o_orderkey")
    near = nearest_rank(o, "o_totalprice", 0.9, by=["o_orderpriority"], id_col="o_orderkey")
    return lin.join(near, "o_orderpriority").select("o_orderpriority", F.round("p50", 4).alias("p50"), F.round("p90", 4).alias("p90"), F.round("value", 4).alias("rank90"), "n")


@query("k01_total_order", V.with_views("clades", "SELECT genus, n, row_number() OVER (ORDER BY n DESC, genus) AS place FROM (SELECT genus, count(*) AS n FROM clades GROUP BY genus)"))
def k01(spark, d):
    from pyspark.sql import Window

    return V.clades(spark, d).groupBy("genus").agg(_n().alias("n")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "genus")).cast("long"))


@query("k02_top_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def k02(spark, d):
    from strandloom.operators.selection import top_per_group

    return top_per_group(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@query("k02_first_by_id", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 50")
def k02b(spark, d):
    """Sample of the first k by id: the limit is the feature."""
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").orderBy("o_orderkey").limit(50)


@query("k06_reservoir", "SELECT c_custkey FROM customer WHERE c_custkey < 1000 ORDER BY md5(concat('k06:', c_custkey)), c_custkey LIMIT 25")
def k06(spark, d):
    """Hash-ordered sample of a stream's bounded head; a sampling operator."""
    from strandloom.operators.selection import reservoir

    return reservoir(table(spark, d, "customer").select("c_custkey"), "c_custkey", head=1000, k=25, seed="k06")


@query("u02_set_equality", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'missing' ELSE 'extra' END AS side FROM (SELECT DISTINCT o_custkey AS k FROM orders) a FULL JOIN (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey % 3 <> 0) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def u02(spark, d):
    return C.set_difference(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k")), "k")
