"""Queries on loci and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import loci as L
from strandloom.operators import intervals as I
from strandloom.plans import views as V
from strandloom.plans.registry import query
from strandloom.session import table

_EX = "EXISTS (SELECT 1 FROM known k WHERE k.acc = c.acc AND c.lo - {f} <= k.hi AND k.lo <= c.hi + {f})"


@query("f05_f06_normalised_loci", V.with_views("loci", "SELECT locus_id, regexp_replace(accession, '\\.\\d+$', '') AS acc, least(lo1, hi1) AS lo, greatest(lo1, hi1) AS hi, CASE WHEN lo1 > hi1 THEN -1 ELSE 1 END AS strand FROM loci"))
def f05(spark, d):
    return V.loci(spark, d).select("locus_id", L.strip_version("accession").alias("acc"), L.lower_end("lo1", "hi1").alias("lo"), L.upper_end("lo1", "hi1").alias("hi"), L.strand_of("lo1", "hi1").alias("strand"))


_MERGE = """m AS (SELECT acc, lo, hi, sum(new) OVER (PARTITION BY acc ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN max(hi) OVER w IS NULL OR lo > max(hi) OVER w + {a} THEN 1 ELSE 0 END AS new FROM known WINDOW w AS (PARTITION BY acc ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
merged AS (SELECT acc, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM m GROUP BY acc, island)"""


@query("w01_interval_merge", V.with_views("known", "WITH " + _MERGE.format(a=1) + " SELECT * FROM merged"))
def w01(spark, d):
    return I.merge_intervals(V.known(spark, d))


@query("w01_half_open_union", V.with_views("known", "WITH " + _MERGE.format(a=0) + " SELECT * FROM merged"))
def w01b(spark, d):
    return I.merge_intervals(V.known(spark, d), adjacent=False)


@query("j01_interval_mask", V.with_views("known candidates", f"SELECT DISTINCT locus_id FROM candidates c WHERE {_EX.format(f=50)}"))
def j01(spark, d):
    return I.masked_ids(V.candidates(spark, d), V.known(spark, d), flank=50)


@query("j02_exact_match", V.with_views("known candidates", "SELECT DISTINCT locus_id FROM candidates c SEMI JOIN known k USING (acc, lo, hi)"))
def j02(spark, d):
    return I.exact_ids(V.candidates(spark, d), V.known(spark, d))


@query("j03_mask_report", V.with_views("known candidates", f"""SELECT status, count(*) AS n, count(*) FILTER (WHERE {_EX.format(f=50)}) AS n_masked, count(*) FILTER (WHERE {_EX.format(f=0)}) AS n_overlap,
count(*) FILTER (WHERE EXISTS (SELECT 1 FROM known k WHERE k.acc = c.acc AND k.lo = c.lo AND k.hi = c.hi)) AS n_exact FROM candidates c GROUP BY status"""))
def j03(spark, d):
    return I.mask_report(V.candidates(spark, d), V.known(spark, d), flank=50, by="status")


@query("j04_leakage_class", V.with_views("known candidates", f"""SELECT leakage, count(*) AS n FROM (SELECT CASE WHEN {_EX.format(f=0)} THEN 'overlap' WHEN acc IN (SELECT acc FROM known) THEN 'host_only' ELSE 'independent' END AS leakage FROM candidates c) GROUP BY leakage"""))
def j04(spark, d):
    return I.leakage_class(V.candidates(spark, d), V.known(spark, d)).groupBy("leakage").agg(F.count(F.lit(1)).alias("n"))


@query("j21_best_overlap", V.with_views("known candidates", """WITH k AS (SELECT *, concat(acc, ':', lo, '-', hi) AS known_id FROM known), c AS (SELECT DISTINCT locus_id, acc, lo, hi FROM candidates),
p AS (SELECT locus_id, known_id, least(c.hi, k.hi) - greatest(c.lo, k.lo) + 1 AS inter, (least(c.hi, k.hi) - greatest(c.lo, k.lo) + 1)::DOUBLE / (greatest(c.hi, k.hi) - least(c.lo, k.lo) + 1) AS iou FROM c JOIN k ON c.acc = k.acc AND c.lo <= k.hi AND k.lo <= c.hi),
b AS (SELECT *, row_number() OVER (PARTITION BY locus_id ORDER BY iou DESC, inter DESC, known_id DESC) AS r FROM p)
SELECT c.locus_id, known_id, inter, round(iou, 6) AS iou FROM c LEFT JOIN b ON b.locus_id = c.locus_id AND r = 1"""))
def j21(spark, d):
    known = V.known(spark, d).withColumn("known_id", F.concat("acc", F.lit(":"), F.col("lo").cast("string"), F.lit("-"), F.col("hi").cast("string")))
    spans = V.candidates(spark, d).select("locus_id", "acc", "lo", "hi").distinct()
    return I.best_overlap(spans, known, id_col="locus_id", right_id="known_id").withColumn("iou", F.round("iou", 6))


@query("a21_residual_contamination", V.with_views("known candidates", f"""SELECT count(*) AS n, count(*) FILTER (WHERE NOT {_EX.format(f=0)}) AS n_free, round((count(*) FILTER (WHERE NOT {_EX.format(f=0)}))::DOUBLE / nullif(count(*), 0), 6) AS fraction FROM candidates c"""))
def a21(spark, d):
    c = V.candidates(spark, d)
    ids = I.masked_ids(c, V.known(spark, d), flank=0).withColumn("m", F.lit(1))
    j = c.join(ids, "locus_id", "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("m").isNull()).alias("n_free"))
    return j.select("n", "n_free", F.round(F.try_divide("n_free", "n"), 6).alias("fraction"))


@query("s03_locus_names", V.with_views("loci", "SELECT locus_id, CAST(CASE WHEN flag = 'R' THEN NULL ELSE 'fam' END AS VARCHAR) AS family, regexp_replace(accession, '\\.\\d+$', '') AS acc, CAST(regexp_extract(accession, '(\\d+)$', 1) AS INTEGER) AS version, least(lo1, hi1) AS lo, greatest(lo1, hi1) AS hi, CASE WHEN lo1 > hi1 THEN -1 ELSE 1 END AS strand FROM loci"))
def s03(spark, d):
    named = V.loci(spark, d).withColumn("header", F.concat(F.when(F.col("flag") == "R", ">").otherwise("fam|"), "accession", F.lit(":"), F.col("lo1").cast("string"), F.lit("-"), F.col("hi1").cast("string")))
    return named.select("locus_id", *[c.alias(k) for k, c in L.locus_name("header").items()])


@query("f15_namespace_report", V.with_views("loci", """WITH a AS (SELECT DISTINCT accession AS k FROM loci WHERE flag = 'A'), r AS (SELECT DISTINCT regexp_replace(accession, '\\.\\d+$', '') AS k FROM loci WHERE flag = 'R')
SELECT (SELECT count(*) FROM a) AS n_keys, (SELECT count(*) FROM a SEMI JOIN r USING (k)) AS as_is, (SELECT count(*) FROM (SELECT DISTINCT regexp_replace(k, '\\.\\d+$', '') AS k FROM a) x SEMI JOIN r USING (k)) AS normalised"""))
def f15(spark, d):
    """Can the candidates' keys address the mask at all, as they are or stripped?"""
    all_loci = V.loci(spark, d)
    a = all_loci.where("flag = 'A'").select(F.col("accession").alias("k")).distinct()
    r = all_loci.where("flag = 'R'").select(L.strip_version("accession").alias("k")).distinct()
    hit = r.withColumn("hit", F.lit(1))
    raw = a.join(hit, "k", "left").agg(F.count(F.lit(1)).alias("n_keys"), F.count("hit").alias("as_is"))
    norm = a.select(L.strip_version("k").alias("k")).distinct().join(r, "k", "left_semi").agg(F.count(F.lit(1)).alias("normalised"))
    return raw.join(norm, F.lit(True))


@query("e31_candidate_outcomes", V.with_views("known candidates", f"""SELECT status, outcome, count(*) AS n FROM (SELECT status, CASE WHEN lo % 97 = 0 THEN 'refused' WHEN {_EX.format(f=50)} THEN 'masked' WHEN strand = -1 AND lo % 3 = 0 THEN 'spared' ELSE 'mined' END AS outcome FROM candidates c) GROUP BY status, outcome"""))
def e31(spark, d):
    """Ordered classification: no coordinates, masked, spared, mined."""
    from strandloom.operators.evidence import classify_candidates

    c = V.candidates(spark, d).withColumn("has_locus", F.col("lo") % 97 != 0).withColumn("spared", (F.col("strand") == -1) & (F.col("lo") % 3 == 0))
    ids = I.masked_ids(c, V.known(spark, d), flank=50)
    return classify_candidates(c, ids, id_col="locus_id").groupBy("status", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("w14_control_windows", V.with_views("known candidates", """WITH hosts AS (SELECT acc, max(hi) AS len FROM known GROUP BY acc),
w AS (SELECT c.locus_id, c.acc, c.hi - c.lo AS span, ('0x' || substr(md5(concat('w14:', c.locus_id)), 1, 13))::BIGINT % (len - (c.hi - c.lo)) + 1 AS lo FROM (SELECT DISTINCT locus_id, acc, lo, hi FROM candidates) c JOIN hosts USING (acc) WHERE len > c.hi - c.lo)
SELECT locus_id, acc, lo, lo + span AS hi FROM w c WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.acc = c.acc AND c.lo <= k.hi AND k.lo <= c.lo + c.span)"""))
def w14(spark, d):
    """Length-matched windows at hash-drawn places of the host that avoid known loci."""
    known = V.known(spark, d)
    hosts = known.groupBy("acc").agg(F.max("hi").alias("len"))
    return I.control_windows(V.candidates(spark, d), hosts, known, id_col="locus_id", seed="w14")


@query("s16_known_locus_union", """SELECT source, count(*) AS n, count(DISTINCT accession) AS n_acc FROM (SELECT 'union' AS source, concat('ACC', l_suppkey) AS accession, l_partkey AS lo, l_orderkey AS hi FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'own', concat('ACC', s_suppkey), CASE WHEN s_nationkey % 2 = 0 THEN NULL ELSE s_suppkey END, s_suppkey + 10 FROM supplier) WHERE lo IS NOT NULL AND hi IS NOT NULL GROUP BY source""")
def s16(spark, d):
    """Known loci of two sources, rows with full coordinates only."""
    a = table(spark, d, "lineitem").where("l_returnflag = 'R'").selectExpr("'union' AS source", "concat('ACC', l_suppkey) AS accession", "l_partkey AS lo", "l_orderkey AS hi")
    b = table(spark, d, "supplier").selectExpr("'own' AS source", "concat('ACC', s_suppkey) AS accession", "if(s_nationkey % 2 = 0, NULL, s_suppkey) AS lo", "s_suppkey + 10 AS hi")
    return a.unionByName(b).dropna(subset=["lo", "hi"]).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("accession").alias("n_acc"))
