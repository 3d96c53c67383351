"""Queries on metrics, calibration, resampling and clusters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandloom.operators import cohorts as H
from strandloom.operators import metrics as M
from strandloom.operators import statistics as S
from strandloom.plans import views as V
from strandloom.plans.registry import query
from strandloom.session import cut, table

def _n():
    return F.count(F.lit(1))

_CONF = "c AS (SELECT contig % 10 AS block, cls, (cls + (p < 250)::INT) % 5 AS pred FROM positions), k AS (SELECT block, k, count(*) FILTER (WHERE cls = k AND pred = k) AS tp, count(*) FILTER (WHERE cls <> k AND pred = k) AS fp, count(*) FILTER (WHERE cls = k AND pred <> k) AS fn FROM c, (VALUES (0), (1), (2), (3), (4)) v(k) GROUP BY block, k)"


def _confusion(spark, d):
    p = V.positions(spark, d).selectExpr("contig % 10 AS block", "cls", "(cls + if(p < 250, 1, 0)) % 5 AS pred")
    return M.class_confusion(p, truth="cls", predicted="pred", by=["block"])


@query("a02_class_confusion", V.with_views("positions", f"WITH {_CONF} SELECT block, k AS cls, tp, fp, fn FROM k"))
def a02(spark, d):
    return _confusion(spark, d)


@query("a03_a04_prf_iou", V.with_views("positions", f"WITH {_CONF} SELECT k AS cls, round(sum(tp)::DOUBLE / nullif(sum(tp) + sum(fp), 0), 6) AS precision, round(sum(tp)::DOUBLE / nullif(sum(tp) + sum(fn), 0), 6) AS recall, round(2.0 * sum(tp)::DOUBLE / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 6) AS f1, round(sum(tp)::DOUBLE / nullif(sum(tp) + sum(fp) + sum(fn), 0), 6) AS iou FROM k GROUP BY k"))
def a03(spark, d):
    s = _confusion(spark, d).groupBy("cls").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return M.prf(s).select("cls", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "iou")])


@query("a05_macro_over_blocks", V.with_views("positions", f"WITH {_CONF}, f AS (SELECT block, k, 2.0 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM k) SELECT k AS cls, round(avg(f1), 6) AS macro_f1, count(f1) AS n_defined FROM f GROUP BY k"))
def a05(spark, d):
    return M.prf(_confusion(spark, d)).groupBy("cls").agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.count("f1").alias("n_defined"))


@query("a35_two_route_agreement", V.with_views("positions", f"WITH {_CONF}, a AS (SELECT k AS cls, CAST(sum(tp) AS BIGINT) AS tp FROM k GROUP BY k) SELECT cls, tp AS a_tp, tp + 1 AS b_tp, 'differs' AS side FROM a WHERE cls = 2"))
def a35(spark, d):
    """Pooled against block-summed counts, one spoiled on purpose: only it is named."""
    from strandloom.operators.taxonomy import full_join_mismatch

    pooled = M.class_confusion(V.positions(spark, d).selectExpr("1 AS one", "cls", "(cls + if(p < 250, 1, 0)) % 5 AS pred"), truth="cls", predicted="pred", by=["one"]).select("cls", "tp")
    summed = _confusion(spark, d).groupBy("cls").agg(F.sum("tp").alias("tp")).withColumn("tp", F.expr("if(cls = 2, tp + 1, tp)"))
    return full_join_mismatch(pooled, summed, "cls", ["tp"])


@query("a07_operating_points", V.with_views("scored", "SELECT t AS threshold, count(*) FILTER (WHERE y = 1 AND s1 >= t) AS tp, count(*) FILTER (WHERE y <> 1 AND s1 >= t) AS fp, count(*) FILTER (WHERE y = 1 AND s1 < t) AS fn, count(*) FILTER (WHERE y <> 1 AND s1 < t) AS tn FROM scored, (VALUES (200), (500), (800)) v(t) GROUP BY t"))
def a07(spark, d):
    return M.operating_point(V.scored(spark, d), score="s1", label="y", thresholds=[200, 500, 800])


@query("a08_class_weights", V.with_views("positions", "WITH n AS (SELECT cls, count(*) AS n FROM positions GROUP BY cls), w AS (SELECT cls, n, pow(sum(n) OVER () / n, 0.5) AS w FROM n) SELECT cls, n, round(w / avg(w) OVER (), 6) AS weight, round(n * w / sum(n * w) OVER (), 6) AS loss_share FROM w"))
def a08(spark, d):
    """Inverse-frequency weights of mean one, and each class's share of the loss."""
    return H.class_weights(V.positions(spark, d), cls="cls").select("cls", "n", F.round("weight", 6).alias("weight"), F.round("loss_share", 6).alias("loss_share"))


@query("a11_ks_statistic", V.with_views("scored", "WITH c AS (SELECT s1, count(*) FILTER (WHERE y = 1) AS a, count(*) FILTER (WHERE y = 0) AS b FROM scored GROUP BY s1) SELECT round(max(g), 9) AS ks FROM (SELECT abs(sum(a) OVER (ORDER BY s1) / sum(a) OVER () - sum(b) OVER (ORDER BY s1) / sum(b) OVER ()) AS g FROM c)"))
def a11(spark, d):
    return S.ks_statistic(V.scored(spark, d), "s1", "y", 1, 0, by=[]).select(F.round("ks", 9).alias("ks"))


@query("a12_wilson", "WITH g AS (SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS k FROM orders GROUP BY 1) SELECT o_orderpriority, n, k, round((k::DOUBLE / n + 3.841458881296 / 2 / n - 1.959964 * sqrt(k::DOUBLE / n * (1 - k::DOUBLE / n) / n + 3.841458881296 / 4 / n / n)) / (1 + 3.841458881296 / n), 6) AS lo, round((k::DOUBLE / n + 3.841458881296 / 2 / n + 1.959964 * sqrt(k::DOUBLE / n * (1 - k::DOUBLE / n) / n + 3.841458881296 / 4 / n / n)) / (1 + 3.841458881296 / n), 6) AS hi FROM g")
def a12(spark, d):
    g = table(spark, d, "orders").groupBy("o_orderpriority").agg(_n().alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("k"))
    lo, hi = S.wilson(F.col("k"), F.col("n"))
    return g.select("o_orderpriority", "n", "k", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query("a13_identity_bins", V.with_views("scored", "WITH b AS (SELECT CASE WHEN s1 < 50 THEN 'none' WHEN s1 < 500 THEN '<50' WHEN s1 < 700 THEN '50-70' WHEN s1 < 850 THEN '70-85' ELSE '>=85' END AS bin, count(*) AS n FROM scored GROUP BY 1) SELECT v.bin, coalesce(n, 0) AS n FROM (VALUES ('none'), ('<50'), ('50-70'), ('70-85'), ('>=85'), ('error')) v(bin) LEFT JOIN b USING (bin)"))
def a13(spark, d):
    """Left-closed bins with a sentinel bin, zero-filled."""
    names = ["none", "<50", "50-70", "70-85", ">=85", "error"]
    b = F.expr("CASE WHEN s1 < 50 THEN 'none' WHEN s1 < 500 THEN '<50' WHEN s1 < 700 THEN '50-70' WHEN s1 < 850 THEN '70-85' ELSE '>=85' END")
    got = V.scored(spark, d).groupBy(b.alias("bin")).agg(_n().alias("n"))
    every = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in names])).alias("bin"))
    return every.join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


@query("a14_power_verdicts", V.with_views("scored", "SELECT y AS arm, count(*) AS n, count(DISTINCT block) AS blocks, CASE WHEN count(*) < 100 THEN 'too_few' WHEN count(DISTINCT block) < 2 THEN 'not_resamplable' ELSE 'powered' END AS verdict FROM scored GROUP BY y"))
def a14(spark, d):
    return H.power_table(V.scored(spark, d).withColumnRenamed("y", "arm"), arm="arm", block="block", minimum=100)


@query("a15_floor_sweep", V.with_views("clades", "WITH g AS (SELECT genus, count(*) AS n FROM clades GROUP BY genus) SELECT f AS floor, count(*) FILTER (WHERE n >= f) AS cleared, count(*) AS units, round(count(*) FILTER (WHERE n >= f)::DOUBLE / count(*), 6) AS fraction FROM g, (VALUES (30), (50), (60), (70)) v(f) GROUP BY f"))
def a15(spark, d):
    g = V.clades(spark, d).groupBy("genus").agg(_n().alias("n"))
    return H.floor_sweep(g, n="n", floors=[30, 50, 60, 70]).withColumn("fraction", F.round("fraction", 6))


_EL = "SELECT o_custkey AS rec, CASE o_orderstatus WHEN 'F' THEN 'a' WHEN 'O' THEN 'b' ELSE 'c' END AS el, min(o_orderkey) AS lo, min(o_orderkey) + 3000 AS hi FROM orders GROUP BY ALL"


@query("a16_element_overlaps", f"WITH e AS ({_EL}) SELECT x.el AS e1, y.el AS e2, count(*) AS both, count(*) FILTER (WHERE x.lo <= y.hi AND y.lo <= x.hi) AS overlapping, count(*) FILTER (WHERE y.lo >= x.lo AND y.hi <= x.hi) AS contained, round(median(greatest(0, least(x.hi, y.hi) - greatest(x.lo, y.lo) + 1)), 6) AS median_len FROM e x JOIN e y ON x.rec = y.rec AND x.el < y.el GROUP BY ALL")
def a16(spark, d):
    """All pairs of a record's elements: overlap, containment and its length."""
    from strandloom.operators.tournament import element_overlaps

    return element_overlaps(_elements(spark, d), record="rec", element="el").withColumn("median_len", F.round("median_len", 6))


def _elements(spark, d):
    return table(spark, d, "orders").selectExpr("o_custkey AS rec", "CASE o_orderstatus WHEN 'F' THEN 'a' WHEN 'O' THEN 'b' ELSE 'c' END AS el", "o_orderkey").groupBy("rec", "el").agg(F.min("o_orderkey").alias("lo"), (F.min("o_orderkey") + 3000).alias("hi"))


@query("a17_element_order", f"WITH e AS ({_EL}), p AS (SELECT x.el AS e1, y.el AS e2, count(*) AS n, count(*) FILTER (WHERE x.lo < y.lo) AS first FROM e x JOIN e y ON x.rec = y.rec AND x.el <> y.el GROUP BY ALL) SELECT e1 AS el, count(*) FILTER (WHERE 2 * first > n) AS wins FROM p GROUP BY e1")
def a17(spark, d):
    """Copeland wins by strict majority of co-annotated records."""
    from strandloom.operators.tournament import copeland

    return copeland(_elements(spark, d), record="rec", element="el", start="lo")


@query("a30_label_coverage", V.with_views("clades", "SELECT f AS field, count(v) AS mapped, count(*) - count(v) AS masked, count(DISTINCT v) AS vocabulary FROM (SELECT 'family' AS f, nullif(family, 'BUILDING') AS v FROM clades UNION ALL SELECT 'genus', genus FROM clades) GROUP BY f"))
def a30(spark, d):
    c = V.clades(spark, d)
    rows = c.select(F.lit("family").alias("field"), F.nullif("family", F.lit("BUILDING")).alias("v")).unionByName(c.select(F.lit("genus").alias("field"), F.col("genus").alias("v")))
    return rows.groupBy("field").agg(F.count("v").alias("mapped"), F.count_if(F.col("v").isNull()).alias("masked"), F.count_distinct("v").alias("vocabulary"))


@query("a31_recovery", "SELECT c_nationkey AS family, count(*) AS n, count(*) FILTER (WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)) AS recovered FROM customer GROUP BY c_nationkey")
def a31(spark, d):
    """An item is recovered if any call is good enough."""
    calls = table(spark, d, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    items = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("family"))
    return H.recovery(items, calls, item="c_custkey", by=["family"]).drop("rate")


@query("a32_probe_set", V.with_views("contigs", "SELECT arm, family, count(*) AS n FROM (SELECT 'natural' AS arm, lang AS family FROM documents UNION ALL SELECT 'synthetic', concat('f', contig_id % 4) FROM contigs) GROUP BY ALL"))
def a32(spark, d):
    """Natural and synthetic members; the family of a synthetic one is in its id."""
    nat = table(spark, d, "documents").select(F.lit("natural").alias("arm"), F.col("lang").alias("family"))
    ids = V.contigs(spark, d).selectExpr("concat('syn:f', contig_id % 4, ':', contig_id) AS id")
    return nat.unionByName(ids.select(F.lit("synthetic").alias("arm"), F.split_part("id", F.lit(":"), F.lit(2)).alias("family"))).groupBy("arm", "family").agg(_n().alias("n"))


@query("a33_published_posterior", V.with_views("scored", "SELECT id, greatest(s1, s2) AS best, CASE WHEN s1 >= s2 THEN 1 ELSE -1 END AS strand FROM scored"))
def a33(spark, d):
    """Two orientations, one published: the larger, the plus strand on a tie."""
    s = V.scored(spark, d)
    both = s.selectExpr("id", "1 AS strand", "s1 AS p").unionByName(s.selectExpr("id", "-1 AS strand", "s2 AS p"))
    return H.published(both, id_col="id", strand="strand", posterior="p")


@query("a34_separation_census", V.with_views("scored", "SELECT arm, min(p) FILTER (WHERE y = 1) > max(p) FILTER (WHERE y = 0) AS separated, min(p) FILTER (WHERE y = 1) AS low_pos, max(p) FILTER (WHERE y = 0) AS high_neg FROM (SELECT 'one' AS arm, y, s1 AS p FROM scored UNION ALL SELECT 'two', y, s2 FROM scored) GROUP BY arm"))
def a34(spark, d):
    s = V.scored(spark, d)
    both = s.selectExpr("'one' AS arm", "y", "s1 AS p").unionByName(s.selectExpr("'two' AS arm", "y", "s2 AS p"))
    return H.separation_census(both, arm="arm", label="y", score="p")


@query("a37_segment_report", "SELECT c_custkey % 4 AS shard, arm, count(*) AS windows, count(*) FILTER (WHERE removed) AS removed, round(count(*) FILTER (WHERE removed)::DOUBLE / count(*), 6) AS rate FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'production' WHEN 1 THEN 'spike' ELSE 'null' END AS arm, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AS removed FROM customer) GROUP BY ALL")
def a37(spark, d):
    hits = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    c = table(spark, d, "customer").selectExpr("c_custkey", "c_custkey % 4 AS shard", "CASE c_custkey % 3 WHEN 0 THEN 'production' WHEN 1 THEN 'spike' ELSE 'null' END AS arm")
    return H.recovery(c, hits, item="c_custkey", by=["shard", "arm"]).select("shard", "arm", F.col("n").alias("windows"), F.col("recovered").alias("removed"), F.round("rate", 6).alias("rate"))


@query("a38_localizer_recovery", V.with_views("contigs", "SELECT length(seq) // 512 AS stratum, k, count(*) AS n, count(*) FILTER (WHERE position(substr(seq, 1, k) IN substr(seq, 2)) = 0) AS recovered FROM contigs, (VALUES (6), (8), (12)) v(k) GROUP BY ALL"))
def a38(spark, d):
    """Share of contigs whose first k letters are unique in them, over a grid of k."""
    c = V.contigs(spark, d).withColumn("k", F.explode(F.array(*[F.lit(x) for x in (6, 8, 12)])))
    again = F.call_function("locate", F.substr("seq", F.lit(1), F.col("k")), F.col("seq"), F.lit(2))
    return c.groupBy(F.expr("length(seq) div 512").alias("stratum"), "k").agg(_n().alias("n"), F.count_if(again == 0).alias("recovered"))


@query("k05_grid_decision", V.with_views("scored", "WITH g AS (SELECT t1, t2, count(*) FILTER (WHERE s1 >= t1 AND s2 >= t2 AND y = 1) AS yield, count(*) FILTER (WHERE s1 >= t1 AND s2 >= t2 AND y = 0) AS cost FROM scored, (VALUES (100), (300), (500), (700)) a(t1), (VALUES (100), (400), (700)) b(t2) GROUP BY ALL) SELECT t1, t2, yield, cost, yield >= 20 AS admissible, NOT EXISTS (SELECT 1 FROM g h WHERE h.yield >= g.yield AND h.cost <= g.cost AND (h.yield > g.yield OR h.cost < g.cost)) AS frontier, row_number() OVER (ORDER BY (yield >= 20) DESC, cost, yield DESC, t1, t2) AS place FROM g"))
def k05(spark, d):
    """Admissible settings, the undominated frontier, and the rank by tie-break keys."""
    from strandloom.operators.tournament import decide_grid

    s = V.scored(spark, d).select("s1", "s2", "y", F.explode(F.array(*[F.struct(F.lit(a).alias("t1"), F.lit(b).alias("t2")) for a in (100, 300, 500, 700) for b in (100, 400, 700)])).alias("g"))
    hit = (F.col("s1") >= F.col("g.t1")) & (F.col("s2") >= F.col("g.t2"))
    grid = s.groupBy("g.t1", "g.t2").agg(F.count_if(hit & (F.col("y") == 1)).alias("yield"), F.count_if(hit & (F.col("y") == 0)).alias("cost"))
    return decide_grid(grid, floor=20)


@query("e09_curriculum_weights", V.with_views("clades", "WITH w AS (SELECT record, pow(count(*) OVER (PARTITION BY genus), -0.5) * pow(count(*) OVER (PARTITION BY coalesce(nullif(family, 'BUILDING'), 'UNKNOWN')), -0.5) AS w FROM clades) SELECT record, round(w / avg(w) OVER (), 6) AS weight FROM w"))
def e09(spark, d):
    """Product of inverse-frequency powers, mean one; missing is a stratum."""
    from strandloom.operators.sampling import curriculum_weights

    c = V.clades(spark, d).withColumn("family", F.nullif("family", F.lit("BUILDING")))
    return curriculum_weights(c, strata=["genus", "family"], alpha=0.5).select("record", F.round("weight", 6).alias("weight"))


_DRAW = "('0x' || substr(md5(concat_ws(':', {t}, {x})), 1, 13))::BIGINT"


@query("e10_weighted_draws", V.with_views("clades", f"WITH r AS (SELECT record, record % 7 + 1 AS w, sum(record % 7 + 1) OVER (ORDER BY {_DRAW.format(t="'part'", x='record')} % 16, record) AS hi FROM clades), d AS (SELECT record AS draw, {_DRAW.format(t="'e10'", x='record')} % (SELECT max(hi) FROM r) AS x FROM clades) SELECT draw, record FROM d JOIN r ON x >= hi - w AND x < hi"))
def e10(spark, d):
    """As many draws with replacement as rows, each on the row whose weight it falls in."""
    from strandloom.operators.sampling import weighted_draws

    c = V.clades(spark, d).select("record", (F.col("record") % 7 + 1).alias("weight"))
    return weighted_draws(c, id_col="record", weight="weight", draws=c, seed="e10").select("draw", "record")


@query("e28_posteriors", V.with_views("scored", "SELECT id, round(1 / (1 + exp(-z)), 9) AS p, round(1 / (1 + exp(-(z / 1.5 + ln(0.01 / 0.99) - ln(0.3 / 0.7)))), 9) AS calibrated FROM (SELECT id, (s1 - 500) / 100.0::DOUBLE AS z FROM scored)"))
def e28(spark, d):
    """Stable sigmoid; temperature and prior shift in log odds."""
    from strandloom.functions.posterior import calibrated, sigmoid

    z = (F.col("s1") - 500) / F.lit(100.0)
    return V.scored(spark, d).select("id", F.round(sigmoid(z), 9).alias("p"), F.round(calibrated(z, temperature=1.5, train_prior=0.3, target_prior=0.01), 9).alias("calibrated"))


@query("e29_reweighted_precision", V.with_views("scored", "WITH c AS (SELECT r, count(*) FILTER (WHERE y = 1 AND s1 >= 600) AS tp, count(*) FILTER (WHERE y = 0 AND s1 >= 600) AS fp, r * count(*) FILTER (WHERE y = 1)::DOUBLE / count(*) FILTER (WHERE y = 0) AS lam FROM scored, (VALUES (1), (10), (100)) v(r) GROUP BY r) SELECT r AS ratio, round(lam, 9) AS lam, round(tp / (tp + lam * fp), 9) AS precision FROM c"))
def e29(spark, d):
    from strandloom.functions.posterior import prevalence_lambda, reweighted_precision

    s = V.scored(spark, d).withColumn("ratio", F.explode(F.array(*[F.lit(x) for x in (1, 10, 100)])))
    c = s.groupBy("ratio").agg(F.expr("count_if(y = 1 AND s1 >= 600)").alias("tp"), F.expr("count_if(y = 0 AND s1 >= 600)").alias("fp"), F.expr("count_if(y = 1)").alias("p"), F.expr("count_if(y = 0)").alias("n"))
    lam = prevalence_lambda(F.col("ratio"), F.col("p"), F.col("n"))
    return c.select("ratio", F.round(lam, 9).alias("lam"), F.round(reweighted_precision(F.col("tp"), F.col("fp"), lam), 9).alias("precision"))


_CURVE = "n AS (SELECT s1, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y <> 1) AS q FROM scored GROUP BY s1), cv AS (SELECT s1, p, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS np, sum(q) OVER () AS nn FROM n WINDOW w AS (ORDER BY s1 DESC))"


@query("m01_average_precision", V.with_views("scored", f"WITH {_CURVE} SELECT round(sum(p::DOUBLE / np * tp / (tp + fp)), 9) AS ap, round(sum(p::DOUBLE / np * tp / (tp + 10.0 * fp)), 9) AS ap10 FROM cv"))
def m01(spark, d):
    c = M.ranking_curve(V.scored(spark, d), score="s1", label="y")
    a, b = M.average_precision(c).select("ap"), M.average_precision(c, lam=F.lit(10.0)).select(F.col("ap").alias("ap10"))
    return a.join(b, F.lit(True)).select(F.round("ap", 9).alias("ap"), F.round("ap10", 9).alias("ap10"))


@query("m02_matched_points", V.with_views("scored", f"WITH {_CURVE} SELECT round(max(tp::DOUBLE / np) FILTER (WHERE tp::DOUBLE / (tp + fp) >= 0.9), 9) AS recall_at_precision, round(max(tp::DOUBLE / (tp + fp)) FILTER (WHERE tp::DOUBLE / np >= 0.8), 9) AS precision_at_recall, max(s1) FILTER (WHERE tp::DOUBLE / np >= 0.8) AS threshold FROM cv"))
def m02(spark, d):
    r = M.matched_points(M.ranking_curve(V.scored(spark, d), score="s1", label="y"), score="s1", precision=0.9, recall=0.8)
    return r.select(F.round("recall_at_precision", 9).alias("recall_at_precision"), F.round("precision_at_recall", 9).alias("precision_at_recall"), "threshold")


_BINS = "b AS (SELECT bin, count(*) AS n, avg(s1 / 1000.0::DOUBLE) AS conf, avg(y) AS acc FROM (SELECT *, ntile(15) OVER (ORDER BY s1, id) AS bin FROM scored) GROUP BY bin)"


@query("m03_reliability_bins", V.with_views("scored", f"WITH {_BINS} SELECT bin::INTEGER AS bin, n, round(conf, 9) AS conf, round(acc, 9) AS acc, round(abs(conf - acc), 9) AS gap FROM b"))
def m03(spark, d):
    r = M.reliability(V.scored(spark, d).withColumn("p", F.col("s1") / F.lit(1000.0)), p="p", label="y", id_col="id")
    return r.select("bin", "n", *[F.round(c, 9).alias(c) for c in ("conf", "acc", "gap")])


@query("m03_ece", V.with_views("scored", f"WITH {_BINS} SELECT round(sum(n * abs(conf - acc)) / sum(n), 9) AS ece FROM b"))
def m03b(spark, d):
    return M.ece(M.reliability(V.scored(spark, d).withColumn("p", F.col("s1") / F.lit(1000.0)), p="p", label="y", id_col="id")).select(F.round("ece", 9).alias("ece"))


@query("m04_prior_band", V.with_views("scored", "WITH p AS (SELECT pr, id, y, 1 / (1 + exp(-((s1 - 500) / 150.0::DOUBLE + ln(pr / (1 - pr))))) AS p FROM scored, (VALUES (0.1::DOUBLE), (0.3::DOUBLE), (0.5::DOUBLE)) v(pr)), b AS (SELECT pr, bin, count(*) AS n, avg(p) AS conf, avg(y) AS acc FROM (SELECT *, ntile(10) OVER (PARTITION BY pr ORDER BY p, id) AS bin FROM p) GROUP BY ALL) SELECT pr AS prior, round(sum(n * abs(conf - acc)) / sum(n), 7) AS ece FROM b GROUP BY pr"))
def m04(spark, d):
    """Calibration error over a band of priors."""
    s = V.scored(spark, d).withColumn("logit", (F.col("s1") - 500) / F.lit(150.0))
    return M.prior_band(s, logit="logit", label="y", id_col="id", priors=[0.1, 0.3, 0.5], bins=10).withColumn("ece", F.round("ece", 7))


_KERN = "CASE WHEN n = 1 AND p = q THEN 0 ELSE exp(p / h * (ln(z) - ln(x)) + (1 - p) / h * (ln(1 - z) - ln(1 - x))) END"


@query("m05_kernel_calibration", V.with_views("scored", f"""WITH g AS (SELECT s1 // 20 / 50.0::DOUBLE AS p, count(*) AS n, CAST(sum(y) AS BIGINT) AS k FROM scored GROUP BY 1), pr AS (SELECT h, a.p, a.n, a.k, b.p AS q, b.n AS m, b.k AS j, greatest(least(a.p, 1 - 1e-12), 1e-12) AS x, greatest(least(b.p, 1 - 1e-12), 1e-12) AS z FROM g a, g b, (VALUES (0.05::DOUBLE), (0.1::DOUBLE)) v(h)),
e AS (SELECT h, p, n, k, sum({_KERN} * m) AS w, sum({_KERN} * j) AS wk FROM pr GROUP BY h, p, n, k), o AS (SELECT *, (wk - (n > 1)::INT) / nullif(w - (n > 1)::INT, 0) AS e1, wk / nullif(w - (n > 1)::INT, 0) AS e0 FROM e)
SELECT h, round(sum(coalesce(k * abs(e1 - p) + (n - k) * abs(e0 - p), NULL)) / sum(n), 6) AS ece FROM o GROUP BY h"""))
def m05(spark, d):
    """Leave-one-out kernel estimate, over scores compressed to 50 levels."""
    s = V.scored(spark, d).selectExpr("(s1 div 20) / 50D AS p", "y")
    return M.kernel_calibration(s, p="p", label="y", bandwidths=[0.05, 0.1]).select("h", F.round("ece", 6).alias("ece"))


@query("m05_exact_kernel", V.with_views("scored", f"""WITH g AS (SELECT s1 / 1000.0::DOUBLE AS p, count(*) AS n, CAST(sum(y) AS BIGINT) AS k FROM scored GROUP BY 1), pr AS (SELECT h, a.p, a.n, a.k, b.p AS q, b.n AS m, b.k AS j, greatest(least(a.p, 1 - 1e-12), 1e-12) AS x, greatest(least(b.p, 1 - 1e-12), 1e-12) AS z FROM g a, g b, (VALUES (0.01::DOUBLE), (0.05::DOUBLE)) v(h)),
e AS (SELECT h, p, n, k, sum({_KERN} * m) AS w, sum({_KERN} * j) AS wk FROM pr GROUP BY h, p, n, k), o AS (SELECT *, (wk - (n > 1)::INT) / nullif(w - (n > 1)::INT, 0) AS e1, wk / nullif(w - (n > 1)::INT, 0) AS e0 FROM e)
SELECT h, round(sum(k * abs(e1 - p) + (n - k) * abs(e0 - p)) / sum(n), 8) AS ece FROM o GROUP BY h"""))
def m05_exact(spark, d):
    """Leave-one-out kernel estimate over all distinct scores, none rounded."""
    s = V.scored(spark, d).selectExpr("s1 / 1000D AS p", "y")
    return M.kernel_calibration(s, p="p", label="y", bandwidths=[0.01, 0.05]).select("h", F.round("ece", 8).alias("ece"))


@query("m06_temperature", V.with_views("scored", "WITH RECURSIVE z AS (SELECT (s1 - 600) / 100.0::DOUBLE AS z, y, count(*) AS n FROM scored GROUP BY ALL), it AS (SELECT 0 AS k, 0.05::DOUBLE AS lo, 20.0::DOUBLE AS hi UNION ALL SELECT k + 1, CASE WHEN g < 0 THEN m ELSE lo END, CASE WHEN g < 0 THEN hi ELSE m END FROM (SELECT k, lo, hi, (lo + hi) / 2 AS m, (SELECT sum(n * (1 / (1 + exp(-(lo + hi) / 2 * z)) - y) * z) FROM z) AS g FROM it WHERE k < 60)) SELECT round((lo + hi) / 2, 5) AS inverse_temperature FROM it WHERE k = 60"))
def m06(spark, d):
    """The inverse temperature at which the likelihood's derivative is zero."""
    s = V.scored(spark, d).selectExpr("(s1 - 600) / 100D AS z", "y")
    beta = M.fit_temperature(s, logit="z", label="y")
    return s.agg(F.round(F.lit(beta), 5).alias("inverse_temperature"))


_BOOT = "bl AS (SELECT block, row_number() OVER (ORDER BY block) - 1 AS i FROM (SELECT DISTINCT block FROM scored)), kk AS (SELECT count(*) AS k FROM bl), dr AS (SELECT rep, ('0x' || substr(md5(concat_ws(':', 'm07', rep, d)), 1, 8))::BIGINT % k AS i FROM kk, (SELECT unnest(range(1, 201)) AS rep), (SELECT unnest(range(1, (SELECT k FROM kk) + 1)) AS d)), w AS (SELECT rep, block, count(*) AS weight FROM dr JOIN bl USING (i) GROUP BY ALL)"


@query("m07_block_bootstrap", V.with_views("scored", f"WITH {_BOOT}, s AS (SELECT block, count(*) FILTER (WHERE (s1 >= 600) = (y = 1)) AS a, count(*) AS b FROM scored GROUP BY block), v AS (SELECT rep, sum(weight * a)::DOUBLE / sum(weight * b) AS v FROM w JOIN s USING (block) GROUP BY rep) SELECT (SELECT count(*) FROM s) AS n_blocks, round((SELECT sum(a)::DOUBLE / sum(b) FROM s), 9) AS point, round(quantile_cont(v, 0.025), 9) AS lo, round(quantile_cont(v, 0.975), 9) AS hi FROM v"))
def m07(spark, d):
    """200 replicates of whole blocks over block sums."""
    s = V.scored(spark, d)
    sums = s.groupBy("block").agg(F.expr("count_if((s1 >= 600) = (y = 1))").alias("a"), _n().alias("b"))
    w = M.block_bootstrap_weights(s, block="block", replicates=200, seed="m07")
    r = M.bootstrap_ratio(sums, w, block="block", numerator="a", denominator="b")
    return r.select("n_blocks", *[F.round(c, 9).alias(c) for c in ("point", "lo", "hi")])


@query("m08_arm_metrics", V.with_views("scored", f"WITH {_BOOT}, a AS (SELECT 's1' AS arm, id, block, y, s1 AS s FROM scored UNION ALL SELECT 's2', id, block, y, s2 FROM scored), n AS (SELECT arm, rep, s, sum(weight) FILTER (WHERE y = 1) AS p, sum(weight) FILTER (WHERE y <> 1) AS q FROM a JOIN w USING (block) GROUP BY ALL), cv AS (SELECT arm, rep, coalesce(p, 0) AS p, sum(coalesce(p, 0)) OVER x AS tp, sum(coalesce(q, 0)) OVER x AS fp, sum(coalesce(p, 0)) OVER (PARTITION BY arm, rep) AS np FROM n WINDOW x AS (PARTITION BY arm, rep ORDER BY s DESC)), ap AS (SELECT arm, rep, sum(p::DOUBLE / np * tp / nullif(tp + fp, 0)) AS ap FROM cv GROUP BY ALL) SELECT arm, round(quantile_cont(ap, 0.025), 7) AS lo, round(quantile_cont(ap, 0.975), 7) AS hi, count(*) AS n FROM ap GROUP BY arm"))
def m08(spark, d):
    """Average precision of two arms under the same 200 block replicates."""
    return _arms(spark, d)[0].select("arm", F.round("lo", 7).alias("lo"), F.round("hi", 7).alias("hi"), "n")


def _arms(spark, d):
    s = V.scored(spark, d)
    both = s.selectExpr("'s1' AS arm", "block", "y", "s1 AS s").unionByName(s.selectExpr("'s2' AS arm", "block", "y", "s2 AS s"))
    return M.arm_intervals(both, arm="arm", block="block", score="s", label="y", replicates=200, seed="m07")


@query("m08_paired_difference", V.with_views("scored", f"WITH {_BOOT}, a AS (SELECT 's1' AS arm, id, block, y, s1 AS s FROM scored UNION ALL SELECT 's2', id, block, y, s2 FROM scored), n AS (SELECT arm, rep, s, sum(weight) FILTER (WHERE y = 1) AS p, sum(weight) FILTER (WHERE y <> 1) AS q FROM a JOIN w USING (block) GROUP BY ALL), cv AS (SELECT arm, rep, coalesce(p, 0) AS p, sum(coalesce(p, 0)) OVER x AS tp, sum(coalesce(q, 0)) OVER x AS fp, sum(coalesce(p, 0)) OVER (PARTITION BY arm, rep) AS np FROM n WINDOW x AS (PARTITION BY arm, rep ORDER BY s DESC)), ap AS (SELECT arm, rep, sum(p::DOUBLE / np * tp / nullif(tp + fp, 0)) AS ap FROM cv GROUP BY ALL) SELECT a.arm, b.arm AS other, round(quantile_cont(a.ap - b.ap, 0.025), 7) AS lo, round(quantile_cont(a.ap - b.ap, 0.975), 7) AS hi, count(*) AS n FROM ap a JOIN ap b ON a.rep = b.rep AND a.arm < b.arm GROUP BY a.arm, b.arm"))
def m08b(spark, d):
    """Interval of the difference between arms, replicate by replicate."""
    return _arms(spark, d)[1].select("arm", "other", F.round("lo", 7).alias("lo"), F.round("hi", 7).alias("hi"), "n")


@query("m08_prevalence_sweep", V.with_views("scored", f"WITH {_CURVE} SELECT r AS ratio, round(sum(p::DOUBLE / np * tp / (tp + r * np::DOUBLE / nn * fp)), 9) AS ap FROM cv, (VALUES (1), (10), (100)) v(r) GROUP BY r"))
def m08c(spark, d):
    """Average precision at one, ten and a hundred decoys for each positive."""
    c = M.ranking_curve(V.scored(spark, d), score="s1", label="y").withColumn("ratio", F.explode(F.array(F.lit(1), F.lit(10), F.lit(100))))
    return M.average_precision(c, by=["ratio"], lam=F.col("ratio") * F.col("n_pos") / F.col("n_neg")).select("ratio", F.round("ap", 9).alias("ap"))


@query("m08_recall_grid", V.with_views("scored", f"WITH {_CURVE} SELECT g AS recall, round(max(tp::DOUBLE / (tp + fp)) FILTER (WHERE tp::DOUBLE / np >= g), 9) AS precision FROM cv, (VALUES (0.5::DOUBLE), (0.8::DOUBLE), (0.95::DOUBLE)) v(g) GROUP BY g"))
def m08d(spark, d):
    """Best precision at each of a grid of recalls."""
    c = M.ranking_curve(V.scored(spark, d), score="s1", label="y")
    out = [M.matched_points(c, score="s1", precision=0.9, recall=r).select(F.lit(r).alias("recall"), F.round("precision_at_recall", 9).alias("precision")) for r in (0.5, 0.8, 0.95)]
    return out[0].unionByName(out[1]).unionByName(out[2])


_UNIT = """WITH r AS (SELECT {u} AS unit, y, s1 // 20 / 50.0::DOUBLE AS p FROM scored), t AS (SELECT unit, count(*) AS n, avg((p - y) * (p - y)) AS brier FROM r GROUP BY unit), g AS (SELECT unit, p, count(*) AS n, CAST(sum(y) AS BIGINT) AS k FROM r GROUP BY unit, p), pr AS (SELECT a.unit, 0.1::DOUBLE AS h, a.p, a.n, a.k, b.p AS q, b.n AS m, b.k AS j, greatest(least(a.p, 1 - 1e-12), 1e-12) AS x, greatest(least(b.p, 1 - 1e-12), 1e-12) AS z FROM g a JOIN g b USING (unit)),
e AS (SELECT unit, p, n, k, sum({kern} * m) AS w, sum({kern} * j) AS wk FROM pr GROUP BY unit, p, n, k), o AS (SELECT *, (wk - (n > 1)::INT) / nullif(w - (n > 1)::INT, 0) AS e1, wk / nullif(w - (n > 1)::INT, 0) AS e0 FROM e), c AS (SELECT unit, sum(k * abs(e1 - p) + (n - k) * abs(e0 - p)) / sum(n) AS ece FROM o GROUP BY unit)
SELECT unit, n, n >= {m} AS admissible, round(CASE WHEN n >= {m} THEN brier END, 9) AS brier, round(CASE WHEN n >= {m} THEN ece END, 6) AS ece FROM t LEFT JOIN c USING (unit)"""


def _graded(spark, d, unit, minimum):
    s = V.scored(spark, d).selectExpr(f"{unit} AS unit", "(s1 div 20) / 50D AS p", "y")
    g = M.unit_grades(s, unit="unit", p="p", label="y", minimum=minimum, bandwidth=0.1)
    return g.withColumn("brier", F.round("brier", 9)).withColumn("ece", F.round("ece", 6))


@query("m09_unit_grades", V.with_views("scored", _UNIT.format(u="block", kern=_KERN, m=20)))
def m09(spark, d):
    """Each held-out unit graded by Brier score and kernel estimate, null below the minimum size."""
    return _graded(spark, d, "block", 20)


@query("m09_regrouped", V.with_views("scored", _UNIT.format(u="right(block, 1)", kern=_KERN, m=50)))
def m09b(spark, d):
    """The same over larger groups of units."""
    return _graded(spark, d, "right(block, 1)", 50)


@query("m10_strand_robustness", V.with_views("scored", "SELECT count(*) AS n, count(*) FILTER (WHERE s1 >= 600 OR s2 >= 600) AS confirmed, count(*) FILTER (WHERE (s1 >= 600) = (s2 >= 600)) AS invariant FROM scored"))
def m10(spark, d):
    s = V.scored(spark, d)
    both = s.selectExpr("id", "s1 >= 600 AS v").unionByName(s.selectExpr("id", "s2 >= 600 AS v"))
    return M.strand_robustness(both, id_col="id", confirmed="v")


@query("m11_auroc", V.with_views("scored", "WITH n AS (SELECT s1, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y <> 1) AS q FROM scored GROUP BY s1), u AS (SELECT p, q, p * (coalesce(sum(q) OVER (ORDER BY s1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + q / 2.0::DOUBLE) AS u FROM n) SELECT CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(q) AS BIGINT) AS n_neg, round(sum(u) / (sum(p) * sum(q)), 9) AS auroc, round(sqrt((sum(p) + sum(q) + 1)::DOUBLE / (12 * sum(p) * sum(q))), 9) AS null_se FROM u"))
def m11(spark, d):
    return M.auroc(V.scored(spark, d), score="s1", label="y").select("n_pos", "n_neg", F.round("auroc", 9).alias("auroc"), F.round("null_se", 9).alias("null_se"))


_LABEL = "(embedding[1] + embedding[2] > 0)::INT AS y1, ('0x' || substr(md5(concat('m12:', vec_id)), 1, 8))::BIGINT % 2 AS y2"


@query("m12_embedding_probe", f"WITH e AS (SELECT vec_id, embedding, vec_id % 3 = 0 AS test, {_LABEL} FROM embeddings), l AS (SELECT vec_id, embedding, test, 'linear' AS label, y1 AS y FROM e UNION ALL SELECT vec_id, embedding, test, 'random', y2 FROM e), x AS (SELECT label, vec_id, test, y, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS v FROM l), w AS (SELECT label, i, avg(v) FILTER (WHERE y = 1) - avg(v) FILTER (WHERE y = 0) AS w FROM x WHERE NOT test GROUP BY label, i), s AS (SELECT label, vec_id, y, sum(v * w) AS s FROM x JOIN w USING (label, i) WHERE test GROUP BY ALL), r AS (SELECT label, y, rank() OVER (PARTITION BY label ORDER BY s) AS r FROM s) SELECT label, count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y = 0) AS n_neg, (sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) > 0.75 AS separable FROM r GROUP BY label")
def m12(spark, d):
    """Logistic probes, held out by id, for a property that is linear in the embedding
    and for a random one: they must find the first and not the second, as the
    difference of the class means does in SQL."""
    from strandloom.operators.probe import probe_scores

    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding"), (F.col("vec_id") % 3 == 0).alias("test"))
    random = F.conv(F.substring(F.md5(F.concat(F.lit("m12:"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long") % 2
    out = [M.auroc(probe_scores(e.withColumn("y", y.cast("int"))), score="score", label="y").withColumn("label", F.lit(name)) for name, y in (("linear", F.expr("embedding[0] + embedding[1] > 0")), ("random", random))]
    return out[0].unionByName(out[1]).select("label", "n_pos", "n_neg", (F.col("auroc") > 0.75).alias("separable"))


@query("m12_grouped_probe", "SELECT 'by group' AS split, 'FAIL' AS verdict UNION ALL SELECT 'by row', 'PASS'")
def m12_grouped(spark, d):
    """A coin per group of near copies of an embedding: with copies on both sides a probe
    of pairs of dimensions learns it, with whole groups held out it is at chance. The
    verdict is the one of the interval over groups, counted as FAIL unless it passes."""
    from strandloom.operators import probe as P

    e = table(spark, d, "embeddings").where("vec_id % 4 = 0").select(F.col("vec_id").alias("own"), "embedding")
    copies = e.select("own", "embedding", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j")).withColumn("id", F.col("own") * 10 + F.col("j"))
    shaken = F.expr("transform(embedding, (x, i) -> cast(x + ((id * 31 + i * 17) % 11 - 5) * 1e-4 AS double))")
    # Products of neighbouring dimensions give the probe room to learn single groups.
    rows = copies.select("id", "own", shaken.alias("embedding"))
    groups = P.similarity_groups(rows, id_col="id", embedding="embedding")
    wide = F.expr("concat(embedding, transform(sequence(0, 62), i -> 8 * embedding[i] * embedding[i + 1]), transform(sequence(0, 61), i -> 8 * embedding[i] * embedding[i + 2]))")
    rows = rows.join(groups, "id").select("id", "group", wide.alias("embedding"), (F.conv(F.substring(F.md5(F.concat(F.lit("g:"), F.col("group").cast("string"))), 1, 8), 16, 10).cast("long") % 2).cast("int").alias("y"))
    rows, out = cut(rows), None
    for split, test in (("by row", F.col("id") % 10 >= 6), ("by group", None)):
        held = P.grouped_split(rows, group="group", share=0.3, seed="m12g") if test is None else rows.withColumn("test", test)
        scores = cut(P.probe_scores(held).join(rows.select("id", "group"), "id"))
        verdict = P.probe_verdict(M.auroc_interval(scores, score="score", label="y", block="group", replicates=50, seed="m12g"))
        one = verdict.select(F.lit(split).alias("split"), F.when(F.col("verdict") == "PASS", "PASS").otherwise("FAIL").alias("verdict"))
        out = one if out is None else out.unionByName(one)
    return out


@query("c02_match_columns", V.with_views("contigs", "WITH r AS (SELECT contig_id % 40 AS aln, contig_id, translate(rpad(seq, max(length(seq)) OVER (PARTITION BY contig_id % 40)::INT, 'A'), 'ACGT', 'ACGU') AS s FROM contigs), x AS (SELECT aln, contig_id, unnest(range(1, length(s) + 1)) AS i, unnest(string_split(s, '')) AS c FROM r), y AS (SELECT aln, contig_id, i, CASE WHEN i % 5 = 0 AND contig_id % 3 = 0 THEN '.' ELSE c END AS ch FROM x), k AS (SELECT aln, i FROM y GROUP BY aln, i HAVING NOT bool_or(ch = '.')) SELECT contig_id, string_agg(CASE ch WHEN 'A' THEN '0' WHEN 'C' THEN '1' WHEN 'G' THEN '2' ELSE '3' END, '' ORDER BY i) AS codes FROM y JOIN k USING (aln, i) GROUP BY contig_id"))
def c02(spark, d):
    """Codes of the columns that no row of an alignment has as an insert."""
    from strandloom.operators.tournament import match_columns

    r = V.contigs(spark, d).selectExpr("contig_id % 40 AS aln", "contig_id", "seq")
    widest = r.groupBy("aln").agg(F.max(F.length("seq")).alias("w"))
    padded = r.join(widest, "aln").select("aln", "contig_id", F.translate(F.rpad("seq", F.col("w"), F.lit("A")), "T", "U").alias("s"))
    fifth = F.when(F.col("contig_id") % 3 == 0, F.regexp_replace("s", "(.{4}).", "$1.")).otherwise(F.col("s"))
    return match_columns(padded.select("aln", "contig_id", fifth.alias("s")), alignment="aln", row="contig_id", aligned="s")


@query("c03_cluster_spread", V.with_views("splits", "SELECT cluster_id, count(DISTINCT genus) AS n_genus, count(DISTINCT phylum) AS n_phylum, count(DISTINCT phylum) > 1 AS crosses FROM splits GROUP BY cluster_id"))
def c03(spark, d):
    return H.cluster_spread(V.splits(spark, d), cluster="cluster_id", taxa=["genus", "phylum"], top="phylum")


@query("c04_split_ladder", V.with_views("splits", "SELECT record, CASE WHEN heldout THEN 'heldout' WHEN bool_or(heldout) OVER (PARTITION BY cluster_id) THEN 'excluded' WHEN family = 'MACHINERY' THEN 'dropped' ELSE 'train' END AS role FROM splits"))
def c04(spark, d):
    """A cluster linked to a held-out member is excluded from training."""
    return H.split_ladder(V.splits(spark, d), cluster="cluster_id", heldout=F.col("heldout"), dropped=F.col("family") == "MACHINERY").select("record", "role")


@query("c05_random_folds", V.with_views("splits", "WITH p AS (SELECT cluster_id, min(genus) AS genus, count(*) AS n FROM splits GROUP BY cluster_id), w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY genus ORDER BY md5(concat('c05:', cluster_id)), cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n) OVER (PARTITION BY genus) AS t FROM p) SELECT cluster_id, genus, n, CASE WHEN b < 0.8 * t THEN 'train' WHEN b < 0.9 * t THEN 'val' ELSE 'test' END AS fold FROM w"))
def c05(spark, d):
    from strandloom.operators.selection import random_folds

    return random_folds(V.splits(spark, d), cluster="cluster_id", stratum="genus", ratios={"train": 0.8, "val": 0.1, "test": 0.1}, seed="c05")


_DEFICIT = "{r}::DOUBLE - (f.{c} + r.n) / (f.a + f.b + f.c + r.n) AS d{c}"
_STEPS = ", ".join(_DEFICIT.format(r=r, c=c) for r, c in ((0.8, "a"), (0.1, "b"), (0.1, "c")))


@query("c05_deficit_folds", V.with_views("splits", f"""WITH RECURSIVE k AS (SELECT cluster_id, genus, count(*) AS k FROM splits GROUP BY ALL), o AS (SELECT cluster_id, first(genus ORDER BY k DESC, genus) AS genus, sum(k)::BIGINT AS n FROM k GROUP BY cluster_id), r AS (SELECT *, row_number() OVER (ORDER BY genus, md5(concat('c05:', genus, ':', cluster_id)), cluster_id) AS i FROM o),
f AS (SELECT 0::BIGINT AS i, 0::BIGINT AS cluster_id, '' AS genus, 0::BIGINT AS n, '' AS fold, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c UNION ALL SELECT i, cluster_id, genus, n, fold, a + CASE fold WHEN 'train' THEN n ELSE 0 END, b + CASE fold WHEN 'val' THEN n ELSE 0 END, c + CASE fold WHEN 'test' THEN n ELSE 0 END FROM (SELECT *, CASE WHEN da >= db AND da >= dc THEN 'train' WHEN db >= dc THEN 'val' ELSE 'test' END AS fold FROM (SELECT r.i, r.cluster_id, r.genus, r.n, f.a, f.b, f.c, {_STEPS} FROM f JOIN r ON r.i = f.i + 1)))
SELECT cluster_id, genus, n, fold FROM f WHERE i > 0"""))
def c05_deficit(spark, d):
    """Whole clusters by the largest deficit, genus by genus."""
    from strandloom.operators.folds import deficit_folds

    return deficit_folds(V.splits(spark, d), cluster="cluster_id", stratum="genus", ratios={"train": 0.8, "val": 0.1, "test": 0.1}, seed="c05")


@query("c06_distinct_strata", V.with_views("clades", "WITH g AS (SELECT genus, count(*) AS s, (SELECT count(*) FROM clades) AS n FROM clades GROUP BY genus) SELECT k, round(sum(1 - exp(list_sum(list_transform(range(k), lambda i: ln((n - s - i)::DOUBLE / (n - i)))))), 6) AS expected FROM g, (VALUES (5), (20), (50)) v(k) GROUP BY k"))
def c06(spark, d):
    """Expected distinct strata among k draws without replacement."""
    return H.expected_strata(V.clades(spark, d), stratum="genus", draws=[5, 20, 50]).withColumn("expected", F.round("expected", 6))


_LEN = "SELECT CASE WHEN flag = 'R' THEN 'control' ELSE 'candidate' END AS arm, abs(hi1 - lo1) + 1 AS length FROM loci WHERE flag IN ('R', 'A') AND NOT (flag = 'R' AND (abs(hi1 - lo1) + 1) % 5 = 0)"


@query("c06_span_matchedness", V.with_views("loci", f"WITH t AS ({_LEN}), s AS (SELECT arm, count(*) AS n, min(length) AS lo, quantile_cont(length, 0.25) AS p25, quantile_cont(length, 0.5) AS median, quantile_cont(length, 0.75) AS p75, max(length) AS hi FROM t GROUP BY arm), c AS (SELECT length, count(*) FILTER (WHERE arm = 'control') AS a, count(*) FILTER (WHERE arm = 'candidate') AS b FROM t GROUP BY length), k AS (SELECT max(abs(ca / ta - cb / tb)) AS ks FROM (SELECT sum(a) OVER (ORDER BY length)::DOUBLE AS ca, sum(b) OVER (ORDER BY length)::DOUBLE AS cb, sum(a) OVER () AS ta, sum(b) OVER () AS tb FROM c)) SELECT x.n AS control_n, x.median AS control_median, y.n AS candidate_n, y.median AS candidate_median, y.p25 AS candidate_p25, y.p75 AS candidate_p75, (SELECT count(*) FROM t WHERE arm = 'control' AND length BETWEEN y.lo AND y.hi) AS n_inside, round(ks, 9) AS ks, round(x.median / y.median, 9) AS median_ratio FROM (SELECT * FROM s WHERE arm = 'control') x, (SELECT * FROM s WHERE arm = 'candidate') y, k"))
def c06_spans(spark, d):
    """Lengths of known loci, every fifth length missing, against those of candidates."""
    from strandloom.operators.sizing import span_matchedness

    n = V.loci(spark, d).withColumn("length", F.abs(F.col("hi1") - F.col("lo1")) + 1)
    r = span_matchedness(n.where("flag = 'R' AND length % 5 <> 0"), n.where("flag = 'A'"), length="length")
    return r.select("control_n", "control_median", "candidate_n", "candidate_median", "candidate_p25", "candidate_p75", "n_inside", F.round("ks", 9).alias("ks"), F.round("median_ratio", 9).alias("median_ratio"))


@query("c06_substrate_overlap", "WITH g AS (SELECT s_nationkey AS taxon, concat('A', s_suppkey) AS assembly FROM supplier WHERE s_suppkey % 3 = 0 AND s_nationkey % 4 <> 0), r AS (SELECT c_nationkey AS taxon FROM customer), c AS (SELECT DISTINCT concat('A', l_suppkey) AS assembly FROM lineitem) SELECT (SELECT count(*) FROM r) AS n_records, (SELECT count(DISTINCT assembly) FROM g) AS n_genomes, (SELECT count(DISTINCT taxon) FROM g) AS n_searched_taxa, (SELECT count(*) FROM r WHERE taxon IN (SELECT taxon FROM g)) AS n_routable, (SELECT count(DISTINCT taxon) FROM r WHERE taxon IN (SELECT taxon FROM g)) AS n_taxa_searched, (SELECT count(*) FROM c) AS n_candidate_assemblies, (SELECT count(*) FROM c WHERE assembly IN (SELECT assembly FROM g)) AS n_self_hits")
def c06_overlap(spark, d):
    """Customers' nations against those of a third of the suppliers; line items' suppliers
    against the same."""
    from strandloom.operators.sizing import substrate_overlap

    g = table(spark, d, "supplier").where("s_suppkey % 3 = 0 AND s_nationkey % 4 <> 0").selectExpr("s_nationkey AS taxon", "concat('A', s_suppkey) AS assembly")
    r = substrate_overlap(table(spark, d, "customer").selectExpr("c_nationkey AS taxon"), table(spark, d, "lineitem").selectExpr("concat('A', l_suppkey) AS assembly"), g, taxon="taxon", assembly="assembly")
    return r.select("n_records", "n_genomes", "n_searched_taxa", "n_routable", "n_taxa_searched", "n_candidate_assemblies", "n_self_hits")


@query("c06_draw_feasibility", V.with_views("splits", "WITH p AS (SELECT genus, count(DISTINCT cluster_id) AS n FROM splits GROUP BY genus), t AS (SELECT count(*) AS s, (SELECT count(DISTINCT cluster_id) FROM splits) AS c FROM p) SELECT k, k // s AS quota, s AS strata, (SELECT count(*) FROM p WHERE n >= greatest(1, k // s)) AS strata_with_quota, c AS clusters, k <= c AS one_per_cluster FROM t, (VALUES (10), (200), (1000)) v(k)"))
def c06_draw(spark, d):
    from strandloom.operators.sizing import draw_feasibility

    return draw_feasibility(V.splits(spark, d), stratum="genus", cluster="cluster_id", draws=[10, 200, 1000])


@query("c07_control_comparison", V.with_views("scored", "SELECT t AS setting, block, count(*) FILTER (WHERE y = 1) AS controls, count(*) FILTER (WHERE y = 1 AND s1 < t) AS control_failed, count(*) FILTER (WHERE y = 0) AS candidates, count(*) FILTER (WHERE y = 0 AND s1 < t) AS candidate_failed, coalesce(count(*) FILTER (WHERE y = 1 AND s1 < t)::DOUBLE / nullif(count(*) FILTER (WHERE y = 1), 0) > count(*) FILTER (WHERE y = 0 AND s1 < t)::DOUBLE / nullif(count(*) FILTER (WHERE y = 0), 0), false) AS anti_selective FROM scored, (VALUES (300), (600)) v(t) GROUP BY ALL"))
def c07(spark, d):
    """Failures of controls and candidates per stratum and setting; a setting
    that fails controls more often is anti-selective."""
    return H.compare_controls(V.scored(spark, d), settings=[300, 600], score="s1", control=F.col("y") == 1, by=["block"])


@query("c08_grid_inertness", V.with_views("scored", "WITH s AS (SELECT id, t, u, s1 >= t AND s2 >= u AS st FROM scored, (VALUES (0), (500)) a(t), (VALUES (0), (1)) b(u)) SELECT x.t, count(*) AS n, count(*) FILTER (WHERE x.st <> y.st) AS differing, count(*) FILTER (WHERE x.st <> y.st) = 0 AS inert FROM s x JOIN s y ON x.id = y.id AND x.t = y.t AND x.u = 0 AND y.u = 1 GROUP BY x.t"))
def c08(spark, d):
    """A parameter is inert where all its values give every candidate the same state."""
    s = V.scored(spark, d).withColumn("t", F.explode(F.array(F.lit(0), F.lit(500)))).withColumn("u", F.explode(F.array(F.lit(0), F.lit(1))))
    return H.grid_inertness(s.withColumn("st", F.expr("s1 >= t AND s2 >= u")), id_col="id", parameter="u", state="st", by=["t"])


@query("r01_incremental_scan", V.with_views("contigs", "SELECT contig_id, count(*) AS n_windows FROM (SELECT contig_id, unnest(list_distinct(list_concat(range(0, greatest(length(seq) - 128, 0) + 1, 64), [greatest(length(seq) - 128, 0)]))) AS s FROM contigs) GROUP BY contig_id"))
def r01(spark, d):
    """The tiling as a stream over files: same windows as the batch."""
    from strandloom.streaming.scan import incremental_tiles

    src = scratch_of(spark, V.contigs(spark, d))
    return incremental_tiles(spark, src, "contig_id long, seq string", id_col="contig_id", seq_col="seq", window=128, stride=64).groupBy("contig_id").agg(_n().alias("n_windows"))


def scratch_of(spark, df):
    from strandloom.session import scratch_path

    path = scratch_path(spark, "stream-source")
    df.write.parquet(path)
    return path


@query("r02_round_monitor", "WITH r AS (SELECT user_id % 5 AS run, user_id AS round, count(*) FILTER (WHERE event_type = 'click') * 1000 // count(*) AS recall FROM events GROUP BY ALL) SELECT run, max(recall) AS best, count(*) AS rounds, coalesce(bool_or(recall <= b - 50), false) AS halted FROM (SELECT *, max(recall) OVER (PARTITION BY run ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM r) GROUP BY run")
def r02(spark, d):
    """Best recall so far per run, kept as a streaming state; 50 below it halts."""
    from strandloom.streaming.scan import best_so_far

    r = table(spark, d, "events").groupBy(F.expr("user_id % 5").alias("run"), F.col("user_id").alias("round")).agg(F.expr("count_if(event_type = 'click') * 1000 div count(*)").alias("recall"))
    return best_so_far(spark, scratch_of(spark, r), "run long, round long, recall long", drop=50)


_PROBES = "SELECT user_id % 10 AS run, user_id // 10 AS round, count(*) FILTER (WHERE event_type IN ('click', 'view', 'signup')) AS hits, count(*) AS probes FROM events GROUP BY ALL"
_OUTCOMES = f"""WITH p AS (SELECT run, row_number() OVER (PARTITION BY run ORDER BY round) AS round, hits, probes FROM ({_PROBES})),
g AS (SELECT *, CASE WHEN probes >= 60 THEN hits::DOUBLE / probes END AS recall FROM p),
b AS (SELECT *, max(recall) OVER w AS best_prior, max(CASE WHEN recall IS NOT NULL THEN {{'r': recall, 'at': -round}} END) OVER w AS top FROM g WINDOW w AS (PARTITION BY run ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, coalesce(bool_or(best_prior - recall >= 0.08 - 1e-9) OVER (PARTITION BY run ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS halted FROM b)
SELECT run, round, hits, probes, best_prior, -top.at AS best_round, CASE WHEN halted THEN 'after_halt' WHEN probes < 60 THEN 'inadmissible' WHEN best_prior - recall >= 0.08 - 1e-9 THEN 'halt_rollback' ELSE 'continue' END AS decision FROM h"""


def _probes(spark, d):
    """Rounds of ten runs: users in order, their events as probes."""
    e = table(spark, d, "events").groupBy(F.expr("user_id % 10").alias("run"), F.expr("user_id div 10").alias("_at"))
    r = e.agg(F.count_if(F.col("event_type").isin("click", "view", "signup")).alias("hits"), F.count(F.lit(1)).alias("probes"))
    return r.select("run", F.row_number().over(Window.partitionBy("run").orderBy("_at")).cast("long").alias("round"), "hits", "probes")


@query("w12_probe_rounds", _OUTCOMES)
def w12_probes(spark, d):
    """Continue, halt and roll back, or inadmissible below the least number of probes."""
    from strandloom.streaming.monitor import round_outcomes

    return round_outcomes(_probes(spark, d), drop=0.08, minimum=60)


@query("r02_probe_monitor", _OUTCOMES)
def r02_monitor(spark, d):
    """The same decisions as a stream whose files hold rounds in no order."""
    from strandloom.streaming.monitor import watch_rounds

    return watch_rounds(spark, scratch_of(spark, _probes(spark, d).repartition(3, F.xxhash64("run", "round"))), drop=0.08, minimum=60)


_DEB = "b AS (SELECT count(*) AS n, avg(p) AS conf, avg(y) AS acc, sum(p * (1 - p)) AS v FROM (SELECT *, s1 / 1000.0::DOUBLE AS p, ntile(15) OVER (ORDER BY s1, id) AS bin FROM scored) GROUP BY bin)"


@query("m03_debiased_ece", V.with_views("scored", f"WITH {_DEB} SELECT round(sum(n * greatest(0, abs(conf - acc) - sqrt(v) / n * sqrt(2 / pi()))) / sum(n), 9) AS ece FROM b"))
def m03c(spark, d):
    r = M.reliability(V.scored(spark, d).withColumn("p", F.col("s1") / F.lit(1000.0)), p="p", label="y", id_col="id")
    return M.ece(r, gap="debiased_gap").select(F.round("ece", 9).alias("ece"))


@query("m05_brier_decomposition", V.with_views("scored", f"WITH {_DEB}, t AS (SELECT sum(n * acc) / sum(n) AS base FROM b) SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * (conf - acc) * (conf - acc)) / sum(n), 9) AS reliability, round(sum(n * (acc - base) * (acc - base)) / sum(n), 9) AS resolution, round(any_value(base * (1 - base)), 9) AS uncertainty FROM b, t"))
def m05b(spark, d):
    r = M.reliability(V.scored(spark, d).withColumn("p", F.col("s1") / F.lit(1000.0)), p="p", label="y", id_col="id")
    return M.brier_decomposition(r).select("n", *[F.round(c, 9).alias(c) for c in ("reliability", "resolution", "uncertainty")])


@query("m05_bandwidth", V.with_views("scored", f"""WITH g AS (SELECT s1 // 20 / 50.0::DOUBLE AS p, count(*) AS n, CAST(sum(y) AS BIGINT) AS k FROM scored GROUP BY 1), pr AS (SELECT h, a.p, a.n, a.k, b.p AS q, b.n AS m, b.k AS j, greatest(least(a.p, 1 - 1e-12), 1e-12) AS x, greatest(least(b.p, 1 - 1e-12), 1e-12) AS z FROM g a, g b, (VALUES (0.02::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE), (0.3::DOUBLE)) v(h)),
e AS (SELECT h, p, n, k, sum({_KERN} * m) AS w, sum({_KERN} * j) AS wk FROM pr GROUP BY h, p, n, k), o AS (SELECT *, greatest(least((wk - (n > 1)::INT) / nullif(w - (n > 1)::INT, 0), 1 - 1e-12), 1e-12) AS e1, greatest(least(wk / nullif(w - (n > 1)::INT, 0), 1 - 1e-12), 1e-12) AS e0 FROM e), l AS (SELECT h, sum(k * ln(e1) + (n - k) * ln(1 - e0)) AS ll FROM o GROUP BY h)
SELECT h FROM l ORDER BY ll DESC, h LIMIT 1"""))
def m05c(spark, d):
    """The bandwidth of the largest leave-one-out likelihood."""
    s = V.scored(spark, d).selectExpr("(s1 div 20) / 50D AS p", "y")
    return M.choose_bandwidth(M.kernel_calibration(s, p="p", label="y", bandwidths=[0.02, 0.05, 0.1, 0.3])).select("h")


@query("a12_power", V.with_views("scored", "SELECT block, round(sqrt(p * (1 - p) / n), 9) AS se, round((1.959964 + 0.841621) * sqrt(2 * p * (1 - p) / n), 9) AS mde, round(least(1, 0.01 * n / nullif(k, 0)), 9) AS fdr FROM (SELECT block, count(*) AS n, count(*) FILTER (WHERE y = 1) AS k, avg(y) AS p FROM scored GROUP BY block)"))
def a12b(spark, d):
    """Standard error, smallest detectable effect and false-discovery share per block."""
    g = V.scored(spark, d).groupBy("block").agg(_n().alias("n"), F.count_if(F.col("y") == 1).alias("k"))
    n, k = F.col("n"), F.col("k")
    return g.select("block", F.round(S.binomial_se(k, n), 9).alias("se"), F.round(S.minimum_detectable_effect(k / n, n), 9).alias("mde"), F.round(S.false_discovery_budget(F.lit(0.01), n, k), 9).alias("fdr"))


@query("e10_mixed_draws", V.with_views("clades", "SELECT kind, count(*) AS n, round(count(*) / 900.0::DOUBLE, 9) AS share, bool_and(known) AS all_known FROM (SELECT CASE WHEN floor((s + 1) * 0.3::DOUBLE + 1e-9) > floor(s * 0.3::DOUBLE + 1e-9) THEN 'negative' ELSE 'positive' END AS kind, true AS known FROM (SELECT unnest(range(900)) AS s)) GROUP BY kind"))
def e10b(spark, d):
    """Nine hundred draws, three tenths of them negatives, each from its own side."""
    from strandloom.operators.sampling import mix_summary, mixed_draws

    c = V.clades(spark, d).select("record", "family", (F.col("record") % 7 + 1).alias("weight"))
    got = mixed_draws(c.where("family = 'BUILDING'"), c.where("family <> 'BUILDING'"), id_col="record", weight="weight", n=900, negative_share=0.3, seed="mix")
    sides = got.join(c.select("record", "family"), "record").groupBy("kind").agg(F.bool_and((F.col("family") == "BUILDING") == (F.col("kind") == "positive")).alias("all_known"))
    return mix_summary(got, id_col="record").join(sides, "kind").select("kind", "n", F.round("share", 9).alias("share"), "all_known")


@query("m10_duplicate_agreement", V.with_views("scored", "WITH g AS (SELECT s2, max(s1) - min(s1) AS d FROM scored GROUP BY s2 HAVING count(*) > 1) SELECT count(*) AS n_repeated, count(*) FILTER (WHERE d <= 400) AS n_agree, max(d) AS largest FROM g"))
def m10b(spark, d):
    """Payloads scored more than once and whether the scores agree."""
    return M.duplicate_agreement(V.scored(spark, d), payload="s2", posterior="s1", tolerance=400)


@query("m12_auroc_interval", V.with_views("scored", f"WITH {_BOOT}, n AS (SELECT rep, s1, sum(weight) FILTER (WHERE y = 1) AS p, sum(weight) FILTER (WHERE y <> 1) AS q FROM scored JOIN w USING (block) GROUP BY ALL), u AS (SELECT rep, coalesce(p, 0) AS p, coalesce(q, 0) AS q, coalesce(p, 0) * (coalesce(sum(coalesce(q, 0)) OVER (PARTITION BY rep ORDER BY s1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + coalesce(q, 0) / 2.0::DOUBLE) AS u FROM n), a AS (SELECT rep, sum(u) / (sum(p) * sum(q)) AS a FROM u GROUP BY rep), n0 AS (SELECT s1, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y <> 1) AS q FROM scored GROUP BY s1), u0 AS (SELECT p, q, p * (coalesce(sum(q) OVER (ORDER BY s1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + q / 2.0::DOUBLE) AS u FROM n0) SELECT (SELECT count(DISTINCT block) FROM scored) AS n_blocks, round((SELECT sum(u) / (sum(p) * sum(q)) FROM u0), 9) AS auroc, round(quantile_cont(a, 0.025), 7) AS lo, round(quantile_cont(a, 0.975), 7) AS hi FROM a"))
def m12b(spark, d):
    """AUROC with an interval over replicates of whole blocks."""
    r = M.auroc_interval(V.scored(spark, d), score="s1", label="y", block="block", replicates=200, seed="m07")
    return r.select("n_blocks", F.round("auroc", 9).alias("auroc"), F.round("lo", 7).alias("lo"), F.round("hi", 7).alias("hi"))


@query("m11_composition_probe", V.with_views("drawn_contigs", "WITH f AS (SELECT contig_id, length(regexp_replace(seq, '[^GC]', '', 'g'))::DOUBLE / length(seq) AS gc, seq, (('0x' || substr(md5(concat('m11:', contig_id)), 1, 8))::BIGINT % 2) AS coin FROM drawn_contigs), l AS (SELECT 'composition' AS label, gc, (gc > 0.5)::INT AS y FROM f UNION ALL SELECT 'coin', gc, coin FROM f), r AS (SELECT label, y, rank() OVER (PARTITION BY label ORDER BY gc) + (count(*) OVER (PARTITION BY label, gc) - 1) / 2.0::DOUBLE AS r FROM l), a AS (SELECT label, count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y = 0) AS n_neg, (sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (WHERE y = 1)::DOUBLE * count(*) FILTER (WHERE y = 0)) AS a FROM r GROUP BY label) SELECT label, n_pos, n_neg, a >= 0.8 AS separable FROM a"))
def m11b(spark, d):
    """Cross-validated probes on 2-mer frequencies for a label that follows composition
    and for a coin; SQL ranks by the share of G and C instead."""
    from strandloom.operators.probe import composition_probe, separability

    gc = F.length(F.regexp_replace("seq", "[^GC]", "")) / F.length("seq")
    c = V.drawn_contigs(spark, d)
    out = None
    for name, y in (("composition", gc > 0.5), ("coin", F.conv(F.substring(F.md5(F.concat(F.lit("m11:"), F.col("contig_id").cast("string"))), 1, 8), 16, 10).cast("long") % 2)):
        s = composition_probe(c.withColumn("y", y.cast("int")), id_col="contig_id", seq_col="seq", label="y", k=2, folds=3, seed="m11")
        one = separability(M.auroc(s, score="score", label="y")).select(F.lit(name).alias("label"), "n_pos", "n_neg", (F.col("verdict") == "clear").alias("separable"))
        out = one if out is None else out.unionByName(one)
    return out
