"""Queries on evidence, taxa, unions and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import admission as A
from strandloom.operators import cohorts as H
from strandloom.operators import evidence as E
from strandloom.operators import taxonomy as X
from strandloom.operators import validation as C
from strandloom.plans import views as V
from strandloom.plans.registry import query
from strandloom.session import table

def _n():
    return F.count(F.lit(1))

_EV = "ev AS (SELECT id, CASE WHEN s1 % 3 = 0 THEN NULL ELSE s1 % 3 = 1 END AS covariation, CASE WHEN s2 % 4 = 0 THEN NULL ELSE s2 % 4 = 1 END AS synteny, CASE WHEN s1 % 5 = 0 THEN NULL ELSE s1 % 5 > 3 END AS architecture, CASE WHEN s2 % 7 = 0 THEN NULL ELSE s2 >= 900 END AS posterior FROM scored)"


def _evidence(spark, d):
    s = V.scored(spark, d)
    return s.selectExpr("id"), {
        "covariation": s.selectExpr("id", "if(s1 % 3 = 0, NULL, s1 % 3 = 1) AS covariation"), "synteny": s.selectExpr("id", "if(s2 % 4 = 0, NULL, s2 % 4 = 1) AS synteny"),
        "architecture": s.selectExpr("id", "if(s1 % 5 = 0, NULL, s1 % 5 > 3) AS architecture"), "posterior": s.selectExpr("id", "if(s2 % 7 = 0, NULL, s2 >= 900) AS posterior"),
    }


@query("j10_evidence_assembly", V.with_views("scored", f"WITH {_EV} SELECT * FROM ev"))
def j10(spark, d):
    manifest, tables = _evidence(spark, d)
    return E.assemble_evidence(manifest, tables, "id")


@query("e30_spare_rule", V.with_views("scored", f"WITH {_EV} SELECT id, coalesce(covariation OR synteny OR architecture OR posterior, true) AS spared, concat_ws(';', {', '.join(f'CASE WHEN {c} IS NULL THEN {chr(39)}unavailable:{c}{chr(39)} WHEN {c} THEN {chr(39)}passed:{c}{chr(39)} END' for c in ('covariation', 'synteny', 'architecture', 'posterior'))}) AS reason FROM ev"))
def e30(spark, d):
    manifest, tables = _evidence(spark, d)
    return E.spare_rule(E.assemble_evidence(manifest, tables, "id"), {c: c for c in tables}).select("id", "spared", "reason")


@query("c09_spared_split", V.with_views("scored", f"WITH {_EV}, r AS (SELECT id, unnest([CASE WHEN covariation IS NULL THEN 'unavailable:covariation' WHEN covariation THEN 'passed:covariation' END, CASE WHEN synteny IS NULL THEN 'unavailable:synteny' WHEN synteny THEN 'passed:synteny' END]) AS cause FROM ev) SELECT cause, count(*) AS n FROM r WHERE cause IS NOT NULL GROUP BY cause"))
def c09(spark, d):
    """Spared candidates split by cause; one may have several."""
    manifest, tables = _evidence(spark, d)
    two = {c: tables[c] for c in ("covariation", "synteny")}
    r = E.spare_rule(E.assemble_evidence(manifest, two, "id"), {c: c for c in two})
    return A.spared_causes(r)


@query("c09_threshold_sensitivity", V.with_views("scored", "WITH o AS (SELECT t AS threshold, s2 >= t AS spared, sha256(concat(id, CASE WHEN s2 >= t THEN ':spared' ELSE ':mined' END)) AS h FROM scored, (VALUES (300), (600), (900)) v(t)), g AS (" + V.digest_sql("SELECT threshold, h FROM o", "threshold") + ") SELECT threshold, spared, mined, digest AS fingerprint FROM g JOIN (SELECT threshold, count(*) FILTER (WHERE spared) AS spared, count(*) FILTER (WHERE NOT spared) AS mined FROM o GROUP BY threshold) USING (threshold)"))
def c09b(spark, d):
    """Outcome counts and their fingerprint at each threshold."""
    return A.threshold_sensitivity(V.scored(spark, d), id_col="id", score="s2", thresholds=[300, 600, 900])


@query("j11_idle_tables", V.with_views("scored", f"WITH {_EV} SELECT evidence, n_decided, n_decided = 0 AS idle FROM (SELECT 'covariation' AS evidence, count(covariation) AS n_decided FROM ev UNION ALL SELECT 'synteny', count(synteny) FROM ev UNION ALL SELECT 'foreign', 0)"))
def j11(spark, d):
    manifest, tables = _evidence(spark, d)
    foreign = tables["posterior"].selectExpr("-1 - id AS id", "posterior AS foreign")
    return E.refuse_idle_tables(manifest, {"covariation": tables["covariation"], "synteny": tables["synteny"], "foreign": foreign}, "id")


@query("j12_probe_exclusion", "SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def j12(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("j09_strand_policy", V.with_views("scored", "SELECT id, CASE WHEN a OR b THEN true WHEN a IS NULL OR b IS NULL THEN NULL ELSE false END AS st FROM (SELECT id, CASE WHEN s1 % 3 = 0 THEN NULL ELSE s1 % 3 = 1 END AS a, CASE WHEN s2 % 3 = 0 THEN NULL ELSE s2 % 3 = 1 END AS b FROM scored)"))
def j09(spark, d):
    s = V.scored(spark, d)
    both = s.selectExpr("id", "if(s1 % 3 = 0, NULL, s1 % 3 = 1) AS st").unionByName(s.selectExpr("id", "if(s2 % 3 = 0, NULL, s2 % 3 = 1) AS st"))
    return E.combine_strands(both, "id", "st", "any")


_GENE_NEAR = """c AS (SELECT DISTINCT locus_id, acc, strand, CASE WHEN strand = 1 THEN hi ELSE -lo END AS x FROM candidates), g AS (SELECT acc, strand, gene_id, product, CASE WHEN strand = 1 THEN lo ELSE -hi END AS g, CASE WHEN strand = 1 THEN hi ELSE -lo END AS e FROM genes)"""


@query("j08_downstream_gene", V.with_views("candidates genes", f"WITH {_GENE_NEAR}, j AS (SELECT locus_id, gene_id, product, g - x AS distance, row_number() OVER (PARTITION BY locus_id ORDER BY g - x, gene_id, product) AS r FROM c JOIN g USING (acc, strand) WHERE g - x BETWEEN -10 AND 500) SELECT DISTINCT locus_id, gene_id, distance FROM (SELECT DISTINCT locus_id FROM c) l LEFT JOIN (SELECT * FROM j WHERE r = 1) USING (locus_id)"))
def j08(spark, d):
    c = V.candidates(spark, d).select("locus_id", "acc", "strand", "lo", "hi").distinct()
    return E.downstream_gene(c, V.genes(spark, d), id_col="locus_id", window=500, overlap=10).select("locus_id", "gene_id", "distance")


@query("j08_gene_hops", V.with_views("candidates genes", f"""WITH {_GENE_NEAR}, gg AS (SELECT *, product NOT LIKE '%ring%' AS ok FROM g),
h0 AS (SELECT c.locus_id, c.acc, c.strand, gene_id, ok, e, row_number() OVER (PARTITION BY c.locus_id ORDER BY g, gene_id) AS r FROM c JOIN gg USING (acc, strand) WHERE g > x AND g <= x + 400),
h1 AS (SELECT h.locus_id, h.acc, h.strand, b.gene_id, b.ok, row_number() OVER (PARTITION BY h.locus_id ORDER BY b.g, b.gene_id) AS r FROM h0 h JOIN gg b USING (acc, strand) WHERE h.r = 1 AND NOT h.ok AND b.g > h.e AND b.g <= h.e + 400)
SELECT l.locus_id, coalesce(a.gene_id, b.gene_id) AS gene_id, CASE WHEN a.gene_id IS NOT NULL THEN 0 WHEN b.gene_id IS NOT NULL THEN 1 END AS n_hops FROM (SELECT DISTINCT locus_id FROM c) l LEFT JOIN h0 a ON a.locus_id = l.locus_id AND a.r = 1 AND a.ok LEFT JOIN h1 b ON b.locus_id = l.locus_id AND b.r = 1 AND b.ok"""))
def j08b(spark, d):
    c = V.candidates(spark, d).select("locus_id", "acc", "strand", "lo", "hi").distinct()
    return E.hop_genes(c, V.genes(spark, d), id_col="locus_id", window=400, hops=1, judgeable=~F.col("product").contains("ring"))


_RULES = [("regulator", "widget|valve"), ("enzyme", "gear|bolt"), ("transport", "ring")]


@query("e26_gene_classes", V.with_views("genes", "SELECT cls, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN regexp_matches(lower(product), '{p}') THEN '{c}'" for c, p in _RULES) + " ELSE 'unjudgeable' END AS cls FROM genes) GROUP BY cls"))
def e26(spark, d):
    return V.genes(spark, d).select(E.classify_products(F.col("product"), _RULES).alias("cls")).groupBy("cls").agg(_n().alias("n"))


@query("e27_synteny_status", V.with_views("candidates genes", f"""WITH {_GENE_NEAR}, j AS (SELECT locus_id, product, g - x AS distance, row_number() OVER (PARTITION BY locus_id ORDER BY g - x, gene_id, product) AS r FROM c JOIN g USING (acc, strand) WHERE g - x BETWEEN -10 AND 500)
SELECT locus_id, CASE WHEN product IS NULL THEN NULL ELSE regexp_matches(product, 'widget|valve|gear|bolt') AND distance <= 300 END AS status FROM (SELECT DISTINCT locus_id FROM c) l LEFT JOIN (SELECT * FROM j WHERE r = 1) USING (locus_id)"""))
def e27(spark, d):
    """Passed if the nearest downstream gene is of a wanted class and close; no gene is unavailable."""
    c = V.candidates(spark, d).select("locus_id", "acc", "strand", "lo", "hi").distinct()
    g = E.downstream_gene(c, V.genes(spark, d), id_col="locus_id", window=500, overlap=10)
    return E.synteny_status(g, rules=_RULES, wanted=["regulator", "enzyme"], within=300).select("locus_id", "status")


@query("a22_covariation", "WITH p AS (SELECT user_id AS aln, event_id % 5 AS helix, event_type = 'click' AS cov FROM events), h AS (SELECT aln, helix, count(*) FILTER (WHERE cov) AS c FROM p GROUP BY ALL), a AS (SELECT aln, max(c) AS best_helix, CAST(sum(c) AS BIGINT) AS summed FROM h GROUP BY aln), dp AS (SELECT user_id AS aln, count(*) AS depth FROM events GROUP BY user_id) SELECT aln, depth, best_helix, summed, CASE WHEN depth >= 60 THEN best_helix >= 5 END AS status FROM dp JOIN a USING (aln)")
def a22(spark, d):
    e = table(spark, d, "events")
    p = e.selectExpr("user_id AS aln", "event_id % 5 AS helix", "event_type")
    depth = e.groupBy(F.col("user_id").alias("aln")).agg(_n().alias("depth"))
    return E.covariation_status(p, key="aln", helix="helix", covarying=F.col("event_type") == "click", minimum=5, depth=depth, floor=60)


@query("a23_best_hits", "SELECT l_suppkey, l_partkey, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_discount, l_orderkey, l_linenumber) AS r FROM lineitem WHERE l_quantity >= 10) WHERE r = 1")
def a23(spark, d):
    """Best hit per (query, subject) after the filter: smallest E, first seen on a tie."""
    from strandloom.operators.selection import top_per_group

    return top_per_group(table(spark, d, "lineitem").where("l_quantity >= 10"), ["l_suppkey", "l_partkey"], [F.col("l_discount"), F.col("l_orderkey"), F.col("l_linenumber")], 1).select("l_suppkey", "l_partkey", "l_orderkey")


@query("a24_target_integrity", "WITH a AS (SELECT c_nationkey AS k, count(*) AS n, CAST(sum(length(c_name)) AS BIGINT) AS bp FROM customer GROUP BY 1), b AS (SELECT k, CASE WHEN k % 6 = 0 THEN n + 1 ELSE n END AS n, bp FROM a WHERE k <> 3 UNION ALL SELECT 99, 1, 1) SELECT coalesce(a.k, b.k) AS k, a.n AS a_n, a.bp AS a_bp, b.n AS b_n, b.bp AS b_bp, CASE WHEN b.k IS NULL THEN 'left_only' WHEN a.k IS NULL THEN 'right_only' ELSE 'differs' END AS side FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.n IS DISTINCT FROM b.n OR a.bp IS DISTINCT FROM b.bp")
def a24(spark, d):
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(_n().alias("n"), F.sum(F.length("c_name")).alias("bp"))
    b = a.where("k <> 3").withColumn("n", F.expr("if(k % 6 = 0, n + 1, n)")).unionByName(spark.range(1).selectExpr("99 AS k", "1L AS n", "1L AS bp"))
    return X.full_join_mismatch(a, b, "k", ["n", "bp"])


@query("a27_false_pass", V.with_views("scored", f"WITH {_EV} SELECT s.y AS arm, count(*) AS n, count(synteny) AS decided, count(*) FILTER (WHERE synteny) AS passed, round(count(*) FILTER (WHERE synteny)::DOUBLE / nullif(count(synteny), 0), 6) AS rate FROM ev JOIN scored s USING (id) GROUP BY s.y"))
def a27(spark, d):
    """False-pass rate of each control arm over decided rows."""
    _, tables = _evidence(spark, d)
    j = tables["synteny"].join(V.scored(spark, d).select("id", F.col("y").alias("arm")), "id")
    return A.false_pass_rates(j, arm="arm", verdict="synteny").withColumn("rate", F.round("rate", 6))


@query("a27_exclusions", "SELECT reason, lang, count(*) AS n FROM (SELECT lang, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars > 9000 THEN 'long' ELSE 'kept' END AS reason FROM documents) GROUP BY GROUPING SETS ((reason), (reason, lang))")
def a27b(spark, d):
    docs = table(spark, d, "documents").selectExpr("lang", "CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars > 9000 THEN 'long' ELSE 'kept' END AS reason")
    return docs.groupingSets([["reason"], ["reason", "lang"]], "reason", "lang").agg(_n().alias("n"))


_TREE = """nodes AS (SELECT 1 AS taxid, 1 AS parent, 'root' AS rank UNION ALL SELECT 100 + r_regionkey, 1, 'phylum' FROM region UNION ALL SELECT 1000 + n_nationkey, 100 + n_regionkey, 'genus' FROM nation UNION ALL SELECT 100000 + c_custkey, 1000 + c_nationkey, 'species' FROM customer),
merged AS (SELECT 900000 + c_custkey AS old, 100000 + c_custkey AS new FROM customer WHERE c_custkey % 7 = 0), ids AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN 900000 ELSE 100000 END + c_custkey AS taxid FROM customer)"""


def _tree(spark, d):
    r, n, c = (table(spark, d, t) for t in ("region", "nation", "customer"))
    nodes = spark.range(1).selectExpr("1L AS taxid", "1L AS parent", "'root' AS rank")
    nodes = nodes.unionAll(r.selectExpr("100L + r_regionkey", "1L", "'phylum'")).unionAll(n.selectExpr("1000L + n_nationkey", "100L + n_regionkey", "'genus'")).unionAll(c.selectExpr("100000L + c_custkey", "1000L + c_nationkey", "'species'"))
    merged = c.where("c_custkey % 7 = 0").selectExpr("900000L + c_custkey AS old", "100000L + c_custkey AS new")
    return nodes, merged, c.selectExpr("if(c_custkey % 7 = 0, 900000L, 100000L) + c_custkey AS taxid")


@query("e23_lineages", f"WITH RECURSIVE {_TREE}, w AS (SELECT i.taxid, coalesce(m.new, i.taxid) AS node FROM (SELECT DISTINCT taxid FROM ids) i LEFT JOIN merged m ON m.old = i.taxid UNION ALL SELECT w.taxid, n.parent FROM w JOIN nodes n ON n.taxid = w.node WHERE n.parent <> n.taxid) SELECT w.taxid, n.rank, w.node AS ancestor FROM w JOIN nodes n ON n.taxid = w.node")
def e23(spark, d):
    nodes, merged, ids = _tree(spark, d)
    return X.lineage_by_rank(ids, nodes, merged)


@query("e24_reconciled_names", "SELECT c_custkey, n AS name, CASE WHEN n IN (SELECT n_name FROM nation) THEN n WHEN starts_with(n, 'OLD_') THEN substr(n, 5) END AS resolved, CASE WHEN n IN (SELECT n_name FROM nation) THEN 'corpus' WHEN starts_with(n, 'OLD_') THEN 'synonym' ELSE 'unresolved' END AS source FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN n_name WHEN 1 THEN concat('OLD_', n_name) ELSE concat('X', n_name) END AS n FROM customer JOIN nation ON c_nationkey = n_nationkey)")
def e24(spark, d):
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    rows = c.join(n, c.c_nationkey == n.n_nationkey).selectExpr("c_custkey", "CASE c_custkey % 3 WHEN 0 THEN n_name WHEN 1 THEN concat('OLD_', n_name) ELSE concat('X', n_name) END AS name")
    return X.reconcile_names(rows, n.select(F.col("n_name").alias("name")), n.selectExpr("concat('OLD_', n_name) AS alias", "n_name AS name"), name="name")


@query("e25_projection", "WITH u AS (SELECT n_name AS name FROM nation UNION ALL SELECT concat(n_name, '_A') FROM nation WHERE n_nationkey % 4 = 0), q AS (SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 1 THEN 'NOWHERE' ELSE n_name END AS phylum FROM nation) SELECT n_nationkey, phylum, name AS projected, CASE WHEN name IS NULL THEN 'absent' WHEN name = phylum THEN 'exact' ELSE 'split' END AS method FROM q LEFT JOIN u ON regexp_replace(u.name, '_[A-Z]+$', '') = phylum")
def e25(spark, d):
    n = table(spark, d, "nation")
    u = n.selectExpr("n_name AS name").unionAll(n.where("n_nationkey % 4 = 0").selectExpr("concat(n_name, '_A')"))
    return X.project_split_names(n.selectExpr("n_nationkey", "if(n_nationkey % 5 = 1, 'NOWHERE', n_name) AS phylum"), u, name="phylum")


@query("s04_lineage_scan", V.with_views("clades", "SELECT record, phylum AS p, family AS f, genus AS g FROM clades"))
def s04(spark, d):
    c = V.clades(spark, d).selectExpr("record", "concat('d__Root;p__', phylum, ';f__', family, ';g__', genus) AS lineage")
    m = X.parse_lineage("lineage")
    return c.select("record", m["p"].alias("p"), m["f"].alias("f"), m["g"].alias("g"))


@query("s04_clade_universe", V.with_views("clades", "SELECT DISTINCT * FROM (SELECT 'p' AS rank, phylum AS name FROM clades UNION ALL SELECT 'f', family FROM clades UNION ALL SELECT 'g', genus FROM clades)"))
def s04b(spark, d):
    return X.clade_universe(V.clades(spark, d).selectExpr("concat('d__;p__', phylum, ';f__', family, ';g__', genus) AS lineage"), "lineage")


@query("j20_host_placement", V.with_views("clades", "SELECT record, coalesce(CASE WHEN record % 3 = 0 THEN phylum END, CASE WHEN record % 3 = 1 THEN genus END, 'unplaced') AS placed FROM clades"))
def j20(spark, d):
    """Organism to lineage by name, the exact name before the genus."""
    c = V.clades(spark, d)
    exact, genus = c.where("record % 3 = 0").select("name", F.col("phylum").alias("e")), c.where("record % 3 = 1").select("name", F.col("genus").alias("g"))
    return c.select("record", "name").join(exact, "name", "left").join(genus, "name", "left").select("record", F.coalesce("e", "g", F.lit("unplaced")).alias("placed"))


@query("u01_union_prior", "WITH cur AS (SELECT DISTINCT concat('ACC', l_suppkey) AS a FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey % 2 = 0) SELECT source, count(*) AS n, count(locus_start) AS with_locus FROM (SELECT 'curated' AS source, a, 1 AS locus_start FROM cur UNION ALL SELECT 'reference', concat('ACC', s_suppkey), s_suppkey FROM supplier WHERE concat('ACC', s_suppkey) NOT IN (SELECT a FROM cur) UNION ALL SELECT 'literature', NULL, NULL FROM region) GROUP BY source")
def u01(spark, d):
    cur = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_suppkey % 2 = 0").selectExpr("concat('ACC', l_suppkey) AS accession", "1L AS locus_start").distinct()
    ref = table(spark, d, "supplier").selectExpr("concat('ACC', s_suppkey) AS accession", "s_suppkey AS locus_start")
    lit = table(spark, d, "region").selectExpr("r_name AS clade")
    return X.union_prior(cur, ref, lit).groupBy("source").agg(_n().alias("n"), F.count("locus_start").alias("with_locus"))


@query("u03_shard_merge", "SELECT o_orderkey, count(*) AS n FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) GROUP BY o_orderkey HAVING count(*) > 1")
def u03(spark, d):
    """Keys found in two shards; a clean merge has none."""
    o = table(spark, d, "orders").select("o_orderkey")
    return X.merge_shards([o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0")], "o_orderkey")[1]


@query("u04_prior_clades", V.with_views("clades", "SELECT DISTINCT genus, genus IN (SELECT genus FROM clades WHERE family = 'BUILDING' AND record % 20 = 0) AS has_prior FROM clades"))
def u04(spark, d):
    c = V.clades(spark, d)
    prior = c.where("family = 'BUILDING' AND record % 20 = 0").select("genus").distinct().withColumn("h", F.lit(True))
    return c.select("genus").distinct().join(prior, "genus", "left").select("genus", F.coalesce("h", F.lit(False)).alias("has_prior"))


@query("u06_orphans", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'left_only' ELSE 'right_only' END AS side FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) a FULL JOIN (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderkey % 10 <> 0) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def u06(spark, d):
    a = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    b = table(spark, d, "orders").where("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("k")).distinct()
    return X.full_join_mismatch(a, b, "k", [])


@query("j05_three_way_join", "SELECT doc_id, d.lang, l.quality, x.n FROM documents d JOIN labels l USING (doc_id) JOIN (SELECT doc_id, length(text) AS n FROM documents) x USING (doc_id)")
def j05(spark, d):
    """Strict one-to-one join of three tables; a repeated or lost row is an error."""
    from strandloom.operators.joins import strict_join

    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    base = labels.select("doc_id", "quality")
    return strict_join(base, [docs.select("doc_id", "lang"), docs.select("doc_id", F.length("text").cast("long").alias("n"))], "doc_id")


@query("j06_dataset_assembly", "SELECT pool, refusal, count(*) AS n FROM (SELECT 'positive' AS pool, CASE WHEN l.quality IS NULL THEN 'no_label' WHEN d.n_chars < 100 THEN 'short' ELSE 'kept' END AS refusal FROM documents d LEFT JOIN labels l USING (doc_id) UNION ALL SELECT 'decoy', CASE WHEN d.doc_id IS NULL THEN 'no_parent' ELSE 'kept' END FROM benchmark b LEFT JOIN (SELECT * FROM documents WHERE doc_id % 3 = 0) d ON b.item_id = d.doc_id) GROUP BY ALL")
def j06(spark, d):
    """Positives with their labels and decoys with their parents, with a refusal census."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    pos = docs.join(table(spark, d, "labels"), "doc_id", "left").select(F.col("doc_id").alias("row_id"), "n_chars", "quality", F.lit(None).cast("boolean").alias("parent"))
    parents = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("item_id"), F.lit(True).alias("parent"))
    dec = table(spark, d, "benchmark").select("item_id").join(parents, "item_id", "left").selectExpr("item_id AS row_id", "cast(NULL AS bigint) AS n_chars", "cast(NULL AS int) AS quality", "parent")
    return A.assemble_pools({
        "positive": (pos, [("no_label", F.expr("quality IS NULL")), ("short", F.expr("n_chars < 100"))]), "decoy": (dec, [("no_parent", F.expr("parent IS NULL"))]),
    })[1]


@query("j07_parent_folds", V.with_views("splits", "SELECT fold, count(*) AS n FROM (SELECT o_orderkey, s.fold FROM orders LEFT JOIN splits s ON s.record = o_custkey AND o_custkey % 4 <> 0) GROUP BY fold"))
def j07(spark, d):
    """Variants take their parent's fold; those without one are counted."""
    s = V.splits(spark, d).where("record % 4 <> 0").select(F.col("record").alias("o_custkey"), "fold")
    return H.stamp_parents(table(spark, d, "orders").select("o_custkey"), s, parent="o_custkey", columns=["fold"]).groupBy("fold").agg(_n().alias("n"))


@query("j13_hit_windows", "WITH w AS (SELECT c_custkey AS win, c_custkey % 3 AS arm FROM customer), h AS (SELECT o_custkey AS win, o_totalprice AS score FROM orders) SELECT arm, (SELECT count(*) FROM h JOIN w w2 USING (win) WHERE w2.arm = w.arm) AS joined, count(*) AS windows, count(*) FILTER (WHERE win IN (SELECT win FROM h WHERE score >= 400000)) AS removed FROM w GROUP BY arm")
def j13(spark, d):
    """A window goes if any hit reaches the score; hits joined are counted."""
    w = table(spark, d, "customer").selectExpr("c_custkey AS win", "c_custkey % 3 AS arm")
    h = table(spark, d, "orders").selectExpr("o_custkey AS win", "o_totalprice AS score")
    return H.hit_windows(w, h, window="win", score="score", at_least=400000, by=["arm"])


@query("j14_payload_lookup", V.with_views("contigs", "SELECT contig_id, start0, sha256(concat_ws('|', w, 'v1')) AS payload, ('0x' || substr(sha256(concat_ws('|', w, 'v1')), 1, 6))::BIGINT % 1000 / 10.0::DOUBLE AS logit FROM (SELECT contig_id, s AS start0, substr(seq, s + 1, 2) AS w FROM (SELECT contig_id, seq, unnest([0, 7, 19]) AS s FROM contigs))"))
def j14(spark, d):
    """Scores keyed by content, one per distinct payload, found for every window; a
    payload without one is an error."""
    from strandloom.operators.joins import lookup_or_fail

    key = F.sha2(F.concat_ws("|", F.substr("seq", F.col("start0") + 1, F.lit(2)), F.lit("v1")), 256)
    p = V.contigs(spark, d).select("contig_id", "seq", F.explode(F.array(F.lit(0), F.lit(7), F.lit(19))).alias("start0")).select("contig_id", "start0", key.alias("payload"))
    scores = p.select("payload").distinct().withColumn("logit", F.conv(F.substring("payload", 1, 6), 16, 10).cast("long") % 1000 / F.lit(10.0))
    return lookup_or_fail(p, scores, "payload", "logit")


@query("j15_item_scores", "SELECT c_custkey AS item, coalesce(max(o_totalprice), -1.0) AS score, count(o_orderkey) AS n_rows FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def j15(spark, d):
    """Best score of each item's rows, a sentinel if it was never called."""
    from strandloom.operators.joins import item_scores

    return item_scores(table(spark, d, "customer").select(F.col("c_custkey").alias("item")), table(spark, d, "orders").select(F.col("o_custkey").alias("item"), F.col("o_totalprice").alias("score")), uncalled=-1.0)


@query("j22_setting_prices", V.with_views("scored", "WITH g AS (SELECT * FROM (VALUES (1, 300, 500), (2, 500, 700), (3, 700, 900)) v(setting, t1, t2)) SELECT setting, count(*) FILTER (WHERE NOT (s1 >= t1 OR s2 >= t2)) AS mined, count(*) FILTER (WHERE NOT (s1 >= t1)) AS ceiling, count(*) FILTER (WHERE y = 1 AND NOT (s1 >= t1 OR s2 >= t2)) AS damaged FROM scored, g GROUP BY setting"))
def j22(spark, d):
    """Mined candidates, ceiling and damage to known controls at each setting."""
    grid = [{"s1": a, "s2": b} for a, b in ((300, 500), (500, 700), (700, 900))]
    return H.price_settings(V.scored(spark, d), settings=grid, scores=["s1", "s2"], known=F.col("y") == 1)


@query("j23_sourcing_audit", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'unresolved' WHEN l.toxic = 1 THEN 'refused' WHEN d.lang <> 'en' THEN 'foreign' ELSE 'placed' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY status")
def j23(spark, d):
    j = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    rules = [("unresolved", F.expr("quality IS NULL")), ("refused", F.expr("toxic = 1")), ("foreign", F.expr("lang <> 'en'"))]
    return j.select(C.first_reason(rules, "placed").alias("status")).groupBy("status").agg(_n().alias("n"))


_PAIR = "SELECT a.id AS x, b.id AS y, list_sum(list_transform(list_zip(a.codes, b.codes), lambda p: CASE WHEN p[1] = p[2] AND p[1] >= 0 THEN 1 ELSE 0 END)) AS same, list_sum(list_transform(list_zip(a.codes, b.codes), lambda p: CASE WHEN p[1] >= 0 AND p[2] >= 0 THEN 1 ELSE 0 END)) AS known FROM codes a, codes b"


@query("j17_c01_similarity_clusters", V.with_views("codes", f"WITH RECURSIVE pr AS ({_PAIR} WHERE a.id <> b.id), e AS (SELECT x, y FROM pr WHERE known >= 0.7 * 64 AND same >= 0.40 * known), w AS (SELECT id AS x, id AS y FROM codes UNION SELECT w.x, e.y FROM w JOIN e ON e.x = w.y) SELECT x AS id, min(y) AS cluster FROM w GROUP BY x"))
def j17(spark, d):
    """All-pairs links at an identity and a coverage, then single linkage."""
    from strandloom.operators.cluster import connected_components
    from strandloom.operators.similarity import similarity_links

    codes = V.codes(spark, d)
    links = similarity_links(codes, id_col="id", codes="codes", identity=0.40, coverage=0.7)
    comp = connected_components(links).select(F.col("node").alias("id"), "component")
    return codes.select("id").join(comp, "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))


@query("j18_nearest_across_folds", V.with_views("codes", f"WITH pr AS ({_PAIR} WHERE a.id % 4 = 0 AND b.id % 4 <> 0) SELECT x AS id, round(coalesce(max(same::DOUBLE / known) FILTER (WHERE known >= 0.7 * 64), -1), 9) AS identity FROM pr GROUP BY x"))
def j18(spark, d):
    from strandloom.operators.similarity import nearest_across

    codes = V.codes(spark, d)
    return nearest_across(codes.where("id % 4 = 0"), codes.where("id % 4 <> 0"), id_col="id", codes="codes", coverage=0.7).withColumn("identity", F.round("identity", 9))


_EDITED = "SELECT id, codes FROM codes UNION ALL SELECT id + 1000000, list_transform(range(64), lambda i: CASE WHEN (i = id % 64 OR i = (id * 7) % 61) AND codes[i + 1] >= 0 THEN (codes[i + 1] + 1) % 4 ELSE codes[i + 1] END) FROM codes WHERE id % 3 = 0"


def _edited(spark, d):
    """The codes, and every third vector again with two codes changed."""
    c = V.codes(spark, d).select("id", "codes")
    changed = F.expr("transform(codes, (c, i) -> IF((i = id % 64 OR i = (id * 7) % 61) AND c >= 0, (c + 1) % 4, c))")
    return c.unionByName(c.where("id % 3 = 0").select((F.col("id") + 1000000).alias("id"), changed.alias("codes")))


@query("j17_banded_clusters", V.with_views("codes", f"WITH RECURSIVE c AS ({_EDITED}), pr AS ({_PAIR.replace('FROM codes a, codes b', 'FROM c a, c b')} WHERE a.id <> b.id), e AS (SELECT x, y FROM pr WHERE known >= 0.8 * 64 AND same >= 0.95 * known), w AS (SELECT id AS x, id AS y FROM c UNION SELECT w.x, e.y FROM w JOIN e ON e.x = w.y) SELECT x AS id, min(y) AS cluster FROM w GROUP BY x"))
def j17_banded(spark, d):
    """Links at a high identity, which meet in bands, then single linkage."""
    from strandloom.operators.cluster import connected_components
    from strandloom.operators.similarity import similarity_links

    links = similarity_links(_edited(spark, d), id_col="id", codes="codes", identity=0.95, coverage=0.8)
    return connected_components(links).select(F.col("node").alias("id"), F.col("component").alias("cluster"))


@query("j18_nearest_banded", V.with_views("codes", f"WITH c AS ({_EDITED}), pr AS ({_PAIR.replace('FROM codes a, codes b', 'FROM c a, c b')} WHERE a.id >= 1000000 AND b.id < 1000000 AND b.id % 4 <> 0) SELECT x AS id, round(coalesce(max(same::DOUBLE / known) FILTER (WHERE known >= 0.8 * 64), -1), 9) AS identity FROM pr GROUP BY x"))
def j18_banded(spark, d):
    """Changed vectors against three in four of the others; those whose own is absent
    fall back to all of them."""
    from strandloom.operators.similarity import nearest_across

    c = _edited(spark, d)
    found = nearest_across(c.where("id >= 1000000"), c.where("id < 1000000 AND id % 4 <> 0"), id_col="id", codes="codes", coverage=0.8, floor=0.95)
    return found.withColumn("identity", F.round("identity", 9))


@query("c01_cut_sweep", V.with_views("splits", "WITH RECURSIVE e AS (SELECT a.record AS x, b.record AS y, (a.record + b.record) % 100 AS w FROM splits a JOIN splits b ON a.cluster_id = b.cluster_id AND a.record <> b.record), c AS (SELECT unnest([30, 60, 90]) AS cut), r AS (SELECT cut, record AS x, record AS y FROM splits, c UNION SELECT r.cut, r.x, e.y FROM r JOIN e ON e.x = r.y AND e.w >= r.cut), m AS (SELECT cut, x, min(y) AS component FROM r GROUP BY cut, x) SELECT cut, x AS record, component, dense_rank() OVER (PARTITION BY cut ORDER BY component) - 1 AS label FROM m"))
def c01(spark, d):
    """Single linkage at three cuts, with labels from 0 by first appearance in each."""
    from strandloom.operators.cluster import cut_sweep, dense_labels

    s = V.splits(spark, d).select("record", "cluster_id")
    e = s.withColumnRenamed("record", "a").join(s.withColumnRenamed("record", "b"), "cluster_id").where("a < b").withColumn("w", F.expr("(a + b) % 100"))
    swept = cut_sweep(e, s, weight="w", cuts=[30, 60, 90], node="record")
    out = [dense_labels(swept.where(F.col("cut") == c)) for c in (30, 60, 90)]
    return out[0].unionByName(out[1]).unionByName(out[2]).select("cut", "record", "component", "label")


@query("e30_round_readiness", V.with_views("scored", f"WITH {_EV} SELECT count(*) AS n, count(*) FILTER (WHERE NOT coalesce(covariation, false) AND NOT coalesce(synteny, false)) AS maximum_yield, count(covariation) AS n_covariation, count(synteny) AS n_synteny, count(*) FILTER (WHERE NOT coalesce(covariation, false) AND NOT coalesce(synteny, false)) > 0 AND count(covariation) > 0 AND count(synteny) > 0 AS ready FROM ev"))
def e30b(spark, d):
    """What full evidence could leave to mine, and whether every table decides something."""
    manifest, tables = _evidence(spark, d)
    two = {c: tables[c] for c in ("covariation", "synteny")}
    return E.round_readiness(E.assemble_evidence(manifest, two, "id"), {c: c for c in two})
