"""Queries on readers and sinks, over files or file contents derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions.loci import rounded
from strandloom.plans import views as V
from strandloom.plans.registry import query
from strandloom.session import scratch_path, table
from strandloom.sources import scans as R

def _n():
    return F.count(F.lit(1))



@query("s01_corpus_csv", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN length(text) = 0 THEN NULL ELSE md5(text) END AS h, lang FROM documents")
def s01(spark, d):
    """Written with an unnamed index column and read back: every text survives."""
    path = scratch_path(spark, "corpus-csv")
    docs = table(spark, d, "documents").selectExpr("doc_id AS _c0", "doc_id", "text", "lang")
    docs.write.csv(path, header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return R.read_corpus_csv(spark, path, ["_c0", "doc_id", "text", "lang"]).select("doc_id", F.md5("text").alias("h"), "lang")


@query("s02_s18_fasta", V.with_views("contigs", "SELECT CAST(contig_id AS VARCHAR) AS name, seq FROM contigs"))
def s02(spark, d):
    path = scratch_path(spark, "fasta")
    R.write_fasta(V.contigs(spark, d), path, name="contig_id", seq="seq")
    return R.read_fasta(spark, path).select("name", "seq")


@query("s18_checked_sink", "SELECT count(*) AS n, false AS diverted FROM customer UNION ALL SELECT count(*), true FROM customer")
def s18(spark, d):
    """A valid table lands at its path, an invalid one beside it."""
    c = table(spark, d, "customer")
    good = R.write_checked(c, scratch_path(spark, "sink"), F.col("c_custkey") >= 0)
    bad = R.write_checked(c, scratch_path(spark, "sink"), F.col("c_custkey") > 5)
    one = lambda p: spark.read.parquet(p).agg(_n().alias("n")).withColumn("diverted", F.lit(p.endswith(".invalid")))
    return one(good).unionByName(one(bad))


@query("s05_species_reps", V.with_views("clades", "SELECT phylum AS domain, count(*) AS n, count(DISTINCT concat('A', record)) AS n_acc FROM clades GROUP BY phylum"))
def s05(spark, d):
    c = V.clades(spark, d).selectExpr("concat(if(record % 2 = 0, 'RS_', 'GB_'), 'A', record) AS acc", "concat('d__', phylum, ';s__', name) AS lineage")
    return R.parse_species_reps(c, "acc", "lineage").groupBy("domain").agg(_n().alias("n"), F.count_distinct("accession").alias("n_acc"))


@query("s06_taxonomy_dump", "SELECT CAST(n_nationkey AS VARCHAR) AS taxid, CAST(n_regionkey AS VARCHAR) AS parent, n_name AS rank FROM nation")
def s06(spark, d):
    from strandloom.operators.taxonomy import parse_dump

    lines = table(spark, d, "nation").selectExpr("concat(n_nationkey, '\t|\t', n_regionkey, '\t|\t', n_name, '\t|') AS value")
    return parse_dump(lines, ["taxid", "parent", "rank"])


_GFF_SQL = "SELECT concat('ACC', l_suppkey) AS seqid, l_orderkey % 50 AS k, l_partkey + 1 AS lo, l_partkey + 31 AS hi, l_linenumber AS ln, l_orderkey AS ok FROM lineitem"


def _gff(spark, d):
    """One file's content per sequence: a header, CDS rows, a sequence tail."""
    rows = table(spark, d, "lineitem").selectExpr("concat('ACC', l_suppkey) AS seqid", "struct(l_orderkey, l_linenumber, l_partkey, concat_ws('\t', concat('ACC', l_suppkey), 'src', 'CDS', l_partkey + 1, l_partkey + 31, '.', '+', '0', concat('ID=cds', l_orderkey % 50, ';product=a%3Bb,c;product=100%25 id ', l_linenumber, ';Note=x=y+z;empty=')) AS line) AS r")
    g = rows.groupBy("seqid").agg(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda x: x["line"]), "\n").alias("b"))
    return g.select(F.col("seqid").alias("file"), F.concat(F.lit("##gff-version 3\n"), "b", F.lit("\n##FASTA\n>x\nACGT\n")).alias("content"))


@query("s07_gff3", f"SELECT seqid, count(*) AS n, CAST(sum(lo) AS BIGINT) AS lo, CAST(sum(hi) AS BIGINT) AS hi, 3 * count(*) AS products, md5(string_agg(concat('a;b|c|100% id ', ln, '|x=y+z'), ',' ORDER BY ok, ln, lo)) AS attributes FROM ({_GFF_SQL}) GROUP BY seqid")
def s07(spark, d):
    """Repeated keys, escapes, a second '=' and a plus sign come through whole."""
    f = R.parse_gff3(_gff(spark, d))
    a = F.col("attributes")
    said = F.concat_ws("|", F.array_join(a["product"], "|"), F.array_join(a["Note"], "|"))
    every = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", said.alias("s")))), lambda x: x["s"]), ",")
    return f.groupBy("seqid").agg(_n().alias("n"), F.sum("lo").alias("lo"), F.sum("hi").alias("hi"), F.sum(F.size(a["product"])).alias("products"), F.md5(every).alias("attributes"))


@query("s08_cds_groups", f"SELECT seqid, concat('cds', k) AS cds_id, min(lo) AS lo, max(hi) AS hi, count(*) AS n_segments, string_agg(concat('a;b|c|100% id ', ln), '|' ORDER BY ok, ln, lo) AS products FROM ({_GFF_SQL}) GROUP BY seqid, k")
def s08(spark, d):
    """Segments and attributes of all rows of an ID, in file order."""
    g = R.group_cds(R.parse_gff3(_gff(spark, d)))
    return g.select("seqid", "cds_id", "lo", "hi", F.size("segments").cast("long").alias("n_segments"), F.array_join(F.col("attributes")["product"], "|").alias("products"))


@query("s07_gff3_files", f"SELECT seqid, count(*) AS n, CAST(sum(lo) AS BIGINT) AS lo, CAST(sum(hi) AS BIGINT) AS hi, string_agg(ln, ',' ORDER BY ok, ln, lo) AS in_order FROM ({_GFF_SQL}) GROUP BY seqid")
def s07_files(spark, d):
    """A file per sequence, written as text and read back as lines."""
    path = scratch_path(spark, "gff")
    _gff(spark, d).select("file", "content").write.partitionBy("file").text(path)
    f = R.read_gff3(spark, path)
    said = F.regexp_extract(F.element_at(F.col("attributes")["product"], -1), r"(\d+)$", 1)
    every = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", said.alias("s")))), lambda x: x["s"]), ",")
    return f.groupBy("seqid").agg(_n().alias("n"), F.sum("lo").alias("lo"), F.sum("hi").alias("hi"), every.alias("in_order"))


@query("s09_tblout", V.with_views("loci", "SELECT locus_id AS target, least(lo1, hi1) AS lo, greatest(lo1, hi1) AS hi, CASE WHEN lo1 > hi1 THEN -1 ELSE 1 END AS strand, (lo1 % 100)::DOUBLE AS score FROM loci WHERE flag <> 'N'"))
def s09(spark, d):
    lines = V.loci(spark, d).selectExpr("if(flag = 'N', concat('# ', locus_id), concat_ws('  ', locus_id, '-', 'q', 'RF1', 'cm', '1', '100', lo1, hi1, if(lo1 > hi1, '-', '+'), 'no', '1', '0.5', '0.0', lo1 % 100, '1e-5', '!', '-')) AS value")
    return R.parse_tblout(lines).select("target", "lo", "hi", "strand", "score")


@query("s09_blast", V.with_views("loci", "SELECT locus_id AS subject, least(lo1, hi1) AS lo, greatest(lo1, hi1) AS hi, CASE WHEN lo1 > hi1 THEN -1 ELSE 1 END AS strand FROM loci"))
def s09b(spark, d):
    lines = V.loci(spark, d).selectExpr("concat_ws('\t', 'q', locus_id, '98.5', '100', '1', '0', '1', '100', lo1, hi1, '1e-9', '180') AS value")
    return R.parse_blast(lines).select("subject", "lo", "hi", "strand")


@query("s10_helixcov", "SELECT user_id AS file, count(*) + (user_id % 10 = 0)::INT AS declared, count(*) AS parsed, CAST(sum(event_id % 9 + 2) AS BIGINT) AS nbp, CAST(sum(event_id % 3) AS BIGINT) AS nbp_cov, user_id % 10 <> 0 AS ok FROM events GROUP BY user_id")
def s10(spark, d):
    """Files whose declared count differs from their rows don't hold together."""
    rows = table(spark, d, "events").selectExpr("user_id", "struct(event_id, concat(event_id % 40 + 1, '-', event_id % 40 + 9, ' ', event_id % 40 + 20, '-', event_id % 40 + 28, ', nbp = ', event_id % 9 + 2, ' nbp_cov = ', event_id % 3) AS line) AS r")
    g = rows.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["line"]), "\n").alias("b"), _n().alias("n"))
    files = g.select(F.col("user_id").alias("file"), F.concat(F.lit("# RMs = "), (F.col("n") + F.expr("if(user_id % 10 = 0, 1, 0)")).cast("string"), F.lit("\n"), "b").alias("content"))
    return R.parse_helixcov(files)


@query("s11_stockholm", V.with_views("contigs", "SELECT contig_id AS file, unnest(['a', 'b', '#=GC SS_cons']) AS row_name, unnest([seq, reverse(seq), repeat('.', length(seq))]) AS aligned FROM contigs"))
def s11(spark, d):
    """Two interleaved blocks a file, joined row by row."""
    c = V.contigs(spark, d).selectExpr("contig_id", "seq AS a", "reverse(seq) AS b", "repeat('.', length(seq)) AS s", "cast(length(seq) div 2 AS int) AS h")
    block = lambda lo, n: f"'a   ', substr(a, {lo}, {n}), '\n', 'b   ', substr(b, {lo}, {n}), '\n', '#=GC SS_cons   ', substr(s, {lo}, {n}), '\n'"
    files = c.selectExpr("contig_id AS file", f"concat('# STOCKHOLM 1.0\n', {block(1, 'h')}, '\n', {block('h + 1', 'length(a)')}, '//\n') AS content")
    return R.parse_stockholm(files)


@query("s12_connect_tables", V.with_views("drawn_contigs", "SELECT contig_id AS file, 2 * (length(seq) // 4) AS n_pairs, CASE WHEN contig_id % 6 = 0 THEN 1 ELSE 0 END AS n_asymmetric FROM drawn_contigs"))
def s12(spark, d):
    """Pairs of connect tables; those without their mirror are found."""
    c = V.drawn_contigs(spark, d).selectExpr("contig_id", "seq", "cast(length(seq) AS int) AS n")
    odd = F.col("contig_id") % 6 == 0

    def body(r):
        n, q = r["n"], F.floor(r["n"] / 4)
        partner = lambda i: F.when(i <= q, n + 1 - i).when(i > n - q, F.when((i == n) & odd, 2).otherwise(n + 1 - i)).otherwise(0)
        line = lambda letter, i: F.concat_ws(" ", i.cast("string"), letter, (i - 1).cast("string"), (i + 1).cast("string"), partner(i).cast("string"), i.cast("string"))
        return F.concat(n.cast("string"), F.lit(" x\n"), F.array_join(F.transform(F.filter(F.split(r["seq"], ""), lambda x: x != ""), lambda letter, at: line(letter, at + 1)), "\n"))

    # Bound, as the sequence and its length would be worked out again for each letter.
    files = c.select(F.col("contig_id").alias("file"), R.bound(F.struct("seq", "n"), body).alias("content"))
    p = R.parse_ct(files)
    return p.groupBy("file").agg(_n().alias("n_pairs"), F.count_if((F.col("i") > F.col("j")) & ~F.col("mirrored")).cast("int").alias("n_asymmetric"))


@query("s13_resumable_log", "SELECT user_id AS key, max(event_id) AS seq, arg_max(event_type, event_id) AS status FROM events WHERE event_id % 7 <> 0 GROUP BY user_id")
def s13(spark, d):
    """Corrupt lines are dropped, the last row of a key wins."""
    lines = table(spark, d, "events").selectExpr("concat(to_json(struct(user_id AS key, event_id AS seq, event_type AS status)), if(event_id % 7 = 0, ',{', '')) AS value").withColumn("value", F.expr("if(endswith(value, ',{'), substr(value, 4), value)"))
    return R.last_log_rows(lines, "key long, seq long, status string", key="key", seq="seq")


@query("s13_work_list", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def s13b(spark, d):
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(done, "c_custkey", "left_anti")


@query("s14_manifest_supply", "SELECT supply, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 5 = 0 THEN 'unknown' WHEN p_partkey % 2 = 0 THEN 'annotated' ELSE 'unannotated' END AS supply FROM part) GROUP BY supply")
def s14(spark, d):
    p = table(spark, d, "part")
    lines = p.where("p_partkey % 5 <> 0").selectExpr("explode(array(concat(md5(p_name), '  ./A', p_partkey, '/g.fna'), if(p_partkey % 2 = 0, concat(md5(p_brand), '  ./A', p_partkey, '/g.gff'), '# none'))) AS value")
    return R.classify_assemblies(R.parse_manifest(lines), p.selectExpr("concat('A', p_partkey) AS assembly"), "assembly").groupBy("supply").agg(_n().alias("n"))


@query("s15_window_logits", "SELECT vec_id, i - 1 AS pos, round(embedding[i]::DOUBLE, 6) AS logit FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def s15(spark, d):
    """Logit arrays of windows as rows of positions."""
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    return e.select("vec_id", F.col("pos").cast("long").alias("pos"), F.round(F.col("x").cast("double"), 6).alias("logit"))


@query("s17_wanted_rows", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def s17(spark, d):
    wanted = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return R.keep_wanted(table(spark, d, "orders").select("o_orderkey", "o_custkey"), wanted, "o_custkey")


@query("s11_alignment_depth", V.with_views("contigs", "SELECT contig_id AS file, 2 AS n_rows, length(seq) AS width, round((2.0::DOUBLE * length(seq) - length(seq) + length(replace(seq, 'A', '')) - length(seq) + length(replace(seq, 'C', ''))) / length(seq), 9) AS mean_depth FROM contigs"))
def s11b(spark, d):
    """Rows, width and mean residues a column; A of one row and C of the other are gaps. The
    mean of no columns is no number."""
    files = V.contigs(spark, d).selectExpr("contig_id AS file", "concat('# STOCKHOLM 1.0\na   ', replace(seq, 'A', '-'), '\nb   ', replace(seq, 'C', '.'), '\n#=GC SS_cons   ', repeat('.', length(seq)), '\n//\n') AS content")
    return R.alignment_depth(R.parse_stockholm(files)).withColumn("mean_depth", F.coalesce(rounded("mean_depth", 9), F.lit(float("nan"))))


@query("s13_work_decisions", "WITH l AS (SELECT o_custkey AS k, arg_max(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY o_custkey) SELECT decision, count(*) AS n FROM (SELECT CASE WHEN s IS NULL THEN 'run' WHEN s = 'F' THEN 'reuse' WHEN s = 'P' THEN 'retry' ELSE 'give_up' END AS decision FROM customer LEFT JOIN l ON k = c_custkey) GROUP BY decision")
def s13c(spark, d):
    """Reuse, retry, run or give up, by each key's last log row."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", "o_orderkey").alias("status")).withColumnRenamed("o_custkey", "key")
    wanted = table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    return R.work_decision(wanted, o, key="key", status="status", done="F", retry=["P"]).groupBy("decision").agg(_n().alias("n"))


@query("s18_json_and_shards", "SELECT n_regionkey AS shard, count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS keys, count(nullif(n_name, 'CHINA')) AS named FROM nation GROUP BY n_regionkey")
def s18b(spark, d):
    """Written by shard, counted per shard, reported as JSON and read back."""
    shards, report = scratch_path(spark, "shards"), scratch_path(spark, "report")
    R.write_shards(table(spark, d, "nation").withColumn("n_name", F.nullif("n_name", F.lit("CHINA"))), shards, "n_regionkey")
    per = spark.read.parquet(shards).groupBy(F.col("n_regionkey").cast("long").alias("shard")).agg(_n().alias("n"), F.sum("n_nationkey").alias("keys"), F.count("n_name").alias("named"))
    R.write_json_report(per, report)
    return spark.read.schema("shard long, n long, keys long, named long").json(report)
