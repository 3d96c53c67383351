"""Tables of loci, sequences, taxa and scores derived from the driver's tables.

Each view has a Spark form and an SQL form with the same rows; draws are hashes
of ids, so both engines agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.session import table

#: SQL forms, by name; ``with_views`` adds those a statement needs.
SQL = {
    "contigs": """SELECT doc_id AS contig_id, translate(hex(text), '0123456789ABCDEF', 'ACGTACGTACGTACGT') AS seq FROM documents""",
    "drawn_contigs": """SELECT doc_id AS contig_id, array_to_string(list_transform(range(n_chars % 64 + 1), lambda i: translate(md5(concat(doc_id, ':', i)), '0123456789abcdef', 'AAAACCCCGGGGTTTT')), '') AS seq FROM documents""",
    "loci": """SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS locus_id, concat('ACC', l_suppkey, '.', l_linenumber % 3) AS accession, CASE WHEN l_linenumber % 2 = 0 THEN e ELSE s END AS lo1, CASE WHEN l_linenumber % 2 = 0 THEN s ELSE e END AS hi1, l_returnflag AS flag, l_linestatus AS status FROM (SELECT *, l_partkey * 50 + l_orderkey % 50 AS s, l_partkey * 50 + l_orderkey % 50 + 19 + CAST(l_quantity AS BIGINT) * 4 AS e FROM lineitem)""",
    "known": """SELECT DISTINCT regexp_replace(accession, '\\.\\d+$', '') AS acc, least(lo1, hi1) AS lo, greatest(lo1, hi1) AS hi FROM loci WHERE flag = 'R'""",
    "candidates": """SELECT locus_id, regexp_replace(accession, '\\.\\d+$', '') AS acc, least(lo1, hi1) AS lo, greatest(lo1, hi1) AS hi, CASE WHEN lo1 > hi1 THEN -1 ELSE 1 END AS strand, status FROM loci WHERE flag = 'A'""",
    "positions": """SELECT user_id AS contig, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS cls, CAST(floor(value * 100) AS BIGINT) % 1000 AS p FROM events""",
    "scored": """SELECT d.doc_id AS id, d.source AS block, l.quality AS y, CAST((hex1 * 6) // 10 AS BIGINT) + 400 * l.quality AS s1, CAST((hex2 * 8) // 10 AS BIGINT) + 200 * l.quality AS s2 FROM documents d JOIN labels l USING (doc_id), LATERAL (SELECT ('0x' || substr(md5(concat('1:', d.doc_id)), 1, 8))::BIGINT % 1000 AS hex1, ('0x' || substr(md5(concat('2:', d.doc_id)), 1, 8))::BIGINT % 1000 AS hex2)""",
    "clades": """SELECT c_custkey AS record, c_name AS name, n_name AS genus, r_name AS phylum, c_mktsegment AS family, c_nationkey AS genus_key, n_regionkey AS phylum_key FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "genes": """SELECT concat('ACC', l_suppkey) AS acc, CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END AS strand, l_partkey * 50 + 7 * l_linenumber AS lo, l_partkey * 50 + 7 * l_linenumber + 90 + CAST(l_quantity AS BIGINT) * 3 AS hi, concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS gene_id, concat(p_name, ' ', lower(p_type)) AS product FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'N'""",
    "codes": """SELECT vec_id AS id, label, list_transform(embedding, lambda x: CASE WHEN abs(x::DOUBLE) < 0.01 THEN -1 WHEN x::DOUBLE < -0.08 THEN 0 WHEN x::DOUBLE < 0 THEN 1 WHEN x::DOUBLE < 0.08 THEN 2 ELSE 3 END) AS codes FROM embeddings""",
}
H = lambda tag, x: f"('0x' || substr(md5(concat('{tag}:', {x})), 1, 8))::BIGINT"
SQL["splits"] = f"""SELECT *, fold = 'train' AND NOT heldout AS nested_train, fold = 'train' AND {H('c', 'cluster_id')} % 10 = 0 AS calib FROM (SELECT record, record // 5 AS cluster_id, genus, phylum, family, genus_key % 5 = 0 AS heldout, CASE WHEN {H('s', 'record // 5')} % 10 < 7 THEN 'train' WHEN {H('s', 'record // 5')} % 10 < 8 THEN 'val' ELSE 'test' END AS fold FROM clades)"""
NEEDS = {"splits": ["clades"], "known": ["loci"], "candidates": ["loci"]}


def with_views(names: str, body: str) -> str:
    """``body`` with the named views (and those they read) as CTEs."""
    wanted: list[str] = []
    for n in names.split():
        wanted += [x for x in (*NEEDS.get(n, []), n) if x not in wanted]
    ctes = ",\n".join(f"{n} AS ({SQL[n]})" for n in wanted)
    body = body.strip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(head):
            return f"{head}{ctes},\n{body[len(head):]}"
    return f"WITH {ctes}\n{body}"


def digest_sql(rows: str, by: str = "") -> str:
    """The SQL form of ``table_digest`` with four digits over rows of ``h`` (and ``by``)."""
    g = f"{by}, " if by else ""
    one = f"SELECT {g}substr(h, 1, 4) AS b, count(*) AS n, sha256(string_agg(h, chr(10) ORDER BY h)) AS h FROM ({rows}) GROUP BY ALL"
    two = f"SELECT {g}substr(b, 1, 2) AS c, sum(n) AS n, sha256(string_agg(h, chr(10) ORDER BY b)) AS h FROM ({one}) GROUP BY ALL"
    return f"SELECT {g}sha256(string_agg(h, chr(10) ORDER BY c)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM ({two}) {'GROUP BY ' + by if by else ''}"


def contigs(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts as sequences, two letters for each byte."""
    return table(spark, d, "documents").selectExpr("doc_id AS contig_id", "translate(hex(text), '0123456789ABCDEF', 'ACGTACGTACGTACGT') AS seq")


def drawn_contigs(spark: SparkSession, d: str) -> DataFrame:
    """Random sequences of up to 2,048 letters, for queries too slow on whole texts or whose
    SQL takes a place as the only one."""
    return table(spark, d, "documents").selectExpr(
        "doc_id AS contig_id",
        "array_join(transform(sequence(0, cast(n_chars % 64 AS int)), i -> translate(md5(concat(doc_id, ':', i)), '0123456789abcdef', 'AAAACCCCGGGGTTTT')), '') AS seq",
    )


def loci(spark: SparkSession, d: str) -> DataFrame:
    s = "l_partkey * 50 + l_orderkey % 50"
    e = f"{s} + 19 + cast(l_quantity AS bigint) * 4"
    return table(spark, d, "lineitem").selectExpr(
        "concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS locus_id", "concat('ACC', l_suppkey, '.', l_linenumber % 3) AS accession",
        f"if(l_linenumber % 2 = 0, {e}, {s}) AS lo1", f"if(l_linenumber % 2 = 0, {s}, {e}) AS hi1", "l_returnflag AS flag", "l_linestatus AS status",
    )


def known(spark: SparkSession, d: str) -> DataFrame:
    from strandloom.functions.loci import lower_end, strip_version, upper_end

    return loci(spark, d).where("flag = 'R'").select(strip_version("accession").alias("acc"), lower_end("lo1", "hi1").alias("lo"), upper_end("lo1", "hi1").alias("hi")).distinct()


def candidates(spark: SparkSession, d: str) -> DataFrame:
    from strandloom.functions.loci import lower_end, strand_of, strip_version, upper_end

    return loci(spark, d).where("flag = 'A'").select("locus_id", strip_version("accession").alias("acc"), lower_end("lo1", "hi1").alias("lo"), upper_end("lo1", "hi1").alias("hi"), strand_of("lo1", "hi1").alias("strand"), "status")


def positions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr(
        "user_id AS contig", "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos",
        "CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS cls", "cast(floor(value * 100) AS bigint) % 1000 AS p",
    )


def scored(spark: SparkSession, d: str) -> DataFrame:
    u = lambda k: f"cast(conv(substr(md5(concat('{k}:', doc_id)), 1, 8), 16, 10) AS bigint) % 1000"
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id").selectExpr(
        "doc_id AS id", "source AS block", "quality AS y", f"({u(1)} * 6) div 10 + 400 * quality AS s1", f"({u(2)} * 8) div 10 + 200 * quality AS s2"
    )


def clades(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).selectExpr(
        "c_custkey AS record", "c_name AS name", "n_name AS genus", "r_name AS phylum", "c_mktsegment AS family", "c_nationkey AS genus_key", "n_regionkey AS phylum_key"
    )


def genes(spark: SparkSession, d: str) -> DataFrame:
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    return li.where("l_returnflag = 'N'").join(p, li.l_partkey == p.p_partkey).selectExpr(
        "concat('ACC', l_suppkey) AS acc", "if(l_linenumber % 2 = 0, -1, 1) AS strand", "l_partkey * 50 + 7 * l_linenumber AS lo",
        "l_partkey * 50 + 7 * l_linenumber + 90 + cast(l_quantity AS bigint) * 3 AS hi", "concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS gene_id", "concat(p_name, ' ', lower(p_type)) AS product",
    )


def codes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").selectExpr(
        "vec_id AS id", "label",
        "transform(embedding, x -> CASE WHEN abs(cast(x AS double)) < 0.01 THEN -1 WHEN cast(x AS double) < -0.08 THEN 0 WHEN cast(x AS double) < 0 THEN 1 WHEN cast(x AS double) < 0.08 THEN 2 ELSE 3 END) AS codes",
    )


def draw(tag: str, x: str) -> str:
    return f"cast(conv(substr(md5(concat('{tag}:', {x})), 1, 8), 16, 10) AS bigint)"


def splits(spark: SparkSession, d: str) -> DataFrame:
    base = clades(spark, d).selectExpr(
        "record", "record div 5 AS cluster_id", "genus", "phylum", "family", "genus_key % 5 = 0 AS heldout",
        f"CASE WHEN {draw('s', 'record div 5')} % 10 < 7 THEN 'train' WHEN {draw('s', 'record div 5')} % 10 < 8 THEN 'val' ELSE 'test' END AS fold",
    )
    return base.selectExpr("*", "fold = 'train' AND NOT heldout AS nested_train", f"fold = 'train' AND {draw('c', 'cluster_id')} % 10 = 0 AS calib")
