"""Taxonomy operators: lineage walks, name reconciliation, projection, unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.session import cut


def parse_lineage(lineage: str | Column) -> Column:
    """``d__X;p__Y;...`` as a map of rank to name."""
    c = F.col(lineage) if isinstance(lineage, str) else lineage
    return F.str_to_map(c, F.lit(";"), F.lit("__"))


def clade_universe(df: DataFrame, lineage: str) -> DataFrame:
    """Distinct names per rank."""
    rows = df.select(F.explode(parse_lineage(lineage)).alias("rank", "name"))
    return rows.where("name <> ''").distinct()


def parse_dump(lines: DataFrame, names: list[str], value: str = "value") -> DataFrame:
    r"""Fields of ``\t|\t`` separated dump lines."""
    parts = F.split(F.regexp_replace(F.col(value), r"\t\|$", ""), r"\t\|\t")
    return lines.select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])


def lineage_by_rank(ids: DataFrame, nodes: DataFrame, merged: DataFrame) -> DataFrame:
    """``taxid, rank, ancestor`` of each id (E23): merged ids are redirected, then
    parents are joined until nothing moves, however deep the tree; a node that is
    its own parent ends the walk, and a parent met before on it is an error."""
    start = ids.select("taxid").distinct().join(merged.select(F.col("old").alias("taxid"), "new"), "taxid", "left")
    at = start.select("taxid", F.coalesce("new", "taxid").alias("node")).withColumn("path", F.array("node"))
    out = None
    tree = nodes.select(F.col("taxid").alias("node"), "parent", "rank")
    while True:
        step = cut(at.join(tree, "node"))
        here = step.select("taxid", "rank", F.col("node").alias("ancestor"))
        out = here if out is None else out.unionByName(here)
        moved = step.where("parent <> node").where(F.when(~F.array_contains("path", F.col("parent")), True).otherwise(F.raise_error(F.concat(F.lit("cycle of parents at "), F.col("parent").cast("string"))).cast("boolean")))
        at = moved.select("taxid", F.col("parent").alias("node"), F.array_append("path", F.col("parent")).alias("path"))
        if at.isEmpty():
            break
    return out


def reconcile_names(rows: DataFrame, vocabulary: DataFrame, synonyms: DataFrame, *, name: str, scientific: str | None = None) -> DataFrame:
    """Fill-only resolution: the row's own name if the vocabulary has it, else the
    name it is a synonym of, else the row's ``scientific`` name if the vocabulary has
    that, else null; ``source`` says which (E24)."""
    v = vocabulary.select(F.col("name").alias(name), F.col("name").alias("_own")).distinct()
    s = synonyms.select(F.col("alias").alias(name), F.col("name").alias("_syn")).dropDuplicates([name])
    j = rows.join(v, name, "left").join(s, name, "left")
    if scientific:
        j = j.join(vocabulary.select(F.col("name").alias(scientific), F.col("name").alias("_sci")).distinct(), scientific, "left")
    else:
        j = j.withColumn("_sci", F.lit(None).cast("string"))
    source = F.when(F.col("_own").isNotNull(), "corpus").when(F.col("_syn").isNotNull(), "synonym").when(F.col("_sci").isNotNull(), "scientific").otherwise("unresolved")
    return j.withColumn("resolved", F.coalesce("_own", "_syn", "_sci")).withColumn("source", source).drop("_own", "_syn", "_sci")


def project_split_names(rows: DataFrame, universe: DataFrame, *, name: str) -> DataFrame:
    """All universe names equal to a name or split from it by a suffix (``X_A``),
    with the method; none is ``absent`` (E25). The join key is the base name."""
    u = universe.select("name", F.regexp_replace("name", r"_[A-Z]+$", "").alias("_base"))
    j = rows.join(u, rows[name] == u["_base"], "left")
    method = F.when(F.col("name").isNull(), "absent").when(F.col("name") == F.col("_base"), "exact").otherwise("split")
    return j.withColumn("method", method).withColumnRenamed("name", "projected").drop("_base")


def union_prior(curated: DataFrame, reference: DataFrame, literature: DataFrame, *, key: str = "accession") -> DataFrame:
    """Curated loci, reference loci of accessions the curated ones lack, and
    literature clades, with typed nulls (U01)."""
    extra = reference.join(curated.select(key).distinct(), key, "left_anti")
    parts = [df.withColumn("source", F.lit(n)) for n, df in (("curated", curated), ("reference", extra), ("literature", literature))]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


def full_join_mismatch(a: DataFrame, b: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Keys whose values differ between two tables, null-safe, or that one lacks
    (A24, A35, U06)."""
    x = a.select(key, *[F.col(v).alias(f"a_{v}") for v in values]).withColumn("_a", F.lit(1))
    y = b.select(key, *[F.col(v).alias(f"b_{v}") for v in values]).withColumn("_b", F.lit(1))
    j = x.join(y, key, "full")
    differ = F.col("_a").isNull() | F.col("_b").isNull()
    for v in values:
        differ = differ | ~F.col(f"a_{v}").eqNullSafe(F.col(f"b_{v}"))
    side = F.when(F.col("_b").isNull(), "left_only").when(F.col("_a").isNull(), "right_only").otherwise("differs")
    return j.where(differ).withColumn("side", side).drop("_a", "_b")


def merge_shards(shards: list[DataFrame], key: str) -> tuple[DataFrame, DataFrame]:
    """All shards' rows, and the keys that more than one row has."""
    every = None
    for i, s in enumerate(shards):
        s = s.withColumn("shard", F.lit(i))
        every = s if every is None else every.unionByName(s)
    return every, every.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
