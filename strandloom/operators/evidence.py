"""Evidence rules on candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classify_candidates(candidates: DataFrame, masked: DataFrame, *, id_col: str, has_locus: str = "has_locus", spared: str = "spared") -> DataFrame:
    """``outcome`` in order: refused (no coordinates), masked, spared, mined."""
    marks = masked.select(id_col).distinct().withColumn("_masked", F.lit(True))
    outcome = F.when(~F.col(has_locus), "refused").when(F.col("_masked"), "masked").when(F.coalesce(F.col(spared), F.lit(True)), "spared").otherwise("mined")
    return candidates.join(marks, id_col, "left").withColumn("outcome", outcome).drop("_masked")


def kleene_or(*statuses: Column) -> Column:
    """Three-valued or of nullable booleans: a true wins, then null, then false."""
    out = statuses[0]
    for s in statuses[1:]:
        out = out | s
    return out


def spare_rule(df: DataFrame, statuses: dict[str, str]) -> DataFrame:
    """A candidate is spared if any evidence passed or any is unavailable; the
    reason names which (E30). ``statuses`` maps names to nullable columns."""
    rule = F.coalesce(kleene_or(*[F.col(c) for c in statuses.values()]), F.lit(True))
    tag = F.concat_ws(";", *[F.when(F.col(c).isNull(), f"unavailable:{n}").when(F.col(c), f"passed:{n}") for n, c in statuses.items()])
    return df.withColumn("spared", rule).withColumn("reason", tag)


def round_readiness(df: DataFrame, statuses: dict[str, str]) -> DataFrame:
    """Whether a round can run (E30): candidates, those that no evidence passes, which
    is the most that full evidence could leave to mine, and for each evidence how many
    it decides; ``ready`` if every one decides some and something can be left."""
    passed = F.coalesce(F.greatest(*[F.coalesce(F.col(c), F.lit(False)) for c in statuses.values()], F.lit(False)), F.lit(False))
    g = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(~passed).alias("maximum_yield"), *(F.count(c).alias(f"n_{name}") for name, c in statuses.items()))
    ready = F.col("maximum_yield") > 0
    for name in statuses:
        ready = ready & (F.col(f"n_{name}") > 0)
    return g.withColumn("ready", ready)


def assemble_evidence(manifest: DataFrame, tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Manifest with one nullable column per evidence table; what a table lacks
    is unavailable (J10). Tables have ``key`` and a column of their own name."""
    out = manifest
    for name, t in tables.items():
        out = out.join(t.select(key, name), key, "left")
    return out


def refuse_idle_tables(manifest: DataFrame, tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Candidates each evidence table decides; a table with none is an error to
    its caller (J11)."""
    out = None
    for name, t in tables.items():
        n = manifest.select(key).join(t.where(F.col(name).isNotNull()).select(key).distinct(), key, "left_semi").agg(F.count(F.lit(1)).alias("n_decided")).withColumn("evidence", F.lit(name))
        out = n if out is None else out.unionByName(n)
    return out.withColumn("idle", F.col("n_decided") == 0)


def combine_strands(per_strand: DataFrame, key: str, status: str, policy: str) -> DataFrame:
    """One status of a candidate's strands (J09): ``any`` is the three-valued or,
    ``all`` the three-valued and."""
    t, f, u = F.count_if(F.col(status)), F.count_if(~F.col(status)), F.count_if(F.col(status).isNull())
    any_, all_ = F.when(t > 0, True).when(u > 0, None).otherwise(False), F.when(f > 0, False).when(u > 0, None).otherwise(True)
    return per_strand.groupBy(key).agg((any_ if policy == "any" else all_).cast("boolean").alias(status))


def architecture_status(df: DataFrame, *, depth: Column, depth_floor: int, named: Column, short_stem: Column, class_two: Column) -> DataFrame:
    """Named elements or one of two relaxations; null below the depth floor."""
    rows = df.withColumn("named", named).withColumn("short_stem", short_stem).withColumn("class_two", class_two)
    return rows.withColumn("status", F.when(depth >= depth_floor, F.col("named") | F.col("short_stem") | F.col("class_two")))


def downstream_gene(loci: DataFrame, genes: DataFrame, *, id_col: str, window: int, overlap: int) -> DataFrame:
    """Nearest gene downstream on the locus's strand, from ``-overlap`` to
    ``window`` letters behind its 3' end (J08 without hops). Genes appear in the
    bins they may be reached from, so the join has equalities."""
    size = window + overlap + 1
    a = loci.select(id_col, "acc", "strand", F.when(F.col("strand") > 0, F.col("hi")).otherwise(-F.col("lo")).alias("_x"))
    b = genes.select("acc", "strand", "gene_id", "product", F.when(F.col("strand") > 0, F.col("lo")).otherwise(-F.col("hi")).alias("_g"))
    a = a.withColumn("_b", F.explode(F.array(F.floor((F.col("_x") - overlap) / size), F.floor((F.col("_x") - overlap) / size) + 1)))
    b = b.withColumn("_b", F.floor(F.col("_g") / size))
    d = F.col("_g") - F.col("_x")
    near = a.join(b, ["acc", "strand", "_b"]).withColumn("distance", d).where(d.between(-overlap, window))
    best = near.groupBy(id_col).agg(F.min_by(F.struct("gene_id", "product", "distance"), F.struct("distance", "gene_id")).alias("g"))
    return loci.select(id_col).distinct().join(best, id_col, "left").select(id_col, "g.gene_id", "g.product", "g.distance")


def hop_genes(loci: DataFrame, genes: DataFrame, *, id_col: str, window: int, hops: int, judgeable: Column) -> DataFrame:
    """Downstream gene with hops (J08): genes that can't be judged are passed over
    up to ``hops`` times, each hop anchoring anew at the gene's far end. Each hop
    is one more binned join over the rows still undecided."""
    out, todo = None, loci.select(id_col, "acc", "strand", F.when(F.col("strand") > 0, F.col("hi")).otherwise(-F.col("lo")).alias("_x"))
    g = genes.withColumn("_ok", judgeable).select("acc", "strand", "gene_id", "_ok", F.when(F.col("strand") > 0, F.col("lo")).otherwise(-F.col("hi")).alias("_g"), F.when(F.col("strand") > 0, F.col("hi")).otherwise(-F.col("lo")).alias("_e"))
    g = g.withColumn("_b", F.floor(F.col("_g") / (window + 1)))
    for hop in range(hops + 1):
        a = todo.withColumn("_b", F.explode(F.array(F.floor((F.col("_x") + 1) / (window + 1)), F.floor((F.col("_x") + 1) / (window + 1)) + 1)))
        near = a.join(g, ["acc", "strand", "_b"]).where((F.col("_g") > F.col("_x")) & (F.col("_g") <= F.col("_x") + window))
        best = near.groupBy(id_col, "acc", "strand").agg(F.min_by(F.struct("gene_id", "_ok", "_e", (F.col("_g") - F.col("_x")).alias("d")), F.struct("_g", "gene_id")).alias("g"))
        done = best.where(F.col("g._ok")).select(id_col, F.col("g.gene_id").alias("gene_id"), F.lit(hop).alias("n_hops"))
        out = done if out is None else out.unionByName(done)
        todo = best.where(~F.col("g._ok")).select(id_col, "acc", "strand", F.col("g._e").alias("_x"))
    return loci.select(id_col).distinct().join(out, id_col, "left")


def classify_products(text: Column, rules: list[tuple[str, str]], otherwise: str = "unjudgeable") -> Column:
    """First class whose pattern the product text matches."""
    out = F.lit(otherwise)
    for name, pattern in reversed(rules):
        out = F.when(F.lower(text).rlike(pattern), name).otherwise(out)
    return F.when(text.isNull() | (F.trim(text) == ""), otherwise).otherwise(out)


def synteny_status(found: DataFrame, *, rules: list[tuple[str, str]], wanted: list[str], within: int, product: str = "product", distance: str = "distance") -> DataFrame:
    """Adds ``status`` (E27): true if the gene found is of a ``wanted`` class and at most
    ``within`` away, false if it is not, null (unavailable) without a gene."""
    ok = classify_products(F.col(product), rules).isin(*wanted) & (F.col(distance) <= within)
    return found.withColumn("status", F.when(F.col(product).isNotNull(), ok))


def covariation_status(pairs: DataFrame, *, key: str, helix: str, covarying: Column, minimum: int, depth: DataFrame, floor: int) -> DataFrame:
    """Covarying pairs in the best helix and summed; the verdict needs the
    minimum within one helix and is null below the depth floor (A22)."""
    per = pairs.groupBy(key, helix).agg(F.count_if(covarying).alias("_c"))
    both = per.groupBy(key).agg(F.max("_c").alias("best_helix"), F.sum("_c").alias("summed"))
    out = depth.join(both, key, "left").na.fill(0, ["best_helix", "summed"])
    return out.withColumn("status", F.when(F.col("depth") >= floor, F.col("best_helix") >= minimum))
