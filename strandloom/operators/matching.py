"""Maximum bipartite matching as joins, and representatives chosen by it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.session import cut


def _greedy(edges: DataFrame) -> DataFrame:
    """A maximal matching ``u, c``: every free ``u`` asks its smallest free ``c``, every ``c``
    takes the smallest that asks, until no edge between free ends is left."""
    found, rest = None, edges
    while not rest.isEmpty():
        asked = rest.groupBy("u").agg(F.min("c").alias("c"))
        new = cut(asked.groupBy("c").agg(F.min("u").alias("u")).select("u", "c"))
        found = new if found is None else found.unionByName(new)
        rest = cut(rest.join(new.select("u"), "u", "left_anti").join(new.select("c"), "c", "left_anti"))
    return edges.limit(0) if found is None else cut(found)


def _grow(edges: DataFrame, match: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Alternating trees from all free ``u`` at once: ``c, u, root`` of every ``c`` reached,
    each in one tree, and ``root, c``, one free ``c`` for every tree that met one. A tree
    that has met one grows no further."""
    free = edges.select("u").distinct().join(match.select("u"), "u", "left_anti")
    front = cut(free.select("u", F.col("u").alias("root")))
    seen = reached = None
    while not front.isEmpty():
        new = front.join(edges, "u")
        if seen is not None:
            new = new.join(seen.select("c"), "c", "left_anti")
        new = cut(new.groupBy("c").agg(F.min(F.struct("root", "u")).alias("s")).select("c", "s.u", "s.root"))
        ends = cut(new.join(match.select("c"), "c", "left_anti").groupBy("root").agg(F.min("c").alias("c")))
        seen = new if seen is None else seen.unionByName(new)
        reached = ends if reached is None else reached.unionByName(ends)
        front = cut(new.join(reached.select("root"), "root", "left_anti").join(match.withColumnRenamed("u", "next"), "c").select(F.col("next").alias("u"), "root"))
    if seen is None:
        return edges.select("c", "u", F.col("u").alias("root")).limit(0), edges.select(F.col("u").alias("root"), "c").limit(0)
    return cut(seen), cut(reached)


def maximum_matching(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``left, right`` of a largest set of edges without a common end (W10), the same for
    the same edges. Rounds as in Hopcroft and Karp's method: alternating trees grow from all
    free left ends together and share no vertex, so the paths they find are flipped
    together; when no tree meets a free right end the matching is largest. Rows with a
    null end are ignored; every step's rows lie in the shared folder."""
    e = cut(edges.select(F.col(left).alias("u"), F.col(right).alias("c")).dropna().distinct())
    match = _greedy(e)
    while True:
        seen, heads = _grow(e, match)
        if heads.isEmpty():
            return match.select(F.col("u").alias(left), F.col("c").alias(right))
        flipped = None
        while not heads.isEmpty():
            step = cut(heads.join(seen.select("c", "u"), "c").select("root", "u", "c"))
            flipped = step if flipped is None else flipped.unionByName(step)
            heads = cut(step.where("u <> root").select("root", "u").join(match, "u").select("root", "c"))
        flipped = cut(flipped.select("u", "c"))
        match = cut(match.join(flipped.select("u"), "u", "left_anti").unionByName(flipped))


def unit_coverage(df: DataFrame, matched: DataFrame, *, cluster: str, unit: str) -> DataFrame:
    """``unit, n_clusters, covered``: the clusters that offer each unit, and whether one of
    them can stand for it (W10)."""
    offers = df.where(F.col(unit).isNotNull() & F.col(cluster).isNotNull()).groupBy(unit).agg(F.count_distinct(cluster).alias("n_clusters"))
    return offers.join(matched.select(unit, F.lit(True).alias("covered")), unit, "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def matched_representatives(df: DataFrame, *, cluster: str, unit: str, id_col: str) -> DataFrame:
    """One record per cluster so that as many units as can be are represented (W10): a
    cluster that a largest matching gives to a unit is represented by the smallest id it
    has of that unit, any other by the smallest id with a unit, or the smallest of all.
    Rows without a cluster or an id are left out."""
    rows = df.where(F.col(cluster).isNotNull() & F.col(id_col).isNotNull())
    options = cut(rows.groupBy(cluster, unit).agg(F.min(id_col).alias(id_col)))
    matched = maximum_matching(options, unit, cluster).select(cluster, F.col(unit).alias("_own"))
    pick = F.min_by(F.struct(id_col, unit), F.struct(F.coalesce(~F.col(unit).eqNullSafe(F.col("_own")) | F.col("_own").isNull(), F.lit(True)), F.col(unit).isNull(), F.col(id_col)))
    return options.join(matched, cluster, "left").groupBy(cluster).agg(pick.alias("r")).select(cluster, f"r.{id_col}", f"r.{unit}")
