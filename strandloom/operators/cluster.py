"""Graph clustering on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.statistics import global_rank
from strandloom.session import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node, component``: the smallest node of each connected component.

    Alternates large-star and small-star steps (each a grouped minimum joined
    back) until the edge set stands still; every step's edges are written to the
    shared folder. Self-loops are isolated nodes with themselves as component;
    rows with a null end are ignored.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna()
    # Cut before they are told apart: what made the edges would run for each of the two.
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    loops, e = e.where("u = v").select("u"), e.where("u <> v")
    seen = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = cut(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        state = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labels = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = labels.select(F.col("component").alias("node"), "component").distinct()
    found = labels.unionByName(roots)
    alone = loops.select(F.col("u").alias("node"), F.col("u").alias("component")).join(found, "node", "left_anti")
    return found.unionByName(alone)


def dense_labels(clusters: DataFrame, *, cluster: str = "component") -> DataFrame:
    """Adds ``label``: clusters numbered from 0 by their smallest node, which is their
    name, so in order of first appearance by id (C01)."""
    names = global_rank(clusters.select(cluster).distinct(), [F.col(cluster)], "_r").select(cluster, (F.col("_r") - 1).alias("label"))
    return clusters.join(names, cluster)


def cut_sweep(edges: DataFrame, nodes: DataFrame, *, weight: str, cuts: list[float], node: str = "node", a: str = "a", b: str = "b") -> DataFrame:
    """Single linkage at several cuts (C01): ``cut, node, component`` over the edges of
    at least each cut's weight; a node without one is alone."""
    out = None
    for c in cuts:
        comp = connected_components(edges.where(F.col(weight) >= c), a, b).withColumnRenamed("node", node)
        at = nodes.select(node).join(comp, node, "left").select(F.lit(c).alias("cut"), node, F.coalesce("component", node).alias("component"))
        out = at if out is None else out.unionByName(at)
    return out
