"""Merkle manifest of a dataset, kept as a content-addressed graph.

Every row is a leaf; runs of sixteen nodes become one node, first inside each
source, then over the sources. What is stored is ``digest -> children``: equal
subtrees are one record. A leaf's proof is found by descent: requests start at
the root and follow the digits of their rank, taking up the children they do not
select, and the segments of the path are reversed in the end. Requests that
share a path so far descend as one row, so a level has as many rows as the tree
has requested nodes there and the root is read once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators.statistics import global_rank
from strandloom.session import cut, table

#: Children of a node, and the bits of a rank that choose among them.
FANOUT, DIGIT_BITS = 16, 4
#: Columns that make up a leaf, in this order.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Sources that are broadcast at most, a row of some 200 bytes each.
MAX_BROADCAST = 200_000


@dataclass
class Manifest:
    """``leaves``: the rows given with ``leaf, tree, pos``; ``trees``: ``tree, source, n,
    depth, subroot``; ``records``: ``digest, children``; the root's digest (null for
    an empty table) and the depth of the tree over the sources."""

    leaves: DataFrame
    trees: DataFrame
    records: DataFrame
    root: str | None
    depth: int


def leaf_digest(*columns: Column) -> Column:
    """SHA-256 over the values, each its length in bytes and itself, ``-`` if null."""
    framed = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*framed), 256)


def depth_of(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    return 0 if n <= 1 else 1 + depth_of(-(-n // FANOUT))


def _levels(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Records ``digest, children`` of all levels above ``tree, n, pos, digest`` and
    the trees' roots ``tree, digest``; ``most`` is the largest ``n``."""
    records, roots = [], []
    for _ in range(depth_of(most)):
        roots.append(nodes.where(F.col("n") == 1).select("tree", "digest"))
        runs = nodes.where(F.col("n") > 1).groupBy("tree", F.shiftright("pos", DIGIT_BITS).alias("pos"))
        run = F.transform(F.sort_array(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"])
        nodes = cut(
            runs.agg(F.first("n").alias("n"), run.alias("children"))
            .select("tree", F.ceil(F.col("n") / FANOUT).alias("n"), "pos", F.sha2(F.array_join("children", ""), 256).alias("digest"), "children")
        )
        records.append(nodes.select("digest", "children"))
        nodes = nodes.drop("children")
    out = nodes.where(F.col("n") == 1).select("tree", "digest")
    for r in roots:
        out = out.unionByName(r)
    return records, out


def build_manifest(rows: DataFrame, *, leaf: str = "leaf", order: list[str], source: str = "source") -> Manifest:
    """The graph over rows that hold their digest in ``leaf``. Rows of a source stand in
    ascending ``order`` (nulls first, ties by digest); sources ascend likewise. A source
    of any size is ranked by range partitions; null is a source of its own."""
    spark = rows.sparkSession
    ranked = cut(global_rank(cut(rows), [F.col(source), *(F.col(c) for c in order), F.col(leaf)], "_rank"))
    sizes = ranked.groupBy(source).agg(F.min("_rank").alias("first"), F.count(F.lit(1)).alias("n"))
    # A source's first rank orders sources as they are.
    trees = cut(global_rank(sizes, [F.col("first")], "tree").withColumn("tree", F.col("tree") - 1))
    n_trees, most = trees.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    beside = trees.select(F.col(source).alias("_source"), "first", "n", "tree")
    beside = F.broadcast(beside) if n_trees <= MAX_BROADCAST else beside.hint("merge")
    leaves = ranked.join(beside, F.col(source).eqNullSafe(F.col("_source"))).withColumn("pos", F.col("_rank") - F.col("first"))
    leaves = cut(leaves.select(*rows.columns, "tree", "pos", "n"))
    records, roots = _levels(leaves.select("tree", "n", "pos", F.col(leaf).alias("digest")), most)
    depth = F.lit(0)
    for k in range(1, depth_of(most) + 1):
        depth = F.when(F.col("n") > FANOUT ** (k - 1), F.lit(k)).otherwise(depth)
    trees = cut(trees.join(roots, "tree").select("tree", source, "n", depth.alias("depth"), F.col("digest").alias("subroot")))
    over, top = _levels(trees.select(F.lit(0).cast("long").alias("tree"), F.lit(n_trees).cast("long").alias("n"), F.col("tree").alias("pos"), F.col("subroot").alias("digest")), n_trees)
    every = [*over, *records]
    if every:
        stored = every[0]
        for r in every[1:]:
            stored = stored.unionByName(r)
        stored = cut(stored.dropDuplicates(["digest"]))
    else:
        stored = spark.createDataFrame([], "digest string, children array<string>")
    root = top.first()
    return Manifest(leaves.drop("n"), trees, stored, root["digest"] if root else None, depth_of(n_trees))


def write_manifest(manifest: Manifest, path: str) -> None:
    """Leaves, trees, records and the root as Parquet below ``path``."""
    for name in ("leaves", "trees", "records"):
        getattr(manifest, name).write.parquet(f"{path}/{name}")
    manifest.records.sparkSession.createDataFrame([(manifest.root, manifest.depth)], "root string, depth int").write.parquet(f"{path}/root")


def read_manifest(spark: SparkSession, path: str) -> Manifest:
    root = spark.read.parquet(f"{path}/root").first()
    return Manifest(*(spark.read.parquet(f"{path}/{name}") for name in ("leaves", "trees", "records")), root["root"], root["depth"])


def _step(front: DataFrame, records: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """One level down: ``keys, digest, path`` of the nodes ``front`` to those children
    whose ``keys, pos`` are ``wanted``; the path gains what lies left and right of each."""
    met = front.join(records, "digest").select(*keys, F.col("pos").alias("_up"), "children", "path")
    digit = F.col("pos").bitwiseAND(F.lit(FANOUT - 1)).cast("int")
    below = wanted.withColumn("_up", F.shiftright("pos", DIGIT_BITS)).join(met, [*keys, "_up"])
    segment = F.struct(F.array_join(F.slice("children", 1, digit), "").alias("left"), F.array_join(F.slice("children", digit + 2, FANOUT), "").alias("right"))
    return below.select(*wanted.columns, F.get("children", digit).alias("digest"), F.concat("path", F.array(segment)).alias("path"))


def prove(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """``requests`` (rows of ``manifest.leaves``, all their columns kept) with ``found``, the
    digest that the descent arrives at, and ``path``: siblings ``left`` and ``right`` of
    every level, from the leaf up to the root."""
    spark = requests.sparkSession
    empty = F.array().cast("array<struct<left:string,right:string>>")
    asked = requests.groupBy("tree").agg(F.count(F.lit(1)).alias("asked")).select("tree")
    front = spark.createDataFrame([(manifest.root, 0)], "digest string, pos long").withColumn("path", empty)
    targets = asked.select(F.col("tree").alias("pos"))
    for k in range(manifest.depth - 1, -1, -1):
        front = _step(front, manifest.records, targets.select(F.shiftright("pos", DIGIT_BITS * k).alias("pos")).distinct(), [])
    depths = manifest.trees.select("tree", "depth")
    front = cut(front.select(F.col("pos").alias("tree"), "digest", "path").join(depths, "tree").withColumn("pos", F.lit(0).cast("long")))
    most = manifest.trees.agg(F.max("depth")).first()[0] or 0
    few = manifest.trees.count() <= MAX_BROADCAST
    deep = requests.select("tree", "pos").join(F.broadcast(depths) if few else depths.hint("merge"), "tree")
    # A lone leaf is its source's root.
    done = requests.join(front.where(F.col("depth") == 0).select("tree", "pos", F.col("digest").alias("found"), "path"), ["tree", "pos"])
    for level in range(1, most + 1):
        # Trees of this depth stand one step above their leaves, deeper ones go on.
        last = _step(front.where(F.col("depth") == level).select("tree", "pos", "digest", "path"), manifest.records, requests, ["tree"])
        done = done.unionByName(last.withColumnRenamed("digest", "found").select(*done.columns))
        if level < most:
            below = deep.where(F.col("depth") > level).select("tree", "depth", F.expr(f"shiftright(pos, {DIGIT_BITS} * cast(depth - {level} as int))").alias("pos")).distinct()
            front = cut(_step(front.where(F.col("depth") > level).select("tree", "pos", "digest", "path"), manifest.records, below, ["tree"]))
    return done.withColumn("path", F.reverse("path"))


def siblings_digest(path: Column) -> Column:
    """SHA-256 of all siblings, level by level from the leaf, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def verify(docs: DataFrame, tampered: DataFrame | None = None) -> DataFrame:
    """Leaf, subroot, root and proof of every row of ``docs``, and whether the leaf of
    ``tampered text`` (a column of that name, if there is one) still leads to the root.

    ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``. Nulls in any
    column are values of their own; rows that repeat an id are leaves of their own,
    ordered by digest, and equal ones share their siblings' order; other columns are
    ignored; an empty table gives an empty result.
    """
    changed = F.col("tampered text") if "tampered text" in docs.columns else F.col("text")
    first = [F.col(c) for c in LEAF_COLUMNS[:-1]]
    rows = docs.select("doc_id", "source", leaf_digest(*first, F.col("text")).alias("leaf"), F.when(~changed.eqNullSafe(F.col("text")), leaf_digest(*first, changed)).alias("other"))
    manifest = build_manifest(rows, order=["doc_id"])
    found = prove(manifest, manifest.leaves)
    subroots = manifest.trees.select("tree", "subroot")
    beside = F.broadcast(subroots) if subroots.count() <= MAX_BROADCAST else subroots.hint("merge")
    root = F.lit(manifest.root)
    folded = fold(F.coalesce("other", "leaf"), F.col("path"))
    out = found.join(beside, "tree").select("doc_id", "leaf", "subroot", root.alias("root"), siblings_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return verify(docs.withColumn("tampered text", F.when(hit, ascii_lower(F.col("text"))).otherwise(F.col("text"))))


def _oracle(levels: int = 7) -> str:
    """The trees level by level, sixteen to the power of ``levels`` nodes at most."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bits = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_transform(range(8), lambda i: (ascii(c) >> i) & 1)))"
    crc = f"xor(list_reduce(list_transform({bits}, lambda b: b::BIGINT), lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1)), 4294967295::BIGINT), 4294967295)"
    head = ", ".join(["doc_id", "source", "lang", "n_chars"])
    digest = lambda text: "sha256(" + " || ".join([*map(field, head.split(", ")), field(text)]) + ")"
    parts = [
        f"d AS (SELECT *, CASE WHEN {crc} % 5 = 0 THEN {lower} ELSE text END AS changed FROM documents)",
        f"l AS (SELECT doc_id, source, {digest('text')} AS leaf, {digest('changed')} AS folded FROM d)",
        "a0 AS (SELECT *, coalesce(source, '') || CASE WHEN source IS NULL THEN '-' ELSE '+' END AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l)",
        "n0 AS (SELECT tree, n, pos, leaf AS digest FROM a0)",
        "w0 AS (SELECT a0.*, pos AS own, n AS size, leaf AS node, '' AS proof FROM a0)",
    ]

    def climb(k: int, n: str, w: str) -> None:
        """Level ``k``: nodes of the level and every leaf's node, proof and folded digest."""
        side = lambda op: f"coalesce((SELECT string_agg(digest, '' ORDER BY pos) FROM {n}{k - 1} x WHERE x.tree = y.tree AND x.pos // 16 = y.own // 16 AND x.pos {op} y.own), '')"
        parts.append(f"{n}{k} AS (SELECT tree, (any_value(n) + 15) // 16 AS n, pos // 16 AS pos, sha256(string_agg(digest, '' ORDER BY pos)) AS digest FROM {n}{k - 1} WHERE n > 1 GROUP BY tree, pos // 16 UNION ALL SELECT tree, n, pos, digest FROM {n}{k - 1} WHERE n = 1)")
        parts.append(f"s{w}{k} AS (SELECT *, CASE WHEN size > 1 THEN {side('<')} ELSE '' END AS before, CASE WHEN size > 1 THEN {side('>')} ELSE '' END AS after FROM {w}{k - 1} y)")
        parts.append(f"{w}{k} AS (SELECT * EXCLUDE (folded, proof, own, size, before, after), own // 16 AS own, (size + 15) // 16 AS size, proof || before || after AS proof, CASE WHEN size > 1 THEN sha256(before || folded || after) ELSE folded END AS folded FROM s{w}{k})")

    for k in range(1, levels + 1):
        climb(k, "n", "w")
    parts += [
        f"sub AS (SELECT tree AS name, digest AS subroot, row_number() OVER (ORDER BY right(tree, 1) DESC, tree) - 1 AS pos FROM n{levels})",
        "m0 AS (SELECT 't' AS tree, count(*) OVER () AS n, pos, subroot AS digest FROM sub)",
        f"v0 AS (SELECT doc_id, leaf, subroot, 't' AS tree, sub.pos AS own, (SELECT count(*) FROM sub) AS size, proof, folded FROM w{levels} JOIN sub ON sub.name = w{levels}.tree)",
    ]
    for k in range(1, levels + 1):
        climb(k, "m", "v")
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, (SELECT digest FROM m{levels}) AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = (SELECT digest FROM m{levels}) AS verified FROM v{levels}"


ORACLE_SQL = _oracle()
