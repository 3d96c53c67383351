"""The Merkle manifest against a plain construction and SQL."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from strandloom.llm import merkle
from tests.compare import connect, spark_rows, sql_rows

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, pos int, tree string, n int, path string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(level):
    """The root over a list of digests, and each one's siblings by level."""
    paths, owners, nodes = [[] for _ in level], [[i] for i in range(len(level))], list(level)
    while len(nodes) > 1:
        above, owned = [], []
        for a in range(0, len(nodes), 16):
            run = nodes[a : a + 16]
            for j in range(len(run)):
                for o in owners[a + j]:
                    paths[o].append(("".join(run[:j]), "".join(run[j + 1 :])))
            above.append(sha(*run))
            owned.append([o for j in range(len(run)) for o in owners[a + j]])
        nodes, owners = above, owned
    return nodes[0], paths


def brute(rows):
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append((r, leaf(r)))
    kept, subroots = [], []
    for s in sorted(sources, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted(sources[s], key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        sub, paths = tree([d for _, d in own])
        kept.append((own, paths, sub))
        subroots.append(sub)
    if not subroots:
        return []
    root, tops = tree(subroots)
    out = []
    for (own, paths, sub), top in zip(kept, tops, strict=True):
        for (r, d), path in zip(own, paths, strict=True):
            path, node = path + top, d
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                node = leaf((*r[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])))
            for a, b in path:
                node = sha(a, node, b)
            out.append((r[0], d, sub, root, sha(*[a + b for a, b in path]), node, node == root))
    return out


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, "z") for r in rows], SCHEMA)


def tampered(docs):
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return docs.withColumn("tampered text", F.when(hit, merkle.ascii_lower(F.col("text"))).otherwise(F.col("text")))


def key(r):
    return [str(x) for x in r]


EDGE = [(None, None, None, None, None), (None, "b", "en", 1, "A"), (4, None, "de", 3, "Été"), (5, "", "en", 0, ""), (7, "b", "en", 1, "X" * 300_000), (7, "b", "en", 1, "x"), (7, "b", "en", 1, "x"), (9, "lone", None, 2, "Ab")]


@pytest.mark.parametrize("case", ["edge", "empty", "one", "copies", "hot"])
def test_equals_plain_construction(spark, case):
    rng = random.Random(3)
    rows = {
        "edge": EDGE, "empty": [], "one": EDGE[-1:],
        "copies": [(1, "s", "en", 1, "Same")] * 300 + [(2, "s", "en", 1, "Same")] * 20,  # equal subtrees are one record
        "hot": [(rng.randrange(10**6), rng.choice(["hot"] * 9 + [f"s{k}" for k in range(20)]), "en", i, f"Text {i}") for i in range(700)],
    }[case]
    got = [tuple(r) for r in merkle.verify(tampered(rows_of(spark, rows))).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_records_and_a_few_requests(spark, tmp_path):
    rows = [(i, f"s{i % 3}", "en", 1, "Same" if i < 60 else f"t{i}") for i in range(120)]
    docs = rows_of(spark, rows).withColumn("leaf", merkle.leaf_digest(*[F.col(c) for c in merkle.LEAF_COLUMNS])).drop("pos", "tree", "n", "path")
    manifest = merkle.build_manifest(docs, order=["doc_id"])
    merkle.write_manifest(manifest, f"{tmp_path}/m")
    manifest = merkle.read_manifest(spark, f"{tmp_path}/m")
    for r in manifest.records.collect():
        assert sha(*r["children"]) == r["digest"] and 1 <= len(r["children"]) <= 16
    some = merkle.prove(manifest, manifest.leaves.where("doc_id in (3, 64, 119)")).select("doc_id", "leaf", "found", merkle.fold(F.col("leaf"), F.col("path")).alias("root")).collect()
    assert len(some) == 3 and all(r["found"] == r["leaf"] and r["root"] == manifest.root for r in some)


def test_equal_subtrees_are_stored_once(spark):
    docs = spark.createDataFrame([(1, "s", "same")] * 320, "doc_id long, source string, leaf string")
    manifest = merkle.build_manifest(docs, order=["doc_id"])
    assert manifest.records.count() == 4  # a run of leaves, a run of those, one of the last four, the root
    assert merkle.prove(manifest, manifest.leaves).count() == 320


def test_query_equals_sql(spark):
    columns, rows = sql_rows(connect("/root/testdata/sf0.001"), merkle.ORACLE_SQL)
    df = merkle.op12_merkle_manifest(spark, "/root/testdata/sf0.001")
    assert sorted(df.columns) == columns and spark_rows(df) == rows
