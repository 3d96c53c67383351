"""Folds by the largest deficit against a plain loop over all clusters."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from strandloom.operators.folds import deficit_folds

RATIOS = {"train": 0.8, "val": 0.1, "test": 0.1}


def plain(rows, ratios, seed):
    members = defaultdict(list)
    for cluster, stratum in rows:
        if cluster is not None:
            members[cluster].append(stratum)
    clusters = []
    for c, strata in members.items():
        seen = Counter(s for s in strata if s)
        own = min(seen, key=lambda s: (-seen[s], s)) if seen else ""
        clusters.append((own, hashlib.md5(f"{seed}:{own}:{c}".encode()).hexdigest(), c, len(strata)))
    counts, out = dict.fromkeys(ratios, 0), []
    for stratum, _, c, n in sorted(clusters):
        total = sum(counts.values()) + n
        fold = max(ratios, key=lambda f: ratios[f] - (counts[f] + n) / total)
        counts[fold] += n
        out.append((c, stratum, n, fold))
    return sorted(out)


def check(spark, rows, ratios=RATIOS, seed="s"):
    df = spark.createDataFrame(rows, "c long, g string, extra string")
    got = deficit_folds(df, cluster="c", stratum="g", ratios=ratios, seed=seed)
    assert got.columns == ["c", "g", "n", "fold"]
    result = sorted(tuple(r) for r in got.collect())
    assert result == plain([r[:2] for r in rows], ratios, seed)
    return result


@pytest.mark.parametrize("draw", range(3))
def test_equals_the_loop_on_drawn_clusters(spark, draw):
    rng = random.Random(draw)
    sizes = [rng.choice([1, 1, 1, 2, 3, 7, 40 * draw + 1]) for _ in range(600)]
    rows = [(c, rng.choice(["a", "b", "c", "", None, "ü"]), "x") for c, n in enumerate(sizes) for _ in range(n)]
    check(spark, rows, seed=str(draw))


def test_one_cluster_of_most_records_and_single_records(spark):
    rows = [(0, "m", None)] * 3000 + [(c, "a" if c % 2 else "z", None) for c in range(1, 900)]
    check(spark, rows, {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05})


def test_no_rows_no_cluster_one_cluster(spark):
    assert check(spark, []) == []
    assert check(spark, [(None, "a", "x")]) == []
    assert check(spark, [(5, None, "x"), (5, "", "x"), (None, "b", "x")]) == [(5, "", 2, "train")]
