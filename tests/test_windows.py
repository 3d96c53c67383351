"""Windows and words of long sequences, against plain loops."""

import pytest

from strandloom.functions import sequence as S
from strandloom.operators import sequences, structure

LONG = ("ACGTTGCA" * 17 + "NNGATTACA") * 900


@pytest.mark.parametrize("k", [1, 3, 32])
def test_kmer_rows_of_long_and_short_sequences(spark, monkeypatch, k):
    monkeypatch.setattr(sequences, "STRETCH", 1000)
    seqs = {1: LONG[:50_001], 2: "AC", 3: "", 4: None, 5: LONG[:1000], 6: LONG[:1001]}
    df = spark.createDataFrame(list(seqs.items()), "id long, seq string")
    got = sorted((r.id, r.p, r.kmer) for r in sequences.kmer_rows(df, id_col="id", seq_col="seq", k=k).collect())
    assert got == sorted((i, p, s[p : p + k]) for i, s in seqs.items() if s for p in range(len(s) - k + 1))


@pytest.mark.parametrize(("window", "stride"), [(128, 64), (64, 64), (50, 70), (100, 33)])
def test_tiles_of_long_and_short_sequences(spark, monkeypatch, window, stride):
    monkeypatch.setattr(sequences, "TILES", 7)
    seqs = {n: LONG[:n] for n in (0, 1, window - 1, window, window + 1, window + stride, 7 * stride, 7 * stride + window, 30_000)}
    df = spark.createDataFrame([*seqs.items(), (-1, None)], "id long, seq string")
    got = sorted((r.id, r.start0, r.window_id, r.window_seq) for r in sequences.tile(df, id_col="id", seq_col="seq", window=window, stride=stride).collect())
    want = []
    for i, s in seqs.items():
        last = max(len(s) - window, 0)
        want += [(i, a, f"{i}:{a}", s[a : a + window]) for a in sorted({*range(0, last + 1, stride), last})]
    assert got == sorted(want)


def test_kmers_of_letters_beyond_one_code_unit(spark):
    df = spark.createDataFrame([("a\U0001f600b\nc",)], "s string")
    assert df.select(S.kmers("s", 2)).first()[0] == ["a\U0001f600", "\U0001f600b", "b\n", "\nc"]


def test_projected_pairs_with_gaps_and_ends_outside(spark):
    rows = spark.createDataFrame([(1, "A-CG-U"), (2, "")], "id long, aligned string")
    pairs = spark.createDataFrame([(1, 1, 6), (1, 2, 4), (1, 3, 4), (1, 4, 9), (2, 1, 2), (3, 1, 2)], "id long, i int, j int")
    got = sorted(structure.project_pairs(rows, pairs, id_col="id").collect(), key=str)
    assert sorted(((r.id, r.i, r.j, r.kept) for r in got), key=str) == sorted(
        [(1, 1, 4, True), (1, 1, 3, False), (1, 2, 3, True), (1, 3, None, False), (2, None, None, False)], key=str
    )


def test_elements_outside_their_sequence_are_refused(spark):
    rows = [(1, "ACGTACGT", 9, 11), (2, "ACGTACGTACG", 9, 11), (3, "ACGT", 1, 4), (4, "ACGT", 0, 2), (5, "ACGT", 3, 2), (6, None, 1, 1)]
    got = sequences.ablation_pairs(spark.createDataFrame(rows, "id long, seq string, lo int, hi int"), seed="s", id_col="id").collect()
    assert [(r.id, r.ablated, len(r.control)) for r in got] == [(2, "ACGTACGT", 8)]
