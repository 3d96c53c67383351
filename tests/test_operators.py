"""Edge semantics with values worked out by hand, and planted violations."""

import pytest
from pyspark.sql import functions as F

from strandloom.functions import loci as L
from strandloom.functions import sequence as S
from strandloom.operators import calling, cluster, evidence, intervals, metrics, selection, sequences, statistics, structure, taxonomy, validation
from strandloom.sources import scans


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*(cols or df.columns)).collect())


def test_adjacent_intervals_merge_and_gaps_stay(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 6, 9), ("a", 11, 12), ("b", 3, 4)], "acc string, lo long, hi long")
    assert rows(intervals.merge_intervals(df), "acc", "lo", "hi") == [("a", 1, 9), ("a", 11, 12), ("b", 3, 4)]
    assert rows(intervals.merge_intervals(df, adjacent=False), "acc", "lo", "hi") == [("a", 1, 5), ("a", 6, 9), ("a", 11, 12), ("b", 3, 4)]


def test_mask_at_the_flank_and_across_bins(spark):
    known = spark.createDataFrame([("a", 100, 9000), ("b", 5, 6)], "acc string, lo long, hi long")
    c = spark.createDataFrame([("x", "a", 9050, 9060), ("y", "a", 9051, 9060), ("z", None, 100, 120), ("w", "b", 40, 50)], "locus_id string, acc string, lo long, hi long")
    assert rows(intervals.masked_ids(c, known, flank=50)) == [("w",), ("x",)]
    pairs = intervals.overlap_join(c.withColumn("lo", F.lit(1)).withColumn("hi", F.lit(20000)).where("acc = 'a'"), known)
    assert pairs.count() == 2  # long intervals meet in one bin only


def test_null_tokens_and_booleans(spark):
    df = spark.createDataFrame([(" NaN ",), ("yes",), (None,), ("F",)], "c string")
    assert [r[0] for r in df.select(L.tri_state("c")).collect()] == [None, True, None, False]
    with pytest.raises(Exception, match="not a boolean"):
        spark.createDataFrame([("maybe",)], "c string").select(L.tri_state("c")).collect()


def test_sentinel_and_junk(spark):
    v, junk = L.sentinel_number("c", -2)
    got = spark.createDataFrame([("-2",), ("7",), ("x",), ("",), (None,)], "c string").select(v, junk).collect()
    assert [tuple(r) for r in got] == [(None, False), (7, False), (None, True), (None, False), (None, False)]


def test_window_starts_anchor_the_end(spark):
    got = spark.createDataFrame([(10,), (64,), (65,), (192,), (200,)], "n int").select("n", S.window_starts("n", 64, 32).alias("s"), S.n_windows("n", 64, 32).alias("k")).collect()
    assert [list(r.s) for r in got] == [[0], [0], [0, 1], [0, 32, 64, 96, 128], [0, 32, 64, 96, 128, 136]]
    assert all(len(r.s) == r.k for r in got)


def test_anchor_counts_overlapping_hits(spark):
    st, off = S.anchor(F.col("l"), F.col("r"))
    got = spark.createDataFrame([("AA", "CAAA"), ("AA", "CAAC"), ("G", "CAAC"), ("", "C"), ("A", None)], "l string, r string").select(st, off).collect()
    assert [tuple(r) for r in got] == [("ambiguous", None), ("anchored", 1), ("absent", None), ("no_locus", None), ("no_region", None)]


def test_paint_precedence_and_clamping(spark):
    df = spark.createDataFrame([(5, 2, 9)], "n int, lo int, hi int")
    assert df.select(S.paint(F.col("n"), [("S", F.col("lo"), F.col("hi")), ("L", F.lit(3), F.lit(3)), ("X", F.lit(9), F.lit(8))])).first()[0] == ".SLSS"


def test_carve_pads_both_sides(spark):
    df = spark.createDataFrame([("ACGT", -2), ("ACGT", 3), ("ACGT", -9)], "s string, a int")
    assert [r[0] for r in df.select(S.carve("s", "a", 6)).collect()] == ["NNACGT", "TNNNNN", "NNNNNN"]


def test_runs_gap_merge_then_span(spark):
    p = spark.createDataFrame([("c", i, 1, s) for i, s in enumerate([9, 9, 0, 9, 0, 0, 9, 0], 1)], "contig string, pos int, cls int, p int")
    got = calling.call_candidates(p, threshold=5, gap=1, min_span=2)
    assert rows(got, "start", "end", "n_flagged", "dominant") == [(1, 5, 3, 1)]


def test_strand_vote_needs_its_margin(spark):
    e = spark.createDataFrame([("a", 1, 1), ("a", 2, 5), ("a", 3, 9), ("b", 1, 9), ("b", 2, 5), ("b", 3, 1), ("c", 1, 3)], "locus string, cls int, pos int")
    got = {r.locus: (r.reason, list(r.strands)) for r in calling.resolve_strand(e, rank={1: 0, 2: 1, 3: 2}, margin=2).collect()}
    assert got == {"a": ("resolved", [1]), "b": ("resolved", [-1]), "c": ("no_pairs", [1, -1])}


def test_kleene_table_is_exhaustive(spark):
    import itertools

    states = list(itertools.product([True, False, None], repeat=4))
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(states)], "id int, a boolean, b boolean, c boolean, d boolean")
    got = {r.id: r.spared for r in evidence.spare_rule(df, {k: k for k in "abcd"}).collect()}
    assert got == {i: any(x is True for x in s) or any(x is None for x in s) for i, s in enumerate(states)}


def test_idle_evidence_is_named(spark):
    m = spark.createDataFrame([(1,), (2,)], "id int")
    t = spark.createDataFrame([(9, True)], "id int, ev boolean")
    assert rows(evidence.refuse_idle_tables(m, {"ev": t}, "id"), "evidence", "idle") == [("ev", True)]


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 500), (900, 800), (None, 1)]
    got = dict(rows(cluster.connected_components(spark.createDataFrame(edges, "a long, b long"))))
    assert {got[i] for i in range(201)} == {0} and got[900] == 800 == got[800] and got[500] == 500


def test_components_of_nothing(spark):
    assert cluster.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_undefined_rates_are_null(spark):
    r = metrics.prf(spark.createDataFrame([(0, 0, 0), (1, 0, 1)], "tp int, fp int, fn int")).collect()
    assert r[0].precision is None and r[0].recall is None and r[0].f1 is None and r[1].recall == 0.5


def test_average_precision_groups_ties(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0)], "s double, y int")
    assert metrics.average_precision(metrics.ranking_curve(df, score="s", label="y")).first()["ap"] == pytest.approx(0.5 + 0.5 * 2 / 3)


def test_bootstrap_of_one_block_is_null(spark):
    s = spark.createDataFrame([("b", 1, 2)], "block string, a long, n long")
    w = metrics.block_bootstrap_weights(s, block="block", replicates=5, seed="x")
    r = metrics.bootstrap_ratio(s, w, block="block", numerator="a", denominator="n").first()
    assert (r.point, r.lo, r.hi) == (0.5, None, None)


def test_leaks_are_found_and_clean_tables_pass(spark):
    cols = "record long, cluster_id long, genus string, fold string, heldout boolean, nested_train boolean, calib boolean"
    clean = [(1, 1, "g", "train", False, True, False), (2, 1, "g", "train", False, True, False), (3, 2, "h", "test", True, False, False)]
    assert set(validation.leak_report(spark.createDataFrame(clean, cols)).first()) == {0}
    bad = [(1, 1, "g", "train", False, True, False), (1, 1, "g", "test", True, True, True)]
    r = validation.leak_report(spark.createDataFrame(bad, cols)).first().asDict()
    for k in ("clusters_across_folds", "clusters_across_calib", "clusters_train_and_heldout", "clusters_test_and_train", "calib_outside_train", "heldout_in_train", "train_outside_fold", "repeated_records"):
        assert r[k] >= 1, k


def test_gate_over_nothing_is_false(spark):
    r = validation.clauses(spark.createDataFrame([], "x int"), {"pos": F.col("x") > 0}).first()
    assert r.n == 0 and r["pos"] is False and r.passed is False
    with pytest.raises(ValueError):
        validation.require(validation.parse_gate(spark.range(3), rows=4, columns=1), "rows")


def test_carve_never_splits_a_cluster(spark):
    df = spark.range(1000).selectExpr("id AS record", "id div 7 AS cluster", "cast(id % 3 AS string) AS stratum")
    got = selection.whole_cluster_carve(df, cluster="cluster", stratum="stratum", fraction=0.2, seed="s")
    assert got.count() == df.select("cluster").distinct().count()
    held = got.groupBy("held").sum("n").collect()
    assert 0.15 < {r.held: r[1] for r in held}[True] / 1000 < 0.3


def test_global_rank_is_dense(spark):
    got = statistics.global_rank(spark.range(5000).selectExpr("id", "hash(id) AS h"), [F.col("h"), F.col("id")])
    ordered = got.orderBy("h", "id").select("rank").collect()
    assert [r[0] for r in ordered] == list(range(1, 5001))


def test_shuffle_keeps_pairs_and_ends():
    s = "ACGTTGCAACGGTTAACC" * 3
    t = sequences.euler_shuffle(s, "k")
    pairs = lambda x: sorted(x[i : i + 2] for i in range(len(x) - 1))
    assert pairs(s) == pairs(t) and (s[0], s[-1]) == (t[0], t[-1]) and t == sequences.euler_shuffle(s, "k")


def test_brackets_that_do_not_balance(spark):
    df = spark.createDataFrame([(1, "((.))"), (2, "(()"), (3, ")(")], "id int, s string")
    assert rows(structure.pair_table(df, id_col="id", structure="s"), "id", "i", "j") == [(1, 1, 5), (1, 2, 4), (2, 2, 3)]


def test_lineage_cycles_and_merged_ids(spark):
    nodes = spark.createDataFrame([(1, 1, "root"), (2, 1, "p"), (3, 2, "g"), (8, 9, "x"), (9, 8, "x")], "taxid long, parent long, rank string")
    merged = spark.createDataFrame([(30, 3)], "old long, new long")
    ids = spark.createDataFrame([(30,), (8,), (77,)], "taxid long")
    got = taxonomy.lineage_by_rank(ids.where("taxid <> 8"), nodes, merged)
    assert rows(got.where("taxid = 30"), "ancestor") == [(1,), (2,), (3,)] and got.where("taxid = 77").count() == 0
    with pytest.raises(Exception, match="cycle of parents"):
        taxonomy.lineage_by_rank(ids, nodes, merged).collect()


def test_deep_lineages_are_whole(spark):
    deep = spark.range(1, 62).selectExpr("id AS taxid", "greatest(id - 1, 1) AS parent", "'r' AS rank")
    none = spark.createDataFrame([], "old long, new long")
    assert taxonomy.lineage_by_rank(deep.where("taxid = 61").select("taxid"), deep, none).count() == 61


def test_gff_refuses_wrong_width_and_split_ids(spark):
    line = "s\tx\tCDS\t1\t9\t.\t{}\t0\tID=c"
    ok = spark.createDataFrame([("f", line.format("+") + "\n" + line.format("+") + "\n>s\nACGT")], "file string, content string")
    assert rows(scans.group_cds(scans.parse_gff3(ok)), "cds_id", "lo", "hi") == [("c", 1, 9)]
    bad = spark.createDataFrame([("f", "a\tb")], "file string, content string")
    with pytest.raises(Exception, match="nine columns"):
        scans.parse_gff3(bad).collect()
    two = spark.createDataFrame([("f", line.format("+") + "\n" + line.format("-"))], "file string, content string")
    with pytest.raises(Exception, match="one ID"):
        scans.group_cds(scans.parse_gff3(two)).collect()


def test_resumed_stream_reads_new_files_only(spark, tmp_path):
    from strandloom.streaming.scan import incremental_tiles

    src, sink, cp = (str(tmp_path / x) for x in ("src", "sink", "cp"))
    args = dict(schema="id long, seq string", id_col="id", seq_col="seq", window=4, stride=2, checkpoint=cp, sink=sink)
    spark.createDataFrame([(1, "ACGTACGT")], "id long, seq string").write.parquet(src)
    assert incremental_tiles(spark, src, **args).count() == 3
    spark.createDataFrame([(2, "ACGT")], "id long, seq string").write.mode("append").parquet(src)
    assert rows(incremental_tiles(spark, src, **args).groupBy("id").count()) == [(1, 3), (2, 1)]


def test_weighted_draws_follow_the_weights(spark):
    from strandloom.operators.sampling import weighted_draws

    df = spark.createDataFrame([(i, w) for i, w in enumerate([0, 1, 3, 6] * 25)], "id long, w long")
    draws = spark.range(4000).withColumnRenamed("id", "id")
    got = weighted_draws(df, id_col="id", weight="w", draws=draws, seed="t")
    assert got.count() == 4000
    share = {r.k: r.n / 4000 for r in got.groupBy((F.col("id") % 4).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert 0 not in share and abs(share[1] - 0.1) < 0.03 and abs(share[2] - 0.3) < 0.04 and abs(share[3] - 0.6) < 0.04


@pytest.mark.parametrize("n", [0, 4, 15, 100])
def test_reliability_bins_are_ntiles(spark, n):
    df = spark.range(n).selectExpr("id", "id / 100D AS p", "cast(id % 2 AS int) AS y")
    got = [r.n for r in metrics.reliability(df, p="p", label="y", id_col="id").orderBy("bin").collect()]
    assert got == [n // 15 + (i < n % 15) for i in range(15) if n // 15 + (i < n % 15)]


@pytest.mark.parametrize("name", ["j01_interval_mask", "j08_downstream_gene", "j21_best_overlap", "w14_control_windows", "e10_weighted_draws"])
def test_no_nested_loops(spark, name):
    from strandloom.plans.catalog import QUERIES

    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def gff(spark, *attributes):
    text = "\n".join(f"s\tx\tCDS\t{9 * i + 1}\t{9 * i + 9}\t.\t+\t0\t{a}" for i, a in enumerate(attributes))
    return scans.parse_gff3(spark.createDataFrame([("f", text)], "file string, content string"))


def test_gff_attributes(spark):
    got = [r.attributes for r in gff(spark, "ID=a;Note=x=y;Note=z,w%2Cv", ".", "product=NAD(P)+ 100%25 id;empty=; ;", "k%3D=%C3%A9").orderBy("line_no").collect()]
    assert got == [{"ID": ["a"], "Note": ["x=y", "z", "w,v"]}, {}, {"product": ["NAD(P)+ 100% id"], "empty": [""]}, {"k=": ["é"]}]
    for bad, why in (("lone", "fragment"), ("=v", "fragment"), ("k=100% id", "malformed"), ("ID=%FF", "UTF-8")):
        with pytest.raises(Exception, match=why):
            gff(spark, bad).collect()


def test_cds_rows_join_their_attributes(spark):
    got = scans.group_cds(gff(spark, "ID=a;product=p", "ID=b", "ID=a;product=q;pseudo=true", "product=r", "ID=row:3", "ID= ")).collect()
    by = {(r.cds_id, r.declared): r for r in got}
    a = by["a", True]
    assert len(by) == 5 and a.attributes == {"ID": ["a", "a"], "product": ["p", "q"], "pseudo": ["true"]} and [tuple(x) for x in a.segments] == [(1, 9), (19, 27)]
    assert by["row:3", False].attributes == {"product": ["r"]} and by["row:3", True].attributes == {"ID": ["row:3"]}


def test_csv_texts_survive(spark, tmp_path):
    texts = ["a\rb", "a\r\nb", "\n\n", 'say "x", "y"', " lead", "tail ", "\r", "é\u2028", "back\\slash\\"]
    path = str(tmp_path / "csv")
    df = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "_c0 int, k int, text string")
    df.write.csv(path, header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    got = {int(r.k): r.text for r in scans.read_corpus_csv(spark, path, ["_c0", "k", "text"]).collect()}
    assert got == dict(enumerate(texts))


def test_fasta_headers_may_hold_the_mark(spark, tmp_path):
    path = tmp_path / "x.fa"
    path.write_text(">a tRNA 5'->3' end\nAC\ngt\n>b\n\n>a again\nTT\n")
    got = sorted(map(tuple, scans.read_fasta(spark, str(path)).select("name", "description", "seq").collect()))
    assert got == [("a", "again", "TT"), ("a", "tRNA 5'->3' end", "ACGT"), ("b", "", "")]


def test_alignment_rows_of_one_width(spark):
    bad = spark.createDataFrame([("f", "# STOCKHOLM 1.0\na  ACG\nb  AC\n//")], "file string, content string")
    with pytest.raises(Exception, match="different width"):
        scans.parse_stockholm(bad).collect()


def test_kinds_in_the_record_hash(spark):
    one = spark.sql("SELECT 1 AS i, 1L AS l, '1' AS s, 1.0D AS f, true AS b, 'true' AS t, date'2024-01-01' AS d, '2024-01-01' AS e")
    h = {c: one.select(L.row_hash([F.col(c)])).first()[0] for c in one.columns}
    assert h["i"] == h["l"] and len({h[c] for c in "isfbtde"}) == 7
    assert one.select(L.clean_null(F.lit(" N/A ")), L.clean_null(F.lit("n/b"))).first()[:] == (None, "n/b")


def test_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    from strandloom import session

    class Conf:
        def get(self, key, default):
            return default

    class Nothing:
        def isDefined(self):
            return False

    class Context:
        master = "spark://host:7077"

        class _jsc:
            class sc:
                def getCheckpointDir(self):
                    return Nothing()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(Session())


def test_digest_levels_ignore_order(spark):
    h = spark.range(3000).selectExpr("sha2(cast(id AS string), 256) AS h", "id % 2 AS g")
    whole = selection.table_digest(h).first()
    assert whole == selection.table_digest(h.orderBy("h")).first() and whole.n == 3000 and whole.digest != selection.table_digest(h.limit(2999)).first().digest
    assert selection.table_digest(h, by=["g"], digits=2).count() == 2


def test_segments_with_shifts_and_ties(spark):
    import random

    rnd = random.Random(6)
    seq = "".join(rnd.choice("ACGT") for _ in range(400))
    a, b = seq[50:80], seq[100:130]
    segs = [("ok", a, 0), ("ok", b, 50), ("shift", a, 0), ("shift", b, 45), ("far", a, 0), ("far", b, 44), ("bad", a, 0), ("bad", "".join("ACGT"["TGCA".index(x)] if i % 6 == 0 else x for i, x in enumerate(b[:24])) + "ACGTAC", 50)]
    df = spark.createDataFrame(segs, "leader_id string, seq string, offset long")
    one = spark.createDataFrame([(1, seq)], "contig_id long, seq string")
    got = {r.leader_id: (r.status, r.start0, r.end0, r.mismatches, r.exact) for r in sequences.localise(one, df, k=14, contig_id="contig_id", leader_id="leader_id").collect()}
    assert got == {"ok": ("unique", 50, 130, 0, True), "shift": ("unique", 50, 130, 0, False)}
    twice = spark.createDataFrame([(1, seq), (2, seq)], "contig_id long, seq string")
    assert {r.status for r in sequences.localise(twice, df.where("leader_id = 'ok'"), k=14, contig_id="contig_id", leader_id="leader_id").collect()} == {"ambiguous"}


def test_pairing_pattern():
    assert structure.pairing_pattern("NCCA", 4) == "[U][G][G][ACGU]" and structure.pairing_pattern("CA", 2, wobble=True) == "[U][G]"
    assert structure.pairing_pattern("GU", 2, wobble=True) == "[AG][CU]" and structure.pairing_pattern("NCCA", 1) == "[U]|[G]|[G]"
    for acceptor, n in (("NN", 1), ("NCCA", 5), ("XX", 1)):
        with pytest.raises(ValueError):
            structure.pairing_pattern(acceptor, n)


def test_monitor_halts_across_batches(spark, tmp_path):
    from strandloom.streaming.scan import best_so_far

    src, sink, cp = (str(tmp_path / x) for x in ("src", "sink", "cp"))
    schema = "run long, round long, recall long"
    args = dict(drop=5, checkpoint=cp, sink=sink)
    spark.createDataFrame([(1, 2, 90), (1, 1, 80), (2, 1, 70), (2, 2, 66)], schema).write.parquet(src)
    assert rows(best_so_far(spark, src, schema, **args)) == [(1, 90, 2, False), (2, 70, 2, False)]
    spark.createDataFrame([(1, 3, 85), (2, 3, 75)], schema).write.mode("append").parquet(src)
    assert rows(best_so_far(spark, src, schema, **args)) == [(1, 90, 3, True), (2, 75, 3, False)]


def test_similarity_blocks_follow_the_rows(spark, monkeypatch):
    from strandloom.operators import similarity

    df = spark.range(60).selectExpr("id", "transform(sequence(1, 8), i -> cast((id div 3 + i) % 4 AS int)) AS codes")
    want = {(r.a, r.b) for r in similarity.similarity_links(df, id_col="id", codes="codes", identity=1.0, coverage=0.9).collect()}
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 7)
    got = cluster.connected_components(similarity.similarity_links(df, id_col="id", codes="codes", identity=1.0, coverage=0.9))
    assert rows(got) == rows(cluster.connected_components(spark.createDataFrame(sorted(want), "a long, b long"))) and similarity._n_blocks(df) == 9


def test_dense_labels(spark):
    df = spark.createDataFrame([(5, 5), (9, 5), (7, 7), (1, 1)], "node long, component long")
    assert rows(cluster.dense_labels(df), "node", "label") == [(1, 0), (5, 1), (7, 2), (9, 1)]


def test_running_sums_cross_partitions(spark):
    df = spark.range(4000).selectExpr("id", "hash(id) AS h", "id % 7 AS v")
    got = statistics.running_sums(df, [F.desc("h"), F.col("id")], {"s": "v"}).orderBy(F.desc("h"), "id").collect()
    total = 0
    for r in got:
        total += r.v
        assert r.s == total
    assert {r.total_s for r in got} == {total} and len(got) == 4000
    assert statistics.running_sums(df.where("false"), [F.col("h")], {"s": "v"}).count() == 0
