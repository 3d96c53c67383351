"""Readers of large files and the monitor of rounds."""

import random

import pytest

from strandloom.sources import scans
from strandloom.streaming import monitor

HEAD = "##gff-version 3\n"
LINE = "c%201\ts%3B\tCDS\t1\t9\t.\t+\t0\tID=c"


def write(tmp_path, name, text):
    (tmp_path / name).write_bytes(text.encode())
    return f"file://{tmp_path}/{name}"


@pytest.fixture
def small_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    for k in keys:
        spark.conf.set(k, "20000")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_large_fasta_is_read_by_several_tasks(spark, tmp_path, small_splits, ending):
    rnd = random.Random(1)
    want = [(f"r{i}", f"about >{i} x", "".join(rnd.choice("ACGT") for _ in range(rnd.choice([0, 50, 700, 30_000 if i % 40 == 0 else 10])))) for i in range(300)]
    text = "".join(f">{n} {d}{ending}" + "".join(s[k : k + 60] + ending for k in range(0, len(s), 60)) for n, d, s in want)
    df = scans.read_fasta(spark, write(tmp_path, "x.fa", text))
    assert df.rdd.getNumPartitions() > 4
    assert sorted((r.name, r.description, r.seq) for r in df.collect()) == sorted(want)


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_large_gff_is_read_by_several_tasks(spark, tmp_path, small_splits, ending):
    body = "".join(f"c{i % 3}\tx\t{'gene' if i % 5 else 'CDS'}\t{i + 1}\t{i + 40}\t1.5\t{'+-.?'[i % 4]}\t{'.' if i % 5 else 0}\tID=f{i // 10};Note=n{i}{ending}" for i in range(4000))
    text = HEAD.strip() + ending + "# comment" + ending + ending + body + "##FASTA" + ending + ">c0" + ending + "ACGT" + ending
    path = write(tmp_path, "x.gff", text)
    df = scans.read_gff3(spark, path)
    assert scans.numbered_lines(spark, path).rdd.getNumPartitions() > 4
    got = df.orderBy("line_no").collect()
    assert [(r.lo, r.hi, r.strand, r.attributes["Note"]) for r in got] == [(i + 1, i + 40, (1, -1, 0, 0)[i % 4], [f"n{i}"]) for i in range(4000)]
    assert got[0].score == 1.5 and got[0].phase == 0 and got[1].phase is None
    # The same features as from the whole text in a cell.
    cell = scans.parse_gff3(spark.createDataFrame([("f", text)], "file string, content string"), strict=True)
    assert sorted(cell.drop("file", "line_no", "attributes").collect()) == sorted(df.drop("file", "line_no", "attributes").collect())


@pytest.mark.parametrize(
    ("line", "why"),
    [
        (LINE.replace("\t1\t9\t", "\t9\t1\t"), "start after end"), (LINE.replace("\t1\t9\t", "\t0\t9\t"), "from 1"), (LINE.replace("\t1\t9\t", "\tx\t9\t"), "from 1"), (LINE.replace("\t+\t", "\tx\t"), "unknown strand"),
        (LINE.replace("\t0\tID", "\t.\tID"), "needs a phase"), (LINE.replace("\t0\tID", "\t3\tID"), "phase is neither"), (LINE.replace("\t.\t+", "\tbad\t+"), "score is neither"), (LINE.replace("c%201", "c%2"), "malformed"), ("a\tb", "nine columns"),
    ],
)
def test_gff_lines_that_are_refused(spark, line, why):
    with pytest.raises(Exception, match=why):
        scans.parse_gff3(spark.createDataFrame([("f", HEAD + line)], "file string, content string")).collect()


def test_gff_names_are_decoded_and_carriage_returns_go(spark):
    r = scans.parse_gff3(spark.createDataFrame([("f", f"{HEAD}{LINE};Note=b\r\n{LINE}\r\n".replace("\n", "\r\n", 1))], "file string, content string"), strict=True).collect()
    assert [(x.seqid, x.source, x.lo, x.hi, x.strand) for x in r] == [("c 1", "s;", 1, 9, 1)] * 2 and r[0].attributes == {"ID": ["c"], "Note": ["b"]}


@pytest.mark.parametrize("first", ["", "\n", "##gff-version3\n", "##gff-version 2\n", "##gff-version 3 x\n", "# x\n"])
def test_gff_must_declare_its_version(spark, tmp_path, first):
    with pytest.raises(Exception, match="gff-version"):
        scans.parse_gff3(spark.createDataFrame([("f", first + LINE)], "file string, content string"), strict=True).collect()
    with pytest.raises(Exception, match="gff-version"):
        scans.read_gff3(spark, write(tmp_path, "y.gff", first + LINE)).collect()


def test_large_alignment_is_read_by_several_tasks(spark, tmp_path, small_splits):
    rnd = random.Random(2)
    rows = {f"s{i}": ["".join(rnd.choice("ACGU-") for _ in range(50)) for _ in range(40)] for i in range(30)}
    text = "# STOCKHOLM 1.0\n\n" + "\n".join("".join(f"{n}  {c[b]}\n" for n, c in rows.items()) + f"#=GC SS_cons {'.' * 50}\n" for b in range(40)) + "//\n"
    path = write(tmp_path, "x.sto", text)
    got = {r.row_name: r.aligned for r in scans.read_stockholm(spark, path).collect()}
    assert got == {n: "".join(c) for n, c in rows.items()} | {"#=GC SS_cons": "." * 2000}
    with pytest.raises(Exception, match="different width"):
        scans.read_stockholm(spark, write(tmp_path, "bad.sto", text.replace("//", "s0 A\n//"))).collect()


def test_reports_are_small(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scans, "MAX_REPORT", 3)
    scans.write_json_report(spark.range(3), f"{tmp_path}/ok")
    with pytest.raises(ValueError, match="at most 3"):
        scans.write_json_report(spark.range(4), f"{tmp_path}/large")


ROUNDS = [(1, 1, 80, 100), (1, 2, 90, 100), (1, 3, 5, 9), (1, 4, 86, 100), (1, 5, 85, 100), (1, 6, 99, 100), (2, 1, 19, 20), (2, 2, 18, 20), (3, 1, 1, 2), (3, 2, 10, 10), (3, 4, 1, 10), (4, 2, 5, 50)]


def key(rows):
    return sorted(tuple(r) for r in rows)


def test_outcomes_by_hand(spark):
    got = key(monitor.round_outcomes(spark.createDataFrame(ROUNDS, "run long, round long, hits long, probes long"), drop=0.05, minimum=10).collect())
    say = {(r[0], r[1]): r[4:] for r in got}
    assert say == {
        (1, 1): (None, None, "continue"), (1, 2): (0.8, 1, "continue"), (1, 3): (0.9, 2, "inadmissible"), (1, 4): (0.9, 2, "continue"), (1, 5): (0.9, 2, "halt_rollback"), (1, 6): (0.9, 2, "after_halt"),
        (2, 1): (None, None, "continue"), (2, 2): (0.95, 1, "halt_rollback"),  # a drop of exactly the threshold
        (3, 1): (None, None, "inadmissible"), (3, 2): (None, None, "continue"),
    }


def test_late_and_repeated_rounds_equal_the_batch(spark, tmp_path):
    rnd = random.Random(3)
    rows = ROUNDS + [(run, k, rnd.randrange(60, 100), 100) for run in (7, 8) for k in range(1, 30)] + [(3, 3, 10, 10)]
    schema = "run long, round long, hits long, probes long"
    rnd.shuffle(rows)
    src, sink, cp = (f"{tmp_path}/{x}" for x in ("src", "sink", "cp"))
    for i in range(4):  # four restarts from the checkpoint, every second row sent again
        some = rows[i::4] + rows[: 10 * i : 2]
        spark.createDataFrame(some, schema).repartition(2).write.mode("append").parquet(src)
        got = monitor.watch_rounds(spark, src, drop=0.05, minimum=10, checkpoint=cp, sink=sink).collect()
        assert len({(r.run, r.round) for r in got}) == len(got)
    assert key(got) == key(monitor.round_outcomes(spark.createDataFrame(rows, schema), drop=0.05, minimum=10).collect())
    assert {r.decision for r in got} == {"continue", "inadmissible", "halt_rollback", "after_halt"}


def test_connect_tables_are_read_where_they_lie(spark):
    ok = "4 x\n1 A 0 2 4 1\n 2  C 1 3 0 2 \n\n3 G 2 4 1 3\n4 U 3 5 1 4 more\n"
    files = spark.createDataFrame([("a", ok), ("b", None), ("c", "1 x\n")], "file string, content string")
    pairs = scans.parse_ct(files)
    assert sorted(map(tuple, pairs.select("file", "i", "j", "mirrored").collect())) == [("a", 1, 4, True), ("a", 3, 1, False), ("a", 4, 1, True)]
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    with pytest.raises(Exception, match="connect table"):
        scans.parse_ct(spark.createDataFrame([("d", "1 x\n1 A 0 2\n")], "file string, content string")).collect()


def test_match_columns_do_not_move_letters(spark):
    from strandloom.operators.tournament import match_columns

    rows = [(1, 10, "AC.GU"), (1, 11, "ACGgUA"), (1, 12, None), (2, 20, "G.C"), (2, 21, "..."), (None, 30, "ACGU")]
    df = spark.createDataFrame(rows, "aln int, r int, s string")
    got = match_columns(df, alignment="aln", row="r", aligned="s")
    assert sorted(map(tuple, got.collect())) == [(10, "013"), (11, "0130")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "posexplode" not in plan


def test_gff3_files_are_read_whole_or_as_lines(spark, tmp_path, monkeypatch):
    """Each file was read three times as lines; features of both ways are the same."""
    head = "##gff-version 3\n"
    row = lambda n, note: f"c%3A1\tsrc\tCDS\t{n}\t{n + 9}\t.5e1\t-\t0\tID=a;Note=x%2Cy,z;Note=q\r\n#c\n\nc\tsrc\tgene\t{n}\t{n}\t.\t?\t.\t{note}\n"
    for i in range(3):
        (tmp_path / f"f{i}.gff").write_bytes((head + "".join(row(n, "." if n % 2 else "k=v=w") for n in range(1, 4 + 40 * i)) + ">x\nnot\ta line\n").encode())
    (tmp_path / "empty.gff").write_bytes(b"")

    def features():
        rows = scans.read_gff3(spark, str(tmp_path)).collect()
        keep = lambda r: (r.file, r.seqid, r.source, r.type, r.lo, r.hi, r.score or -1.0, r.strand, -1 if r.phase is None else r.phase, str(sorted(r.attributes.items())))
        return sorted(keep(r) for r in rows)

    whole = features()
    assert len(whole) == 2 * (3 + 43 + 83) and whole[0][1:] == ("c", "src", "gene", 1, 1, -1.0, 0, -1, "[]")
    assert whole[3][1:9] == ("c:1", "src", "CDS", 1, 10, 5.0, -1, 0) and whole[3][9] == "[('ID', ['a']), ('Note', ['x,y', 'z', 'q'])]"
    monkeypatch.setattr(scans, "WHOLE_BYTES", 1_000)
    assert features() == whole
    monkeypatch.setattr(scans, "WHOLE_BYTES", 0)
    assert features() == whole
