"""Readers that turn many files into one table, and checked sinks.

Each format has ``parse_*`` on lines or whole files as columns, and where the
framing matters a ``read_*`` on a path.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.session import cut

#: Rows of splits or files that are broadcast at most, and of a report.
MAX_BROADCAST, MAX_REPORT = 100_000, 100_000

def read_corpus_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """RFC-4180 CSV with embedded newlines, all cells as strings; a leading
    unnamed index column is dropped (S01)."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', schema=schema)
    return df.drop(*[c for c in columns if c in ("", "_c0", "Unnamed: 0")])


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``name, description, seq, file``: one row per record, upper case (S02). A record
    starts with ``>`` at the start of a line; ``>`` within a header stays. Files are
    split at any byte and records stay whole, so one of any size is read by many tasks."""
    rec = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value"), F.col("_metadata.file_name").alias("file")).where("trim(value) <> ''")
    rec = rec.withColumn("value", F.regexp_replace("value", "\r(?=\n|$)", ""))
    header = F.split_part("value", F.lit("\n"), F.lit(1))
    body = F.regexp_replace(F.expr("substr(value, length(split_part(value, '\n', 1)) + 1)"), r"\s", "")
    return rec.select(F.split_part(header, F.lit(" "), F.lit(1)).alias("name"), F.expr("substr(split_part(value, '\n', 1), length(split_part(split_part(value, '\n', 1), ' ', 1)) + 2)").alias("description"), F.upper(body).alias("seq"), "file")


def write_fasta(df: DataFrame, path: str, *, name: str, seq: str) -> None:
    """One record per row, 60 letters a line."""
    lines = F.regexp_replace(F.col(seq), "(.{60})", "$1\n")
    df.select(F.concat(F.lit(">"), F.col(name).cast("string"), F.lit("\n"), lines)).write.mode("errorifexists").text(path)


def write_checked(df: DataFrame, path: str, valid: Column) -> str:
    """Parquet at ``path`` if every row is valid, else at ``path.invalid``; gives
    the place (S18)."""
    ok = df.agg(F.coalesce(F.bool_and(F.coalesce(valid, F.lit(False))), F.lit(True))).first()[0]
    where = path if ok else f"{path}.invalid"
    df.write.mode("errorifexists").parquet(where)
    return where


def write_json_report(df: DataFrame, path: str) -> None:
    """A small table as JSON lines in one file, fields that are null included (S18); more
    than ``MAX_REPORT`` rows are an error."""
    n = df.limit(MAX_REPORT + 1).count()
    if n > MAX_REPORT:
        raise ValueError(f"a report holds at most {MAX_REPORT} rows")
    df.coalesce(1).write.option("ignoreNullFields", "false").mode("errorifexists").json(path)


def write_shards(df: DataFrame, path: str, shard: str) -> None:
    """Parquet in one folder per value of ``shard`` (S18), which Spark prunes by when read."""
    df.write.partitionBy(shard).mode("errorifexists").parquet(path)


def parse_species_reps(df: DataFrame, accession: str, lineage: str) -> DataFrame:
    """Representatives without source prefix, with their domain and species."""
    m = F.str_to_map(F.col(lineage), F.lit(";"), F.lit("__"))
    return df.select(F.regexp_replace(accession, "^(RS|GB)_", "").alias("accession"), m["d"].alias("domain"), m["s"].alias("species"))


def numbered_lines(spark: SparkSession, path: str, files: Column | None = None) -> DataFrame:
    """``file, line_no, line`` of text files (those for which ``files`` holds, if given), of any size,
    split wherever Spark does: numbers ascend along each file from 0 and are not dense, as they count
    from each split's first byte. A line ends at ``\\n``, ``\\r`` or both."""
    text = spark.read.text(path) if files is None else spark.read.text(path).where(files)
    rows = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_i"), F.col("value").alias("line"))
    # A split's lines stand one after another in one task; one row a split.
    splits = cut(rows.groupBy("file", "_start").agg(F.min("_i").alias("_first")))
    splits = F.broadcast(splits) if splits.count() <= MAX_BROADCAST else splits.hint("merge")
    return rows.join(splits, ["file", "_start"]).select("file", (F.col("_start") + F.col("_i") - F.col("_first")).alias("line_no"), "line")


_PLACE = re.compile(r"0*[1-9][0-9]{0,17}", re.ASCII)
_NUMBER = re.compile(r"([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)[df]?|[+-]?(?:inf|infinity)|nan", re.ASCII | re.IGNORECASE)
_FRAGMENT = re.compile(r"\s*[^=\s][^=]*=", re.ASCII)
_BAD_ESCAPE = re.compile(r"%(?![0-9A-Fa-f]{2})")


def _decoded(text: str) -> str:
    """``percent_decoded`` of one text."""
    if "%" not in text:
        return text
    if _BAD_ESCAPE.search(text):
        raise ValueError(f"malformed percent-escape: {text}")
    try:
        return unquote_to_bytes(text).decode()
    except UnicodeDecodeError:
        raise ValueError(f"escaped bytes that are not UTF-8: {text}") from None


def _attributes(column: str) -> dict[str, list[str]]:
    """``gff3_attributes`` of one text."""
    out: dict[str, list[str]] = {}
    text = column.strip(" ")
    for part in ("" if text == "." else text).split(";"):
        if part.strip(" "):
            if not _FRAGMENT.match(part):
                raise ValueError(f"attribute fragment without a key and '=': {part}")
            key, _, values = part.partition("=")
            out.setdefault(_decoded(key.strip(" ")), []).extend(map(_decoded, values.split(",")))
    return out


def _feature(line: str) -> tuple:
    """``seqid, source, type, lo, hi, score, strand, phase, attributes`` of a line that is sound."""
    c = line.removesuffix("\r").split("\t")
    wrong = lambda message: ValueError(f"{message}: {line}")
    if len(c) != 9:
        raise wrong("not nine columns")
    lo, hi, score, phase = (c[i].strip(" ") for i in (3, 4, 5, 7))
    if not (_PLACE.fullmatch(lo) and _PLACE.fullmatch(hi)):
        raise wrong("coordinates are whole numbers from 1")
    if int(lo) > int(hi):
        raise wrong("start after end")
    if c[6] not in ("+", "-", ".", "?"):
        raise wrong("unknown strand")
    number = None if score == "." else _NUMBER.fullmatch(score)
    if score != "." and not number:
        raise wrong("score is neither . nor a number")
    if phase not in (".", "0", "1", "2"):
        raise wrong("phase is neither . nor 0, 1, 2")
    if c[2] == "CDS" and phase == ".":
        raise wrong("a CDS needs a phase")
    return _decoded(c[0]), _decoded(c[1]), c[2], int(lo), int(hi), float(number[1] or score) if number else None, {"-": -1, "+": 1}.get(c[6], 0), None if phase == "." else int(phase), _attributes(c[8])


def gff3_features(lines: DataFrame, inside: Column | None = None) -> DataFrame:
    """Features of lines ``file, line_no, line`` of GFF3 (S07), those ``inside`` the body if
    that is given; the rest is not looked at. Blank and comment lines go. A line is refused unless it has nine columns, whole coordinates from 1 on
    with start before end, a strand of ``+ - . ?``, a score that is a number or ``.``, and
    a phase of 0 to 2, which only features other than CDS may leave open. ``seqid`` and
    ``source`` are decoded, attributes as ``gff3_attributes`` reads them; a strand that is
    not known is 0. Lines are read in Arrow batches: expressions on arrays inside arrays are interpreted and
    take a hundred times as long for each line."""
    inside = F.lit(True) if inside is None else inside
    # One expression, so that no line is looked at before it is known to be inside.
    kept = lines.where(F.when(inside, (F.trim(F.regexp_replace("line", "\r$", "")) != "") & ~F.startswith("line", F.lit("#"))).otherwise(False)).select("file", "line_no", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *cols, maps = zip(*map(_feature, batch.column(2).to_pylist()), strict=True) if len(batch) else ((),) * 9
            values = [v for m in maps for v in m.values()]
            ends = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends([len(v) for v in values]), pa.array([x for v in values for x in v], pa.string()))
            attributes = pa.MapArray.from_arrays(ends([len(m) for m in maps]), pa.array([k for m in maps for k in m], pa.string()), lists)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, t) for x, t in zip(cols, _FEATURE_TYPES, strict=True)), attributes], names)

    fields = "seqid string, source string, type string, lo long, hi long, score double, strand int, phase int, attributes map<string, array<string>>"
    schema = T.StructType([*kept.schema.fields[:2], *T.StructType.fromDDL(fields).fields])
    names = schema.names
    return kept.mapInArrow(run, schema)


_FEATURE_TYPES = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())


def _declared(line: Column) -> Column:
    """Whether a line is the directive that GFF3 files begin with."""
    return line.rlike(r"^\s*##gff-version\s+3(\.\S*)?\s*$")


def parse_gff3(files: DataFrame, file: str = "file", content: str = "content", *, strict: bool = False) -> DataFrame:
    """Features of whole GFF3 files held in cells (S07), as ``gff3_features`` checks them:
    the body ends at ``##FASTA`` or at a bare ``>``; if ``strict``, the first line declares
    version 3."""
    text = F.col(content)
    if strict:
        text = F.when(_declared(F.split(text, "\r\n|\n|\r", 2)[0]), text).otherwise(F.raise_error(F.concat(F.lit("no ##gff-version 3 in the first line of "), F.col(file))).cast("string"))
    body = F.split(text, r"(?m)^(##FASTA|>)", 2)[0]
    return gff3_features(files.select(F.col(file).alias("file"), F.posexplode(F.split(body, "\r\n|\n|\r")).alias("line_no", "line")))


#: Bytes of a file that is read as one cell.
WHOLE_BYTES = 16_000_000


def read_gff3(spark: SparkSession, path: str) -> DataFrame:
    """Features of GFF3 files of any size (S07); each must begin with ``##gff-version 3``.
    Files of up to ``WHOLE_BYTES`` are read whole, once; larger ones as lines, by as many tasks
    as Spark splits them into. ``line_no`` ascends along a file but is not dense. A file
    without any line can't be seen and has no features."""
    own, size = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size")
    cells = spark.read.text(path, wholetext=True).where(size <= WHOLE_BYTES).select(own, F.col("value").alias("content")).where("content <> ''")
    found = parse_gff3(cells, strict=True)
    if spark.read.text(path).where(size > WHOLE_BYTES).isEmpty():  # such files aren't opened to tell
        return found
    lines = numbered_lines(spark, path, size > WHOLE_BYTES)
    ends = cut(lines.where(F.startswith("line", F.lit("##FASTA")) | F.startswith("line", F.lit(">"))).groupBy("file").agg(F.min("line_no").alias("_end")))
    beside = F.broadcast(ends) if ends.count() <= MAX_BROADCAST else ends.hint("merge")
    declared = F.when((F.col("line_no") > 0) | _declared(F.col("line")), True).otherwise(F.raise_error(F.concat(F.lit("no ##gff-version 3 in the first line of "), F.col("file"))).cast("boolean"))
    return found.unionByName(gff3_features(lines.join(beside, "file", "left"), declared & (F.col("_end").isNull() | (F.col("line_no") < F.col("_end")))))


def _require(ok: Column, message: str, text: Column) -> Column:
    return F.when(ok, text).otherwise(F.raise_error(F.concat(F.lit(message), text)).cast("string"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used: inside
    functions on arrays nothing else keeps a repeated expression from being repeated."""
    return F.transform(F.array(value), use)[0]


def percent_decoded(text: Column) -> Column:
    """``%XX`` decoded, everything else as it is; a ``%`` without two hexadecimal
    digits and bytes that aren't UTF-8 are errors."""
    # The decoder puts U+FFFD where bytes are not UTF-8.
    mark = F.lit(chr(0xFFFD))

    def decoded(t: Column) -> Column:
        sound = _require(~t.rlike("%(?![0-9A-Fa-f]{2})"), "malformed percent-escape: ", t)
        ok = lambda d: ~F.contains(d, mark) | F.contains(t, mark) | F.contains(F.upper(t), F.lit("%EF%BF%BD"))
        return bound(F.url_decode(F.replace(sound, F.lit("+"), F.lit("%2B"))), lambda d: F.when(ok(d), d).otherwise(F.raise_error(F.concat(F.lit("escaped bytes that are not UTF-8: "), t)).cast("string")))

    return bound(text, lambda t: F.when(F.contains(t, F.lit("%")), decoded(t)).otherwise(t))


def merged_map(entries: Column) -> Column:
    """A map from an array of ``(key, values)``: the values of a key that comes more
    than once are joined in order."""
    values = lambda es, k: F.flatten(F.transform(F.filter(es, lambda e: e["key"] == k), lambda e: e["value"]))
    return bound(entries, lambda es: bound(F.array_distinct(F.transform(es, lambda e: e["key"])), lambda keys: F.map_from_arrays(keys, F.transform(keys, lambda k: values(es, k)))))


def gff3_attributes(column: Column) -> Column:
    """Column nine as a map of keys to values: fragments are split at ``;``, then at
    the first ``=``, values at ``,``, and each part is decoded after that. Values of
    a repeated key are joined in order; ``.`` and an empty column are an empty map; a
    fragment without ``=`` or with an empty key is an error."""
    parts = bound(F.trim(column), lambda t: F.filter(F.split(F.when(t == ".", "").otherwise(t), ";"), lambda a: F.trim(a) != ""))
    checked = F.transform(parts, lambda a: _require(a.rlike(r"^\s*[^=\s][^=]*="), "attribute fragment without a key and '=': ", a))
    key = lambda a: percent_decoded(F.trim(F.substring_index(a, "=", 1)))
    values = lambda a: F.transform(F.split(F.substr(a, F.call_function("instr", a, F.lit("=")) + 1), ","), percent_decoded)
    return merged_map(F.transform(checked, lambda a: F.struct(key(a).alias("key"), values(a).alias("value"))))


def group_cds(features: DataFrame) -> DataFrame:
    """Rows of one declared ``ID`` as one feature with its segments and the attributes
    of all its rows, both in file order (S08); a row without an ID stands alone, its
    ``cds_id`` being ``row:`` and its line; an ID on two sequences or strands is an error."""
    declared = F.nullif(F.trim(F.get(F.col("attributes")["ID"], F.lit(0))), F.lit(""))
    own = F.when(declared.isNull(), F.col("line_no"))
    rows = F.sort_array(F.collect_list(F.struct("line_no", "lo", "hi", "attributes_")))
    g = features.where("type = 'CDS'").withColumn("attributes_", F.map_entries("attributes")).groupBy("file", declared.alias("_id"), own.alias("_row")).agg(
        F.min("seqid").alias("seqid"), F.min("strand").alias("strand"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), rows.alias("_rows"),
        (F.count_distinct("seqid") + F.count_distinct("strand")).alias("_k"),
    )
    sound = g.where(F.when(F.col("_k") == 2, True).otherwise(F.raise_error(F.lit("one ID on two sequences or strands")).cast("boolean")))
    return sound.select(
        "file", F.coalesce("_id", F.concat(F.lit("row:"), F.col("_row").cast("string"))).alias("cds_id"), F.col("_id").isNotNull().alias("declared"), "seqid", "strand", "lo", "hi",
        F.transform("_rows", lambda r: F.struct(r["lo"].alias("lo"), r["hi"].alias("hi"))).alias("segments"), merged_map(F.flatten(F.transform("_rows", lambda r: r["attributes_"]))).alias("attributes"),
    )


def parse_tblout(lines: DataFrame, value: str = "value") -> DataFrame:
    """Hits of a search table (S09): ``#`` lines go, ends are ordered, strand as given."""
    c = F.split(F.trim(F.col(value)), r"\s+")
    rows = lines.where(~F.startswith(F.col(value), F.lit("#")) & (F.trim(F.col(value)) != ""))
    a, b = c[7].cast("long"), c[8].cast("long")
    return rows.select(c[0].alias("target"), c[2].alias("query"), F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), F.when(c[9] == "-", -1).otherwise(1).alias("strand"), c[14].cast("double").alias("score"), c[15].cast("double").alias("evalue"))


def parse_blast(lines: DataFrame, value: str = "value") -> DataFrame:
    """``outfmt 6`` hits; the minus strand has its subject start after its end."""
    c = F.split(F.col(value), "\t")
    a, b = c[8].cast("long"), c[9].cast("long")
    return lines.where(~F.startswith(F.col(value), F.lit("#"))).select(c[0].alias("query"), c[1].alias("subject"), c[2].cast("double").alias("identity"), F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), F.when(a > b, -1).otherwise(1).alias("strand"), c[10].cast("double").alias("evalue"))


def parse_helixcov(files: DataFrame, file: str = "file", content: str = "content") -> DataFrame:
    """Declared and parsed helices per file, the sums of their pairs, and whether
    the file holds together (S10)."""
    rows = files.select(F.col(file).alias("file"), F.regexp_extract(content, r"# RMs = (\d+)", 1).cast("long").alias("declared"), F.explode(F.split(content, "\n")).alias("line"))
    hit = r"^\s*\d+-\d+\s+\d+-\d+,\s*nbp = (\d+)\s+nbp_cov = (\d+)"
    is_row = F.col("line").rlike(hit)
    n, k = (F.when(is_row, F.regexp_extract("line", hit, i).cast("long")) for i in (1, 2))
    g = rows.groupBy("file", "declared").agg(F.count_if(is_row).alias("parsed"), F.sum(n).alias("nbp"), F.sum(k).alias("nbp_cov"), F.coalesce(F.bool_and(k <= n), F.lit(True)).alias("_fit"))
    return g.withColumn("ok", (F.col("declared") == F.col("parsed")) & F.col("_fit")).drop("_fit")


def _stockholm(lines: DataFrame) -> DataFrame:
    kept = lines.where("line <> '' AND line <> '//' AND (NOT startswith(line, '#') OR startswith(line, '#=GC SS_cons'))")
    name = F.when(F.startswith("line", F.lit("#=GC")), "#=GC SS_cons").otherwise(F.regexp_extract("line", r"^(\S+)", 1))
    # What stands behind the name, which may be nothing.
    chunk = F.regexp_extract(F.regexp_replace("line", r"^(#=GC\s+\S+|\S+)", ""), r"(\S+)\s*$", 1)
    joined = kept.select("file", name.alias("row_name"), "p", chunk.alias("c")).groupBy("file", "row_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "c"))), lambda x: x["c"]), "").alias("aligned"))
    widths = joined.groupBy("file").agg((F.min(F.length("aligned")) == F.max(F.length("aligned"))).alias("_same"))
    return joined.join(widths, "file").where(F.when(F.col("_same"), True).otherwise(F.raise_error(F.concat(F.lit("rows of different width in "), F.col("file").cast("string"))).cast("boolean"))).drop("_same")


def parse_stockholm(files: DataFrame, file: str = "file", content: str = "content") -> DataFrame:
    """``file, row_name, aligned``: interleaved blocks joined per row, the
    consensus structure under ``#=GC SS_cons`` (S11). Rows of one file that differ in
    width are an error; a row may have no letters. A file is
    read where its cell lies, by expressions: nothing is shuffled or sent to Python."""
    kept = lambda line: (line != "") & (line != "//") & (~F.startswith(line, F.lit("#")) | F.startswith(line, F.lit("#=GC SS_cons")))

    def piece(line: Column, words: Column) -> Column:
        note = F.startswith(line, F.lit("#"))
        named = F.when(note, 2).when(F.get(words, F.lit(0)) == "", 0).otherwise(1)
        words = F.filter(words, lambda w: w != "")
        name = F.when(note, "#=GC SS_cons").when(named == 1, F.get(words, F.lit(0))).otherwise("")
        return F.struct(name.alias("name"), F.when(F.size(words) > named, F.element_at(words, -1)).otherwise("").alias("c"))

    def rows(pieces: Column) -> Column:
        own = lambda k: F.array_join(F.transform(F.filter(pieces, lambda p: p["name"] == k), lambda p: p["c"]), "")
        return F.transform(F.array_distinct(F.transform(pieces, lambda p: p["name"])), lambda k: F.struct(k.alias("row_name"), own(k).alias("aligned")))

    lines = F.filter(F.split("_c", "\r\n|\n|\r"), kept)
    pieces = F.transform(lines, lambda line: bound(F.split(line, r"\s+"), lambda words: piece(line, words)))
    wrong = F.raise_error(F.concat(F.lit("rows of different width in "), F.col("_f").cast("string"))).cast("array<struct<row_name:string,aligned:string>>")
    sound = lambda found: F.when(F.size(F.array_distinct(F.transform(found, lambda r: F.length(r["aligned"])))) > 1, wrong).otherwise(found)
    found = bound(bound(pieces, rows), sound)
    cells = files.select(F.col(file).alias("_f"), F.col(content).alias("_c"))
    return cells.select("_f", F.explode(found).alias("_r")).select(F.col("_f").alias("file"), "_r.*")


def read_stockholm(spark: SparkSession, path: str) -> DataFrame:
    """``parse_stockholm`` of files of any size, read as lines by as many tasks as Spark
    splits them into; only the pieces of one row meet in one place (S11)."""
    return _stockholm(numbered_lines(spark, path).select("file", F.col("line_no").alias("p"), "line"))


def alignment_depth(rows: DataFrame) -> DataFrame:
    """``file, n_rows, width, mean_depth``: sequences of each alignment, its columns, and
    the mean number of sequences with a residue in a column (S11)."""
    seqs = rows.where("NOT startswith(row_name, '#')")
    residues = F.length(F.regexp_replace("aligned", r"[.\-~_]", ""))
    g = seqs.groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.length("aligned")).cast("long").alias("width"), F.sum(residues).alias("_n"))
    return g.select("file", "n_rows", "width", F.try_divide("_n", "width").alias("mean_depth"))


_BLANK = r"[ \t\x0b\f\r]"
_CT_LINE = re.compile(rf"^ *([+-]?[0-9]+)(?:{_BLANK}+[^ \t\x0b\f\r\n]+){{3}}{_BLANK}+([+-]?[0-9]+)(?:{_BLANK}[^\n]*)?$", re.MULTILINE)


def parse_ct(files: DataFrame, file: str = "file", content: str = "content") -> DataFrame:
    """Base pairs ``(i, j)`` of connect tables, header line first, and whether the file has
    ``(j, i)`` too (S12). A file is read where its cell lies: nothing is shuffled, and the
    cell is worked out once. A line without its numbers is an error."""
    cells = files.select(F.col(file).alias("file"), F.col(file).cast("string").alias("_f"), F.col(content).alias("_c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (name, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                body = (text or "").partition("\n")[2]
                found = _CT_LINE.findall(body)
                if len(found) != sum(1 for line in body.split("\n") if line.strip(" ")):
                    raise ValueError(f"a line of {name} is not one of a connect table")
                i, j = (np.array([int(x[c]) for x in found], np.int64) for c in (0, 1))
                i, j = i[j > 0], j[j > 0]
                if len(i):
                    mirrored = np.isin((i << 32) + j, (j << 32) + i)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(i), k))), pa.array(i).cast(pa.int32()), pa.array(j).cast(pa.int32()), pa.array(mirrored)], names=["file", "i", "j", "mirrored"])

    fields = (("i", T.IntegerType()), ("j", T.IntegerType()), ("mirrored", T.BooleanType()))
    return cells.mapInArrow(run, T.StructType([cells.schema["file"], *(T.StructField(*f) for f in fields)]))


def last_log_rows(lines: DataFrame, schema: str, *, key: str, seq: str, value: str = "value") -> DataFrame:
    """Last row per key of a JSON-lines log; lines that don't parse are dropped."""
    rows = lines.select(F.from_json(value, schema, {"mode": "PERMISSIVE"}).alias("r")).select("r.*").where(F.col(key).isNotNull() & F.col(seq).isNotNull())
    w = Window.partitionBy(key).orderBy(F.desc(seq))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def work_decision(wanted: DataFrame, last: DataFrame, *, key: str, status: str, done: str, retry: list[str]) -> DataFrame:
    """What a resumed run does with each wanted key, from the last log row of each
    (S13): ``reuse`` where it is done, ``retry`` where the status allows another try,
    ``run`` without a row, else ``give_up``."""
    s = F.col(status)
    say = F.when(s.isNull(), "run").when(s == done, "reuse").when(s.isin(*retry), "retry").otherwise("give_up")
    return wanted.select(key).distinct().join(last.select(key, status), key, "left").select(key, say.alias("decision"))


def parse_manifest(lines: DataFrame, value: str = "value") -> DataFrame:
    """``digest, file`` of checksum lines."""
    pattern = r"^([0-9a-f]{32})\s+\*?(?:\./)?(.+)$"
    return lines.where(F.col(value).rlike(pattern)).select(F.regexp_extract(value, pattern, 1).alias("digest"), F.regexp_extract(value, pattern, 2).alias("file"))


def classify_assemblies(manifest: DataFrame, wanted: DataFrame, assembly: str) -> DataFrame:
    """Annotated, unannotated or unknown, by the files a manifest lists."""
    own = manifest.select(F.split_part("file", F.lit("/"), F.lit(1)).alias(assembly), F.endswith("file", F.lit(".gff")).alias("_g")).groupBy(assembly).agg(F.bool_or("_g").alias("_g"))
    return wanted.join(own, assembly, "left").withColumn("supply", F.when(F.col("_g").isNull(), "unknown").when(F.col("_g"), "annotated").otherwise("unannotated")).drop("_g")


def keep_wanted(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of wanted keys; the planner broadcasts the keys if their size allows."""
    return rows.join(wanted.select(key).distinct(), key, "left_semi")
