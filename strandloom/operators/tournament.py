"""Pairwise element statistics, grid decisions and alignment columns."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INSERT = re.compile("[.a-z]")


def element_overlaps(df: DataFrame, *, record: str, element: str) -> DataFrame:
    """Per pair of elements: records with both, overlaps, containments and the
    median of the inclusive intersection (A16). A record has few elements, so
    the self-join is linear in records."""
    a = df.select(record, F.col(element).alias("e1"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
    b = df.select(record, F.col(element).alias("e2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    j = a.join(b, record).where("e1 < e2")
    inter = F.greatest(F.lit(0), F.least("hi1", "hi2") - F.greatest("lo1", "lo2") + 1)
    return j.groupBy("e1", "e2").agg(F.count(F.lit(1)).alias("both"), F.expr("count_if(lo1 <= hi2 AND lo2 <= hi1)").alias("overlapping"), F.expr("count_if(lo2 >= lo1 AND hi2 <= hi1)").alias("contained"), F.median(inter).alias("median_len"))


def copeland(df: DataFrame, *, record: str, element: str, start: str) -> DataFrame:
    """Elements by pairwise wins: an element beats another if it comes first in
    a strict majority of the records that have both (A17)."""
    a = df.select(record, F.col(element).alias("e1"), F.col(start).alias("s1"))
    b = df.select(record, F.col(element).alias("e2"), F.col(start).alias("s2"))
    p = a.join(b, record).where("e1 <> e2").groupBy("e1", "e2").agg(F.count(F.lit(1)).alias("n"), F.expr("count_if(s1 < s2)").alias("first"))
    return p.groupBy(F.col("e1").alias(element)).agg(F.count_if(2 * F.col("first") > F.col("n")).alias("wins"))


def decide_grid(grid: DataFrame, *, floor: int) -> DataFrame:
    """Admissibility by a floor, the undominated frontier, and the place in the
    order admissible, cheap, high yield, parameters (K05). A grid is small: its
    size is that of the parameter table."""
    g = grid.withColumn("admissible", F.col("yield") >= floor)
    # Undominated: nobody cheaper yields as much, nobody as cheap yields more.
    cheaper = Window.partitionBy().orderBy("cost").rangeBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("_c", F.max("yield").over(cheaper)).withColumn("_s", F.max("yield").over(Window.partitionBy("cost")))
    frontier = (F.col("_c").isNull() | (F.col("_c") < F.col("yield"))) & (F.col("_s") == F.col("yield"))
    place = F.row_number().over(Window.partitionBy().orderBy(F.desc("admissible"), "cost", F.desc("yield"), "t1", "t2")).cast("long")
    return g.withColumn("frontier", frontier).withColumn("place", place).drop("_c", "_s")


def match_columns(rows: DataFrame, *, alignment: str, row: str, aligned: str, alphabet: str = "ACGU") -> DataFrame:
    """``row, codes``: codes of each row at the alignment's match columns: those in which no row
    has an insert, ``.`` or lower case (C02). A shorter row has nothing in its last
    columns; rows without a match column are left out. Each row gives the columns of
    its inserts, of which a batch names each once; letters stay in their row, and a
    row meets its alignment's insert columns, which are at most as many as its
    longest row has letters. Ids of rows are unique."""
    own = rows.select(F.col(alignment).alias("_a"), F.col(aligned).alias("_s"))

    def inserts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            found: dict[int | None, set[int]] = {}
            for k, text in zip(names.indices.to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(k, set()).update(m.start() for m in _INSERT.finditer(text or ""))
            ks = [k for k, at in found.items() if k is not None for _ in at]
            at = [p for k, at in found.items() if k is not None for p in at]
            yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(ks, pa.int32())), pa.array(at, pa.int32())], names=["_a", "_p"])

    places = own.mapInArrow(inserts, T.StructType([own.schema["_a"], T.StructField("_p", T.IntegerType())])).distinct()
    gone = places.groupBy("_a").agg(F.collect_list("_p").alias("_gone"))
    digits = str.maketrans(alphabet, "0123456789"[: len(alphabet)])
    met = rows.select(F.col(row).alias(row), F.col(alignment).alias("_a"), F.col(aligned).alias("_s")).where("_a IS NOT NULL").join(gone, "_a", "left").select(row, "_s", "_gone")

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, text in enumerate(batch.column(1).to_pylist()):
                letters = np.frombuffer((text or "").encode("utf-32-le"), "<u4")
                kept = np.ones(len(letters), bool)
                if batch.column(2)[k].is_valid:
                    at = batch.column(2)[k].values.to_numpy()
                    kept[at[at < len(letters)]] = False
                out.append(letters[kept].tobytes().decode("utf-32-le").translate(digits) if kept.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[row, "codes"])

    return met.mapInArrow(codes, T.StructType([met.schema[row], T.StructField("codes", T.StringType())])).where("codes IS NOT NULL")
