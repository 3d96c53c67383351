"""Operators on base-pair structures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _letters(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def _bracket_pairs(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places from 1 of the pairs of one bracket string."""
    letters = _letters(text)
    at = np.flatnonzero((letters == ord("(")) | (letters == ord(")")))
    opens = letters[at] == ord("(")
    run = np.cumsum(np.where(opens, 1, -1))
    depth = np.where(opens, run, run + 1)
    order = np.argsort(depth, kind="stable")
    a, b = order[:-1], order[1:]
    met = opens[a] & ~opens[b] & (depth[a] == depth[b]) & (depth[a] > 0)
    return at[a[met]] + 1, at[b[met]] + 1


#: Rows of texts that are worked on at once inside a batch.
PIECE = 256


def pair_table(df: DataFrame, *, id_col: str, structure: str) -> DataFrame:
    """Pairs ``(i, j)`` of a bracket string, 1-based (E18): brackets of one depth
    alternate, so an opening one pairs with the next bracket of its depth. What
    isn't balanced pairs with nothing. A string is read where it lies: nothing is
    shuffled. Ids are unique."""
    rows = df.where(F.col(structure).isNotNull()).select(id_col, structure)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, PIECE):
                part = batch.slice(lo, PIECE)
                found = [_bracket_pairs(s) for s in part.column(1).to_pylist()]
                who = np.repeat(np.arange(len(found)), [len(i) for i, _ in found])
                i, j = (np.concatenate([f[k] for f in found]).astype(np.int32) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(who)), pa.array(i), pa.array(j)], [id_col, "i", "j"])

    return rows.mapInArrow(run, T.StructType([rows.schema[id_col], T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())]))


def project_row_pairs(df: DataFrame, *, id_col: str, aligned: str, pairs: str, gap: str = "-") -> DataFrame:
    """``id, i, j, kept`` of an aligned row and its ``pairs``, an array of ``(i, j)`` in the
    same row (E19): ``project_pairs`` without a shuffle. A null row or array gives nothing."""
    rows = df.where(F.col(aligned).isNotNull() & F.col(pairs).isNotNull()).select(id_col, aligned, F.transform(pairs, lambda p: F.coalesce(p["i"].cast("int"), F.lit(0))).alias("_i"), F.transform(pairs, lambda p: F.coalesce(p["j"].cast("int"), F.lit(0))).alias("_j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, PIECE):
                part = batch.slice(lo, PIECE)
                solid = [_letters(s) != ord(gap) for s in part.column(1).to_pylist()]
                width = np.array([len(s) for s in solid])
                first, every = np.cumsum(width) - width, np.concatenate([np.zeros(0, bool), *solid])
                count = np.cumsum(every)
                before = np.concatenate([[0], count])[first]
                n = np.diff(part.column(2).offsets.to_numpy())
                who = np.repeat(np.arange(len(n)), n)
                ends = []
                for k in (2, 3):
                    c = part.column(k).flatten().to_numpy()
                    inside = (c >= 1) & (c <= width[who])
                    at = np.where(inside, first[who] + c - 1, 0)
                    place = count[at] - before[who] if len(count) else np.zeros(len(c), int)
                    ends.append((pa.array(place.astype(np.int32), mask=~inside), inside & (every[at] if len(every) else False)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(who)), ends[0][0], ends[1][0], pa.array(ends[0][1] & ends[1][1])], [id_col, "i", "j", "kept"])

    fields = [rows.schema[id_col], T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("kept", T.BooleanType())]
    return rows.mapInArrow(run, T.StructType(fields))


def project_pairs(rows: DataFrame, pairs: DataFrame, *, id_col: str, aligned: str = "aligned", gap: str = "-") -> DataFrame:
    """Pairs of alignment columns as positions of the ungapped row; a pair with a
    gap at either end or an end outside the row is not kept (E19). Columns are counted once
    a row, for all pairs of its id together. Ids of rows are unique."""
    of = pairs.groupBy(id_col).agg(F.collect_list(F.struct("i", "j")).alias("_pairs"))
    return project_row_pairs(rows.select(id_col, aligned).join(of, id_col), id_col=id_col, aligned=aligned, pairs="_pairs", gap=gap)


def helices(pairs: DataFrame, *, id_col: str, minimum: int) -> DataFrame:
    """Maximal stacks of at least ``minimum`` pairs: islands of ``i`` where
    ``i + j`` stays (E20)."""
    w = Window.partitionBy(id_col, "_s").orderBy("i")
    g = pairs.withColumn("_s", F.col("i") + F.col("j")).withColumn("_g", F.col("i") - F.row_number().over(w))
    out = g.groupBy(id_col, "_s", "_g").agg(F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1"), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") >= minimum).drop("_s", "_g")


def bulges(pairs: DataFrame, lengths: DataFrame, *, id_col: str) -> DataFrame:
    """Unpaired runs on the 5' side between two pairs of one stem."""
    w = Window.partitionBy(id_col).orderBy("i")
    nxt = pairs.withColumn("i2", F.lead("i").over(w)).withColumn("j2", F.lead("j").over(w)).join(lengths.select(id_col), id_col, "left_semi")
    return nxt.where("i2 > i + 1 AND j2 < j").select(id_col, (F.col("i") + 1).alias("start"), (F.col("i2") - 1).alias("end"))


def relaxed(pairs: DataFrame) -> DataFrame:
    """Each pair with those one step away at one end."""
    moves = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])
    return pairs.withColumn("_m", F.explode(moves)).withColumn("i", F.col("i") + F.col("_m.a")).withColumn("j", F.col("j") + F.col("_m.b")).drop("_m").distinct()


def pair_prf(truth: DataFrame, predicted: DataFrame, *, id_col: str) -> DataFrame:
    """Precision and recall per record with one letter of slippage."""
    keys = [id_col, "i", "j"]
    n = lambda df, name: df.groupBy(id_col).agg(F.count(F.lit(1)).alias(name))
    tp = n(predicted.join(relaxed(truth), keys, "left_semi"), "_tp")
    rt = n(truth.join(relaxed(predicted), keys, "left_semi"), "_rt")
    out = n(truth, "_t").join(n(predicted, "_p"), id_col, "left").join(tp, id_col, "left").join(rt, id_col, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    p, r = F.try_divide(zero("_tp"), "_p"), F.try_divide(zero("_rt"), "_t")
    return out.select(id_col, p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


def pairs_symmetric(pairs: DataFrame, *, id_col: str) -> DataFrame:
    """Rows ``(i, j)`` without their mirror ``(j, i)``."""
    mirror = pairs.select(id_col, F.col("j").alias("i"), F.col("i").alias("j"))
    return pairs.join(mirror, [id_col, "i", "j"], "left_anti")


# Watson-Crick partners, and the bases that a wobble pair adds to each.
PARTNERS = {"A": "U", "U": "A", "G": "C", "C": "G"}
WOBBLE = {"G": "U", "U": "G"}


def pairing_pattern(acceptor: str, n_pairs: int, *, wobble: bool = False) -> str:
    """Regular expression of ``n_pairs`` residues in a row, 5' to 3', that pair with
    the acceptor end in any register; ``N`` pairs with all, a register of ``N`` alone
    doesn't count. With ``wobble`` G pairs with U as well."""
    ends = acceptor.upper().replace("T", "U")[::-1]
    if not 1 <= n_pairs <= len(ends) or set(ends) - {*PARTNERS, "N"}:
        raise ValueError("n_pairs residues must pair with an acceptor of A, C, G, U and N")

    def letter(acc: str) -> str:
        return "[ACGU]" if acc == "N" else f"[{PARTNERS[acc]}{WOBBLE.get(acc, '') if wobble else ''}]"

    registers = [ends[i : i + n_pairs] for i in range(len(ends) - n_pairs + 1)]
    registers = [r for r in registers if set(r) != {"N"}]
    if not registers:
        raise ValueError("every register is all wildcards")
    return "|".join("".join(map(letter, r)) for r in registers)


def bulge_motif(bulges: DataFrame, *, id_col: str, residues: str, sizes: tuple[int, int], n_pairs: int, acceptor: str = "NCCA", wobble: bool = False) -> DataFrame:
    """``id, n_bulges, status`` from one row per bulge (E21): ``detected`` if a bulge of
    admissible size holds residues that pair with the acceptor end, ``absent`` if none
    does, ``undetectable`` without a bulge of that size. T counts as U."""
    if not n_pairs <= sizes[0] <= sizes[1]:
        raise ValueError("the smallest bulge must hold the pairs")
    own = F.translate(F.upper(residues), "T", "U")
    sized = F.length(residues).between(*sizes)
    g = bulges.groupBy(id_col).agg(F.count_if(sized).alias("n_bulges"), F.count_if(sized & own.rlike(pairing_pattern(acceptor, n_pairs, wobble=wobble))).alias("_hits"))
    return g.select(id_col, "n_bulges", F.when(F.col("n_bulges") == 0, "undetectable").when(F.col("_hits") > 0, "detected").otherwise("absent").alias("status"))
