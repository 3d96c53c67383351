"""Column functions on loci, identifiers and loosely typed cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that stand for a missing cell, and for booleans.
NULL_TOKENS = ("", "none", "nan", "na", "<na>", "null", "n/a")
TRUE_TOKENS = ("true", "1", "yes", "t")
FALSE_TOKENS = ("false", "0", "no", "f")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_version(accession: str | Column) -> Column:
    """Accession without a trailing ``.N``."""
    return F.regexp_replace(col(accession), r"\.\d+$", "")


def lower_end(start: str | Column, end: str | Column) -> Column:
    """Smaller end of a locus whose minus strand is written with start > end."""
    return F.least(col(start), col(end))


def upper_end(start: str | Column, end: str | Column) -> Column:
    return F.greatest(col(start), col(end))


def strand_of(start: str | Column, end: str | Column) -> Column:
    return F.when(col(start) > col(end), -1).otherwise(1)


def clean_null(c: str | Column) -> Column:
    """Null for missing cells, stringified ones included; trimmed else."""
    t = F.trim(col(c))
    return F.when(~F.lower(t).isin(*NULL_TOKENS), t)


def tri_state(c: str | Column) -> Column:
    """Boolean of a token, null if missing; any other token is an error."""
    t = F.lower(clean_null(c))
    return (
        F.when(t.isNull(), F.lit(None).cast("boolean")).when(t.isin(*TRUE_TOKENS), True).when(t.isin(*FALSE_TOKENS), False)
        .otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), t)).cast("boolean"))
    )


def sentinel_number(c: str | Column, sentinel: int) -> tuple[Column, Column]:
    """Value with the sentinel as null, and whether the cell is junk."""
    t = F.trim(col(c).cast("string"))
    value = t.try_cast("bigint")
    return F.nullif(value, F.lit(sentinel).cast("bigint")), t.isNotNull() & (t != "") & value.isNull()


def locus_name(name: str | Column) -> dict[str, Column]:
    """Parts of ``[family|]accession[.version]:start-end``; null on no match."""
    pattern = r"^>?(?:([^|>]*)\|)?([^:|]+?)(?:\.(\d+))?:(\d+)-(\d+)$"
    part = lambda i: F.nullif(F.regexp_extract(col(name), pattern, i), F.lit(""))
    a, b = part(4).cast("bigint"), part(5).cast("bigint")
    return {"family": part(1), "acc": part(2), "version": part(3).cast("int"), "lo": F.least(a, b), "hi": F.greatest(a, b), "strand": F.when(a > b, -1).when(a <= b, 1)}


def hash_draw(*parts: str | Column) -> Column:
    """Integer below 16**13 from the MD5 of the parts joined by colons."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def hash_uniform(*parts: str | Column) -> Column:
    """Draw in [0, 1)."""
    return hash_draw(*parts) / F.lit(float(16**13))


def rounded(value: str | Column, digits: int) -> Column:
    """A double rounded as SQL engines on doubles do: scaled, to the nearest whole number,
    scaled back. ``F.round`` rounds the shortest decimal of the value instead, which is
    another number where a tie can't be written as a double."""
    scale = F.lit(10.0**digits)
    return F.round(col(value) * scale) / scale


def row_hash(cells: list[Column]) -> Column:
    """SHA-256 of length-framed, kind-tagged cells (E01). Null is ``n;``; every
    other cell is ``<kind><length>:<text>;`` with kind ``s`` for strings, ``b`` for
    booleans, ``i`` for integers of any width, ``f`` for floating-point numbers and
    ``S<type>`` for the rest, so the integer 1 and the string '1' differ."""
    def kind(c: Column) -> Column:
        t = F.typeof(c)
        return (
            F.when(t == "string", "s").when(t == "boolean", "b").when(t.isin("tinyint", "smallint", "int", "bigint"), "i")
            .when(t.isin("float", "double"), "f").otherwise(F.concat(F.lit("S"), t))
        )

    framed = [F.when(c.isNull(), F.lit("n;")).otherwise(F.concat(kind(c), F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"), F.lit(";"))) for c in cells]
    return F.sha2(F.concat(*framed), 256)
