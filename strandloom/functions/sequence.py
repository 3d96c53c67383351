"""Column functions on sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.functions.loci import col, hash_draw

IUPAC = "ACGTURYSWKMBDHVN"
COMPLEMENT = ("ACGTURYKMBDHVacgturykmbdhv", "TGCAAYRMKVHDBtgcaayrmkvhdb")
DNA_TOKENS = {"A": 0, "C": 1, "G": 2, "T": 3, "N": 4}


def reverse_complement(seq: str | Column) -> Column:
    """Case is kept; letters without a partner stay."""
    return F.reverse(F.translate(col(seq), *COMPLEMENT))


def to_rna(seq: str | Column, strand: str | Column | None = None) -> Column:
    """RNA of a strand, the minus one reverse-complemented."""
    s = col(seq) if strand is None else F.when(col(strand) < 0, reverse_complement(seq)).otherwise(col(seq))
    return F.translate(s, "Tt", "Uu")


def degap_to_dna(aligned: str | Column) -> Column:
    """Upper-case DNA of an aligned RNA row."""
    return F.translate(F.upper(F.regexp_replace(col(aligned), r"[-.~]", "")), "U", "T")


def safe_name(name: str | Column) -> Column:
    return F.regexp_replace(col(name), r"[^A-Za-z0-9_.]", "_")


def outside_alphabet(seq: str | Column, alphabet: str = "ACGT") -> Column:
    """Letters outside the alphabet."""
    return F.length(F.regexp_replace(col(seq), f"[{alphabet}]", ""))


def gc_fraction(seq: str | Column) -> Column:
    """Null for an empty sequence."""
    return F.try_divide(F.length(F.regexp_replace(F.upper(col(seq)), "[^GC]", "")), F.length(col(seq)))


def windows(seq: str | Column, width: int, step: int) -> Column:
    """Stretches of up to ``width`` letters from every ``step``-th letter, in one pass over
    the sequence (``substr`` would count from the start for each of them)."""
    return F.regexp_extract_all(col(seq), F.lit(f"(?s)(?=(.{{1,{width}}})).{{1,{step}}}"), F.lit(1))


def kmers(seq: str | Column, k: int) -> Column:
    """All windows of ``k`` letters, in one pass; none if shorter."""
    return F.regexp_extract_all(col(seq), F.lit(f"(?s)(?=(.{{{k}}}))."), F.lit(1))


def encode(seq: str | Column, vocabulary: dict[str, int], unknown: int) -> Column:
    """Token ids, one a letter."""
    m = F.create_map(*[x for k, v in vocabulary.items() for x in (F.lit(k), F.lit(v))])
    return F.transform(F.filter(F.split(col(seq), ""), lambda c: c != ""), lambda c: F.coalesce(m[c], F.lit(unknown)))


def window_starts(length: str | Column, window: int, stride: int) -> Column:
    """Starts at the stride, the last anchored to the end, ``[0]`` if short."""
    n = col(length)
    last = F.greatest(n - window, F.lit(0))
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))


def n_windows(length: str | Column, window: int, stride: int) -> Column:
    n = col(length)
    return F.when(n <= window, 1).otherwise(F.ceil((n - window) / stride) + 1).cast("long")


def carve(seq: str | Column, lead: str | Column, window: int, pad: str = "N") -> Column:
    """``window`` letters from ``lead`` (may be negative), padded outside."""
    s, a = col(seq), col(lead)
    left = F.least(F.greatest(-a, F.lit(0)), F.lit(window))
    body = F.substr(s, F.greatest(a, F.lit(0)) + 1, F.lit(window) - left)
    return F.rpad(F.concat(F.repeat(F.lit(pad), left), body), window, pad)


def lead_range(offset: Column, length: Column, region: Column, window: int) -> tuple[Column, Column]:
    """Leads that keep the whole locus inside the window and the window inside
    the region where it can (E07)."""
    lo = F.greatest(offset + length - window, F.least(F.lit(0), region - window))
    return F.least(lo, offset), F.greatest(F.least(offset, F.greatest(region - window, F.lit(0))), F.least(lo, offset))


def drawn_lead(lo: Column, hi: Column, *key: str | Column) -> Column:
    return lo + hash_draw(*key) % (hi - lo + 1)


def anchor(locus: Column, region: Column) -> tuple[Column, Column]:
    """Status and 0-based offset of a locus by exact search in its region;
    overlapping second hits count as ambiguous (F08)."""
    first = F.call_function("locate", locus, region)
    second = F.call_function("locate", locus, region, first + 1)
    status = (
        F.when(locus.isNull() | (locus == ""), "no_locus").when(region.isNull() | (region == ""), "no_region")
        .when(first == 0, "absent").when(second > 0, "ambiguous").otherwise("anchored")
    )
    return status, F.when(status == "anchored", first - 1)


def paint(length: Column, layers: list[tuple[str, Column, Column]], background: str = ".") -> Column:
    """Label string of 1-based closed extents; later layers overwrite.
    Extents are clamped to the length, empty ones paint nothing."""
    out = F.repeat(F.lit(background), length)
    for letter, lo, hi in layers:
        a, b = F.greatest(lo, F.lit(1)), F.least(hi, length)
        size = (b - a + 1).cast("int")
        out = F.when(size > 0, F.overlay(out, F.repeat(F.lit(letter), size), a.cast("int"), size)).otherwise(out)
    return out


def splice(host: Column, insert: Column, phase: Column) -> Column:
    """Host with ``insert`` over its letters from 0-based ``phase``; length kept."""
    return F.concat(F.substr(host, F.lit(1), phase), insert, F.substr(host, phase + F.length(insert) + 1))


def ablate(seq: Column, lo: Column, hi: Column) -> Column:
    """Sequence without 1-based closed ``lo..hi``."""
    return F.concat(F.substr(seq, F.lit(1), lo - 1), F.substr(seq, hi + 1))
