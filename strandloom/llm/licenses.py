"""License scan with a positional rare-token index (DataFrame functions only).

Every template has a mandatory key phrase. The key phrase's two words of highest
IDF over the scanned corpus are its postings ``(word, offset)``. A file's licence
words are looked up in the postings, each occurrence implies a start of the
phrase, the starts implied by both words are intersected, and the phrase is then
verified word by word. Whole-notice templates also need a share of their other
words at the same relative positions.

Postings are fixed per template and not chosen anew in each file. That gives what
the file's own choice would: a file that holds a key phrase holds all its words, so
the two rarest of them that the file has are the two rarest of the phrase.

The scan is one narrow pass without a shuffle; only the document frequencies of
the template vocabulary (a fixed number of rows) are collected before it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.session import table

# Characters that separate words once A-Z are lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_words(self) -> list[str]:
        return self.key.split()

    @property
    def key_offset(self) -> int:
        w, k = self.words, self.key_words
        return next(i for i in range(len(w)) if w[i : i + len(k)] == k)


# The phrases of the contract, then notices of common licences.
TEMPLATES = (
    Template("mit", "under the mit license", "under the mit license", True),
    Template("apache-2", "apache license version 2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", "cc by nc", True),
    Template("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("lgpl-3", "licensed under the gnu lesser general public license version 3", "gnu lesser general public license version 3"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "may not use this file except in compliance with the license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
)


def text_words(text: Column) -> Column:
    """Lower-cased words. The Kelvin sign, which Unicode would lower to an ASCII
    ``k``, is first replaced by another letter outside ASCII, so that only A-Z
    become a-z as far as ASCII words can tell."""
    lowered = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def document_frequencies(words: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Number of rows and, for each vocabulary word, of rows that hold it: one
    aggregate whose result has at most ``len(vocabulary) + 1`` rows."""
    got = (
        words.select(F.explode(F.array_append(F.array_intersect(_strings(vocabulary), "words"), F.lit(""))).alias("word"))
        .groupBy("word").count().collect()
    )
    counts = {r["word"]: r["count"] for r in got}
    return counts.pop("", 0), counts


def rare_tokens(template: Template, n_docs: int, df: dict[str, int]) -> list[tuple[str, int]]:
    """The key phrase's two words of highest IDF with their offsets; ties by word."""
    idf = {w: math.log((1 + n_docs) / (1 + df.get(w, 0))) for w in template.key_words}
    chosen = sorted(idf, key=lambda w: (-idf[w], w))[:2]
    return [(w, template.key_words.index(w)) for w in chosen]


def scan_licenses(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    templates: tuple[Template, ...] = TEMPLATES, min_coverage: float = 0.6,
) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, spans``; ``spans`` are ``(label, base, start, coverage)``
    with ``start`` the first word of the key phrase.

    Null and empty texts have no words; a null id is carried through; repeated
    rows give repeated results; other input columns are ignored; an empty table
    gives an empty result. ``score`` is the largest share of a template's words
    found in place (1 for a base phrase), 0 without a match.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    words = docs.select("doc_id", text_words(F.col("text")).alias("words"))
    vocabulary = sorted({w for t in templates for w in t.key_words})
    n_docs, df = document_frequencies(words, vocabulary)
    postings = [rare_tokens(t, n_docs, df) for t in templates]
    rare = sorted({w for p in postings for w, _ in p})

    # Positions of the file's rare words, only for files that hold any.
    hits = F.when(
        F.arrays_overlap("words", _strings(rare)),
        F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: h["w"].isin(rare)),
    ).otherwise(F.array().cast("array<struct<w:string,i:int>>"))
    found = words.select("doc_id", "words", hits.alias("hits"))

    def spans_of(t: Template, tokens: list[tuple[str, int]]) -> Column:
        implied = lambda w, o: F.transform(F.filter("hits", lambda h: h["w"] == w), lambda h: h["i"] - F.lit(o))
        starts = [implied(w, o) for w, o in tokens]
        both = F.array_intersect(starts[0], starts[1]) if len(starts) > 1 else F.array_distinct(starts[0])
        ok = F.filter(both, lambda s: (s >= 0) & (F.slice("words", F.greatest(s, F.lit(0)) + 1, len(t.key_words)) == _strings(t.key_words)))
        if t.base:
            covered = lambda s: F.lit(1.0)
        else:
            terms = F.array(*[F.struct(F.lit(j - t.key_offset).alias("at"), F.lit(w).alias("w")) for j, w in enumerate(t.words)])
            covered = lambda s: F.size(F.filter(terms, lambda x: F.get("words", s + x["at"]) == x["w"])) / F.lit(float(len(t.words)))
        spans = F.transform(ok, lambda s: F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), s.cast("long").alias("start"), covered(s).alias("coverage")))
        return spans if t.base else F.filter(spans, lambda x: x["coverage"] >= min_coverage)

    none = F.array().cast("array<struct<label:string,base:boolean,start:bigint,coverage:double>>")
    spans = F.when(F.size("hits") > 0, F.concat(*[spans_of(t, p) for t, p in zip(templates, postings, strict=True)])).otherwise(none)
    out = found.select("doc_id", F.size("words").cast("long").alias("n_words"), spans.alias("spans"))
    base = F.filter("spans", lambda x: x["base"])
    labels = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda x: x["label"]))), ",")
    starts = F.transform(base, lambda x: x["start"])
    return out.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda x: x["coverage"])), F.lit(0.0)).alias("score"), "spans",
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def _oracle() -> str:
    """The same result by comparing every word position with every template."""
    lists = lambda ws: "[" + ",".join(f"'{w}'" for w in ws) + "]"
    parts = []
    for t in TEMPLATES:
        k, n, o = t.key_words, len(t.words), t.key_offset
        cover = "1.0::DOUBLE" if t.base else f"len(list_filter(range({n}), lambda j: s - {o} + j >= 0 AND w[s - {o} + j + 1] = {lists(t.words)}[j + 1])) / {float(n)}"
        parts.append(
            f"list_transform(list_filter(range(len(w)), lambda s: w[s + 1 : s + {len(k)}] = {lists(k)}), "
            f"lambda s: {{'label': '{t.label}', 'base': {str(t.base).lower()}, 'start': s, 'coverage': {cover}}})"
        )
    spans = "flatten([" + ",\n".join(parts) + "])"
    return f"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    s AS (SELECT doc_id, len(w) AS n_words, list_filter({spans}, lambda x: x.base OR x.coverage >= 0.6) AS spans FROM d)
    SELECT doc_id, n_words::BIGINT AS n_words,
      len(list_filter(spans, lambda x: x.base))::BIGINT AS n_base,
      list_min(list_transform(list_filter(spans, lambda x: x.base), lambda x: x.start))::BIGINT AS first_word,
      list_max(list_transform(list_filter(spans, lambda x: x.base), lambda x: x.start))::BIGINT AS last_word,
      coalesce(array_to_string(list_sort(list_distinct(list_transform(list_filter(spans, lambda x: x.base), lambda x: x.label))), ','), '') AS base_labels,
      coalesce(array_to_string(list_sort(list_distinct(list_transform(spans, lambda x: x.label))), ','), '') AS labels,
      coalesce(list_max(list_transform(spans, lambda x: x.coverage)), 0.0)::DOUBLE AS score
    FROM s"""


ORACLE_SQL = _oracle()
