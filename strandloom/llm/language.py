"""Language identification by nearest centroid.

Texts become TF-IDF vectors over hashed character 2- and 3-grams, of length one.
Each language has several centroids from spherical k-means over a bounded sample
of its labelled texts; a text takes the language of the centroid with the
largest cosine. A text farther from its centroid than that centroid's reach, a
multiple of a high quantile of its members' distances, is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.textbatch import LETTER, _classes, code_points, text_slices, texts_of
from strandloom.session import table

DIMS = 4096
#: Texts and bytes held as vectors at a time.
SLICE_DOCS, SLICE_BYTES = 256, 600_000
UNKNOWN = "und"
#: Clusters with fewer members have the reach of their language.
TINY = 50


def ngram_counts(texts: list[str], dims: int = DIMS) -> np.ndarray:
    """Counts of hashed 2- and 3-grams of lower-cased letters; what isn't a
    letter counts as one blank, and grams of blanks alone don't count."""
    cps, starts = code_points([f" {t.lower()} " for t in texts])
    letter = _classes()[cps] == LETTER
    c = np.where(letter, cps, 32).astype(np.uint32)
    doc = np.repeat(np.arange(len(texts)), np.diff(starts))
    out = np.zeros(len(texts) * dims, np.float32)
    for n, seed in ((2, 0x85EBCA6B), (3, 0xC2B2AE35)):
        m = len(c) - n + 1
        if m <= 0:
            continue
        h = np.full(m, seed, np.uint32)
        some = np.zeros(m, bool)
        for k in range(n):
            h = (h ^ c[k : k + m]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
            some |= letter[k : k + m]
        some &= doc[:m] == doc[n - 1 :]
        # Runs of blanks are one blank: a gram doesn't hold two in a row.
        for k in range(n - 1):
            some &= letter[k : k + m] | letter[k + 1 : k + 1 + m]
        out += np.bincount(doc[:m][some] * dims + (h[some] % np.uint32(dims)), minlength=len(out))
    return out.reshape(len(texts), dims)


def has_letter(texts: list[str]) -> np.ndarray:
    cps, starts = code_points(texts)
    seen = np.append(0, np.cumsum(_classes()[cps] == LETTER))
    return seen[starts[1:]] > seen[starts[:-1]]


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    owner: np.ndarray  # language number of each centroid
    centroids: np.ndarray
    reach: np.ndarray  # largest distance accepted
    idf: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return unit(np.log1p(counts) * self.idf)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and rejection of each text."""
        known = has_letter(texts)
        if not len(self.centroids):
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cosine = self.vectors(ngram_counts(texts)) @ self.centroids.T
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(texts)), best].astype(np.float64), 0, 1)
        lang = [self.languages[self.owner[b]] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        return lang, np.where(known, score, 0.0), ~known | (1 - score > self.reach[best])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of unit vectors; starts from far points in turn, each at nine tenths
    of the way from the nearest to the farthest, so that outliers found no cluster."""
    chosen = [unit(x.mean(axis=0, keepdims=True))[0]]
    while len(chosen) < min(k, len(x)):
        chosen.append(x[(x @ np.array(chosen).T).max(axis=1).argsort(kind="stable")[len(x) // 10]])
    c = np.array(chosen)
    for _ in range(rounds):
        of = (x @ c.T).argmax(axis=1)
        c = unit(np.array([x[of == j].mean(axis=0) if (of == j).any() else c[j] for j in range(len(c))]))
    return c


def fit(
    docs: DataFrame, *, clusters: int = 4, per_language: int = 400, max_sample: int = 4000, slack: float = 1.35, quantile: float = 0.99,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> Model:
    """Centroids from at most ``max_sample`` labelled texts, ``per_language`` of
    each language at most, drawn by a hash of the id. Whole texts are used; rows
    with a null text, language or id are not. One count per language precedes the
    draw, so that only about twice the sample is shuffled. A centroid's reach is
    ``slack`` times the ``quantile`` of its members' distances, that of its
    language's where it has fewer than ``TINY`` members."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna()
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return Model((), np.zeros(0, np.int64), np.zeros((0, DIMS), np.float32), np.zeros(0), np.ones(DIMS, np.float32))
    each = max(1, min(per_language, max_sample // len(languages)))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30))
    share = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, 2 * each / sizes[lang] + 20 / sizes[lang]) * (1 << 30)))])
    drawn = rows.withColumn("draw", draw).where(F.col("draw") <= share[F.col("lang")])
    order = Window.partitionBy("lang").orderBy("draw", "doc_id", "text")
    sample = drawn.withColumn("n", F.row_number().over(order)).where(F.col("n") <= each).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            for lo in range(0, len(texts), 200):
                some = texts[lo : lo + 200]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(some)), pa.array([x.astype(np.uint16 if x.max() < 65536 else np.float32).tobytes() for x in ngram_counts(some)], pa.binary())], names=["lang", "counts"])

    got = sorted((r["lang"], bytes(r["counts"])) for r in sample.mapInArrow(count, "lang string, counts binary").collect())
    counts = np.array([np.frombuffer(b, np.uint16 if len(b) == 2 * DIMS else np.float32).astype(np.float32) for _, b in got])
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    x, lang = unit(np.log1p(counts) * idf), np.array([g[0] for g in got])
    centroids, owner, reach = [], [], []
    for i, name in enumerate(languages):
        own = x[(lang == name) & (counts.sum(axis=1) > 0)]
        if not len(own):
            continue
        c = spherical_kmeans(own, clusters)
        cosine = own @ c.T
        of = cosine.argmax(axis=1)
        far = lambda distances: min(1.0, slack * float(np.quantile(distances, quantile)))
        for j in range(len(c)):
            members = cosine[of == j, j]
            centroids.append(c[j])
            owner.append(i)
            reach.append(far(1 - (members if len(members) >= TINY else cosine.max(axis=1))))
    return Model(languages, np.array(owner, np.int64), np.array(centroids, np.float32).reshape(-1, DIMS), np.array(reach), idf)


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, rejected``, one row per input row.

    A null text and one without a letter give ``und``, score 0 and rejection.
    Ties go to the language that sorts first. Null ids are carried; repeated rows
    give repeated results; other columns are ignored; an empty table gives an
    empty result; a model without a language calls everything ``und``.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in text_slices(batch.column(1), SLICE_BYTES, SLICE_DOCS):
                lang, score, rejected = model.predict(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=schema.names)

    return rows.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows that ``identify`` doesn't reject, with their columns, whatever these
    are called."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in text_slices(batch.column(at), SLICE_BYTES, SLICE_DOCS):
                _, _, rejected = model.predict(texts)
                yield batch.slice(lo, len(texts)).filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from learning."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
