"""Language identification by nearest centroid over TF-IDF n-gram vectors.

A text becomes the counts of its lower-cased byte trigrams, hashed to a fixed
number of features; counts are damped by a logarithm, weighted by inverse
document frequency and normalised. Each language has several centroids, found
by spherical k-means on its own vectors. A text gets the language of the
centroid with the largest cosine. If that cosine is below what nearly all
training texts of the centroid reach, the text is `rejected`: it is far from
every learned language.

Fitting uses a bounded sample of labelled rows (`sample` in all, shared evenly
by the languages and chosen by a hash of doc_id); prediction reads every whole
text. The model is a table of languages x clusters rows and `FEATURES` columns,
whose size does not depend on the corpus.

Defined cases: a null text, or one without a letter, is `und` with score 0 and
rejected; rows without a lang or with a null doc_id are predicted but never
learned from; with no labelled row at all every text is `und`; an empty table
gives no rows. Columns other than doc_id, text and lang are never read, and
lang is read only where the model is fitted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, slices, table, text_bytes

FEATURES = 4096
SAMPLE = 3000
CLUSTERS = 4
ROUNDS = 12
#: A centroid rejects what is below this share of its training texts' cosines, less a margin.
REJECT_QUANTILE = 0.01
REJECT_MARGIN = 0.1
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
#: Bytes that are no letters all count as a space.
_PLAIN = np.array([x if 97 <= x <= 122 or x >= 128 else 32 for x in range(256)], np.uint32)


def ngram_counts(texts: list[str]) -> np.ndarray:
    """Rows of hashed trigram counts."""
    raw = [f" {t.lower()} ".encode() for t in texts]
    codes = _PLAIN[np.frombuffer(b"".join(raw), np.uint8)]
    length = np.fromiter(map(len, raw), np.int64, len(raw))
    grams = (codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA77) + codes[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(20)
    row = np.repeat(np.arange(len(raw)), length)[:-2]
    inside = np.ones(len(grams), bool)
    ends = np.cumsum(length)[:-1]
    inside[np.concatenate([ends - 1, ends - 2])] = False
    return np.bincount((row * FEATURES + grams)[inside], minlength=len(raw) * FEATURES).reshape(len(raw), FEATURES)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    languages: list[str]  # of each centroid
    idf: np.ndarray
    centroids: np.ndarray
    floor: np.ndarray  # the least cosine that each centroid accepts

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts.astype(np.float32)) * self.idf)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """The language, the cosine and whether it is rejected."""
        out = [(UNKNOWN, 0.0, True)] * len(texts)
        known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        if known and self.languages:
            cosine = self.vectors(ngram_counts([texts[i] for i in known])) @ self.centroids.T
            best = cosine.argmax(axis=1)
            for i, b, c in zip(known, best.tolist(), cosine[np.arange(len(best)), best].tolist(), strict=True):
                out[i] = (self.languages[b], min(1.0, max(0.0, c)), c < self.floor[b])
        return out


def _clusters(vectors: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means; starts from vectors far from each other."""
    centres = [_unit(vectors.mean(axis=0, keepdims=True))[0]]
    while len(centres) < min(k, len(vectors)):
        centres.append(vectors[(vectors @ np.array(centres).T).max(axis=1).argmin()])
    centre = np.array(centres)
    for _ in range(rounds):
        mine = (vectors @ centre.T).argmax(axis=1)
        centre = np.array([_unit(vectors[mine == i].mean(axis=0, keepdims=True))[0] if (mine == i).any() else centre[i] for i in range(len(centre))])
    return centre


def fit(docs: DataFrame, learn: Column, sample: int = SAMPLE, clusters: int = CLUSTERS) -> Model:
    """The model from the rows where learn is true and text and lang are not null."""
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    count = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not count:
        return Model([], np.zeros(FEATURES, np.float32), np.zeros((0, FEATURES), np.float32), np.zeros(0))
    each = max(1, sample // len(count))
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in count.items() for x in (lang, each / n)]), F.col("lang"))
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < share * (1 << 30))
    chosen = chosen.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))  # however often a doc_id is repeated

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            counts = [ngram_counts([t])[0] for t in batch.column("text").to_pylist()]
            at = [np.flatnonzero(c) for c in counts]
            values = [c[i].astype(np.int32).tobytes() for c, i in zip(counts, at, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("doc_id").cast(pa.string()), pa.array([i.astype(np.int16).tobytes() for i in at], pa.binary()), pa.array(values, pa.binary())], ["lang", "id", "at", "n"])

    found = sorted(chosen.mapInArrow(featurize, "lang string, id string, at binary, n binary").toArrow().to_pylist(), key=lambda r: (r["lang"], r["id"], r["at"]))
    counts = np.zeros((len(found), FEATURES), np.float32)
    for row, r in zip(counts, found, strict=True):
        row[np.frombuffer(r["at"], np.int16)] = np.frombuffer(r["n"], np.int32)
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    model = Model([], idf, np.zeros((0, FEATURES), np.float32), np.zeros(0))
    vectors, langs = model.vectors(counts), np.array([r["lang"] for r in found])
    parts, floors = [], []
    for lang in sorted(set(langs.tolist())):
        mine = vectors[langs == lang]
        centre = _clusters(mine, clusters, ROUNDS)
        cosine = mine @ centre.T
        best = cosine.argmax(axis=1)
        for i in range(len(centre)):
            reached = cosine[best == i, i]
            parts.append(centre[i])
            floors.append(np.quantile(reached, REJECT_QUANTILE) - REJECT_MARGIN if len(reached) else 1.0)
            model.languages.append(lang)
    model.centroids, model.floor = np.array(parts, np.float32), np.array(floors)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (cosine, 0 to 1) and rejected of every row of docs. The model goes along with the tasks' code, under 1 MB."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 18):
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = [x.decode() if v else None for x, v in zip(text_bytes(part.column("text")), part.column("text").is_valid().to_pylist(), strict=True)]
                lang, score, rejected = zip(*model.predict(texts), strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    apart = held_out(F.col("doc_id"), 4, 2)
    found = identify(docs, fit(docs, ~apart))
    return found.select("doc_id", F.coalesce(apart, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
