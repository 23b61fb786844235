"""Language identification by nearest centroid: TF-IDF character n-grams, clustered centroids per language, cosine, rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pdpspark.llm.common import written

#: Hashed n-gram dimensions, longest n-gram.
DIMS, ORDERS = 4096, (1, 2, 3)
#: Bound of the labelled sample that centroids are clustered from: documents of each language, by hash of the id.
SAMPLE_PER_LANGUAGE = 1000
CLUSTERS, ROUNDS = 4, 12
#: A text is rejected where its cosine is under this share of the cosine that 1 % of the centroid's own sample stays under.
REJECT_SHARE = 0.5
#: Code points that are counted at once.
CHUNK = 1 << 20
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def counts(text: str | None) -> np.ndarray | None:
    """n-gram counts of the whole lower-cased text, runs of other characters than letters as one space; None without a letter."""
    total = None
    for at in range(0, len(text or ""), CHUNK):
        points = np.frombuffer(text[at : at + CHUNK].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        alpha = _letters()[points]
        if not alpha.any():
            continue
        points = np.where(alpha, points, 32)
        keep = np.ones(len(points), dtype=bool)
        keep[1:] = alpha[1:] | alpha[:-1]
        points = np.concatenate(([32], points[keep], [32])).astype(np.uint32)
        total = np.zeros(DIMS) if total is None else total
        for n in ORDERS:
            if len(points) < n:
                continue
            code = np.full(len(points) - n + 1, n, dtype=np.uint32)
            for i in range(n):
                code = (code ^ points[i : len(points) - n + 1 + i]) * np.uint32(0x9E3779B1)
                code ^= code >> np.uint32(15)
            total += np.bincount(code & np.uint32(DIMS - 1), minlength=DIMS)
    return total


@dataclass
class LanguageModel:
    """idf by dimension; a row of centroids, its language and least cosine for each cluster."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    least: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        seen = [counts(t) for t in texts]
        known = [i for i, v in enumerate(seen) if v is not None]
        langs, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        if known and self.languages:
            cosines = vectors([seen[i] for i in known], self.idf) @ self.centroids.T
            best = cosines.argmax(axis=1)
            for row, (i, b) in enumerate(zip(known, best, strict=True)):
                langs[i], score[i] = self.languages[b], min(1.0, max(0.0, cosines[row, b]))
                rejected[i] = cosines[row, b] < self.least[b]
        return langs, score, rejected


def vectors(seen: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """Normalised rows of (1 + log tf) * idf."""
    x = np.stack(seen)
    x = np.where(x > 0, 1 + np.log(np.maximum(x, 1)), 0) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def cluster(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from spread starting rows: centroids, and the least cosine for each."""
    k = min(CLUSTERS, len(x))
    chosen = [0]
    while len(chosen) < k:  # the row that is farthest from all chosen ones
        chosen.append(int((x @ x[chosen].T).max(axis=1).argmin()))
    centers = x[chosen]
    for _ in range(ROUNDS):
        own = (x @ centers.T).argmax(axis=1)
        sums = np.stack([x[own == c].sum(axis=0) if (own == c).any() else centers[c] for c in range(k)])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    cosines = x @ centers.T
    own = cosines.argmax(axis=1)
    least = np.array([np.quantile(cosines[own == c, c], 0.01) if (own == c).any() else 0.0 for c in range(k)])
    return centers, least * REJECT_SHARE


def fit_languages(rows: DataFrame) -> LanguageModel:
    """Learns from rows of doc_id, text and lang (rows with a null among them, or no letter, teach nothing).

    Document frequencies count all rows; centroids are clustered from at most SAMPLE_PER_LANGUAGE documents of each language.
    """
    rows = rows.select("doc_id", "text", "lang").where("doc_id is not null and text is not null and lang is not null")

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(DIMS, dtype=np.int64), 0
        for pdf in batches:
            for text in pdf["text"]:
                v = counts(text)
                if v is not None:
                    df += v > 0
                    n += 1
        yield pd.DataFrame({"dim": np.arange(-1, DIMS), "df": np.concatenate(([n], df))})

    total = rows.select("text").mapInPandas(frequencies, "dim int, df long").groupBy("dim").agg(F.sum("df").alias("df")).collect()  # DIMS + 1 rows
    df = np.zeros(DIMS + 1)
    for r in total:
        df[r.dim + 1] = r.df
    idf = np.log((1 + df[0]) / (1 + df[1:])) + 1

    place = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = rows.select("doc_id", "lang").withColumn("place", F.row_number().over(place)).where(F.col("place") <= SAMPLE_PER_LANGUAGE).drop("place")
    sample = written(rows.join(F.broadcast(chosen.dropDuplicates()), ["doc_id", "lang"]), "language-sample")  # at most SAMPLE_PER_LANGUAGE ids a language

    def centers(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        seen = [v for t in pdf.sort_values("doc_id")["text"] if (v := counts(t)) is not None]
        if not seen:
            return pd.DataFrame({"lang": [], "least": [], "center": []})
        found, least = cluster(vectors(seen, idf))
        return pd.DataFrame({"lang": [key[0]] * len(found), "least": least, "center": [c.tolist() for c in found]})

    learned = sorted(sample.groupBy("lang").applyInPandas(centers, "lang string, least double, center array<double>").collect())
    return LanguageModel(idf, np.array([r.center for r in learned]).reshape(-1, DIMS), [r.lang for r in learned], np.array([r.least for r in learned]))


def identify(docs: DataFrame, model: LanguageModel, reject: bool = False) -> DataFrame:
    """docs with lang_pred, score (cosine to the nearest centroid, 0 to 1) and rejected (too far from it), from the whole text alone.

    A null text or one without a letter is `und` with score 0 and rejected; with reject so is every rejected text. Rows stay as they
    are, repeated ones too; columns named lang_pred, score or rejected are replaced.
    """
    kept = docs.drop("lang_pred", "score", "rejected")
    ints = [f.name for f in kept.schema if f.dataType.typeName() in ("long", "integer", "short", "byte")]

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                pdf = whole.iloc[at : at + 256]
                langs, score, rejected = model.predict(list(pdf["text"]))
                if reject:
                    langs = [UNKNOWN if r else x for x, r in zip(langs, rejected, strict=True)]
                yield pdf.astype({c: "Int64" for c in ints if pdf[c].dtype.kind == "f"}).assign(lang_pred=langs, score=score, rejected=rejected)

    out = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + ["lang_pred string", "score double", "rejected boolean"]
    return kept.mapInPandas(predict, ", ".join(out))
