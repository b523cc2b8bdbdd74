"""Language identification by nearest centroids of TF-IDF n-gram vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm._shared import lean, leaning

#: Buckets that hold the 1- to 3-grams of letters.
BITS = 13
_U = np.uint32
_MULTIPLIERS = (_U(0x9E3779B1), _U(0x85EBCA77), _U(0xC2B2AE3D))
_PIECE = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts by bucket of all 1- to 3-grams of the lower-cased text; what isn't a letter counts as one space. None if there is no letter."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, 32).astype(_U)
    codes = codes[letter | np.concatenate([[True], letter[:-1]])]
    codes = np.concatenate([[32], codes, [32]]).astype(_U)
    counts = np.zeros(1 << BITS, dtype=np.int64)
    for at in range(0, len(codes), _PIECE):
        part = codes[at : at + _PIECE + 2]
        for n in (1, 2, 3):
            last = min(_PIECE, len(part) - n + 1)
            if last <= 0:
                continue
            mixed = sum(part[i : i + last] * _MULTIPLIERS[i] for i in range(n)) + _U(n * 0x27D4EB2F & 0xFFFFFFFF)
            mixed = (mixed ^ (mixed >> _U(15))) * _U(0x2C1B3C6D)
            counts += np.bincount(mixed >> _U(32 - BITS), minlength=1 << BITS)
    return counts


def _vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The normalised TF-IDF vector: (1 + log count) x idf."""
    out = np.zeros(len(counts), dtype=np.float32)
    at = np.flatnonzero(counts)
    weights = (1 + np.log(counts[at])) * idf[at]
    out[at] = weights / np.sqrt((weights * weights).sum())
    return out


def _frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """Document frequency of every bucket over all training rows, and the number of rows with a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((1 << BITS) + 1, dtype=np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                if (counts := ngram_counts(text)) is not None:
                    found[:-1] += counts > 0
                    found[-1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found))), pa.array(found)], names=["bucket", "n"])

    rows = train.select("text").mapInArrow(leaning(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    found = np.zeros((1 << BITS) + 1, dtype=np.int64)
    for r in rows:
        found[r["bucket"]] = r["n"]
    return found[:-1], int(found[-1])


def _clusters(vectors: np.ndarray, k: int, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means, begun with the vectors farthest from those before; (centroids, members)."""
    centroids = [vectors.mean(axis=0)]
    nearest = vectors @ centroids[0]
    chosen: list[np.ndarray] = []
    for _ in range(min(k, len(vectors))):
        chosen.append(vectors[int(np.argmin(nearest))])
        nearest = np.maximum(nearest, vectors @ chosen[-1])
    means = np.array(chosen)
    for _ in range(rounds):
        of = np.argmax(vectors @ means.T, axis=1)
        # Sums by product, without a copy of the members.
        member = (of == np.arange(len(means))[:, None]).astype(np.float32)
        full = member.any(axis=1)
        means[full] = (member @ vectors)[full]
        means /= np.linalg.norm(means, axis=1, keepdims=True)
    of = np.argmax(vectors @ means.T, axis=1)
    return means, of


def _band(counts: np.ndarray) -> int:
    """A text's length band: the number of binary digits of its letter count, about."""
    return int(counts.sum() // 3).bit_length()


class LanguageModel:
    """Centroids, their languages, inverse document frequencies and rejection bounds by length band: a few MB, whatever the corpus."""

    def __init__(self, langs: list[str], centroids: np.ndarray, idf: np.ndarray, bounds: np.ndarray):
        self.langs, self.centroids, self.idf, self.bounds = langs, centroids, idf, bounds

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine to its nearest centroid, rejected)."""
        counts = ngram_counts(text)
        if counts is None or not self.langs:
            return "und", 0.0, True
        cosines = self.centroids @ _vector(counts, self.idf)
        best = int(np.argmax(cosines))
        score = float(min(1.0, max(0.0, cosines[best])))
        return self.langs[best], score, score < self.bounds[min(_band(counts), len(self.bounds) - 1)]


def rejection_bounds(bands: np.ndarray, cosines: np.ndarray, share: float, slack: float) -> np.ndarray:
    """For every length band ``slack`` x the ``share`` quantile of its cosines; bands of under 20 rows take the least bound of the others."""
    bounds = np.full(64, np.nan)
    for band in np.unique(bands):
        own = cosines[bands == band]
        if len(own) >= 20:
            bounds[band] = slack * np.quantile(own, share)
    least = np.nanmin(bounds) if not np.isnan(bounds).all() else slack * np.quantile(cosines, share) if len(cosines) else 0.0
    return np.where(np.isnan(bounds), least, bounds)


def train(train: DataFrame, clusters: int = 4, sample: int = 1500, reject_share: float = 0.01, slack: float = 0.6) -> LanguageModel:
    """Learns from the rows (doc_id, lang, text) whose lang and text aren't null.

    Inverse document frequencies come from all of them. Centroids are
    clustered, per language, from a sample by hash of doc_id of about
    ``sample`` rows a language (all, if there are fewer). The same sample gives
    the rejection bounds: see ``rejection_bounds``. They go by length, as long
    texts of any kind share more n-grams with a centroid than short ones.
    Without a row there is no language, and every text is ``und``.
    """
    train = train.filter("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LanguageModel([], np.zeros((0, 1 << BITS), dtype=np.float32), np.ones(1 << BITS), np.zeros(64))
    frequency, n = _frequencies(train)
    idf = np.log((1 + n) / (1 + frequency)) + 1
    shares = F.create_map(*[F.lit(x) for lang, c in sorted(counts.items()) for x in (lang, min(1.0, sample / c))])
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000.0
    chosen = train.filter(place < shares[F.col("lang")]).select("doc_id", "lang", "text")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        with lean():
            order = rows[["doc_id", "text"]].sort_values(["doc_id", "text"]).index
            vectors, bands = np.empty((len(rows), 1 << BITS), dtype=np.float32), []
            for text in map(rows["text"].__getitem__, order):
                if (counts := ngram_counts(text)) is not None:
                    vectors[len(bands)] = _vector(counts, idf)
                    bands.append(_band(counts))
            if not bands:
                return pd.DataFrame({"lang": [], "centroid": [], "bands": [], "cosines": []})
            vectors = vectors[: len(bands)]
            means, of = _clusters(vectors, clusters)
            cosines = np.einsum("ij,ij->i", vectors, means[of]).astype(float).tolist()
            del vectors
            rest = [[]] * (len(means) - 1)
            return pd.DataFrame({"lang": [rows["lang"].iloc[0]] * len(means), "centroid": [m.tolist() for m in means], "bands": [bands, *rest], "cosines": [cosines, *rest]})

    found = chosen.groupBy("lang").applyInPandas(fit, "lang string, centroid array<float>, bands array<int>, cosines array<double>").collect()
    found = sorted(found, key=lambda r: (r["lang"], r["centroid"]))
    bounds = rejection_bounds(np.array([x for r in found for x in r["bands"]], dtype=int), np.array([x for r in found for x in r["cosines"]]), reject_share, slack)
    return LanguageModel([r["lang"] for r in found], np.array([r["centroid"] for r in found], dtype=np.float32).reshape(-1, 1 << BITS), idf, bounds)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with the columns lang_pred, score and rejected, from whole texts.

    A text that is null or has no letter: ``und``, 0.0, rejected. A text whose
    nearest centroid has a cosine under the model's bound for its length is
    rejected too, with its nearest language and score. Ties go to the first language. Other
    columns are kept; columns of these three names are replaced. Repeated rows
    are kept; an empty table gives an empty result.
    """
    handle = docs.sparkSession.sparkContext.broadcast(model)
    struct = "lang_pred string, score double, rejected boolean"

    @F.pandas_udf(struct)
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = handle.value
        with lean():
            for part in texts:
                yield pd.DataFrame([own.predict(t) for t in part], columns=["lang_pred", "score", "rejected"])

    kept = docs.drop("lang_pred", "score", "rejected")
    return kept.withColumn("_language", predict(F.col("text").cast("string"))).select(*[F.col(f"`{c}`") for c in kept.columns], "_language.*")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of training: crc32 of its id as text, modulo 4, is 2 (null: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learned(docs: DataFrame) -> LanguageModel:
    """The model learned from all documents that aren't held out."""
    return train(docs.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select("doc_id", "lang", "text"))


def op8_language_id(spark, sf_dir):
    """Every document's language; edge cases as in ``identify``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), learned(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
