"""Toxicity by a classifier chain of sparse logistic regressions over words."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm._shared import dropped, lean, written

#: About so many labelled rows, chosen by hash of doc_id, fit the models; so many words, those most related to a category's label, are tried as its inputs.
SAMPLE, VOCABULARY = 20_000, 4096
#: Words a model keeps at most; a bound of the fit, as its last step solves a dense system.
CHOSEN = 512
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    """The distinct lower-cased words (runs of letters) of a whole text."""
    return set(_LETTERS.findall(text.lower())) if text else set()


def with_words(rows: DataFrame) -> DataFrame:
    """(id, words) of rows (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [sorted(words_of(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.string()))], names=["id", "words"])

    return rows.select("id", "text").mapInArrow(run, "id long, words array<string>")


def _product(rows: np.ndarray, columns: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, w[columns], minlength=n)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(words: list[np.ndarray], dense: np.ndarray, y: np.ndarray, size: int, tried: int, most_chosen: int = CHOSEN, rounds: int = 150) -> tuple[np.ndarray, np.ndarray, float]:
    """(word weights, weights of the dense inputs, intercept).

    First an L1-penalised fit by accelerated proximal gradient chooses words;
    its penalty is the universal threshold for ``tried`` chance words. Then a
    ridge fit by Newton steps on the dense inputs and the chosen words, of which
    the ``most_chosen`` with the greatest weights are taken.
    """
    n, share = len(y), y.mean()
    row = np.repeat(np.arange(n), [len(x) for x in words])
    column = np.concatenate(words).astype(np.int64) if len(row) else np.zeros(0, dtype=np.int64)
    rate = np.bincount(column, minlength=size) / n
    scale = np.sqrt(np.maximum(rate * (1 - rate), 1e-12))
    penalty = math.sqrt(share * (1 - share)) * math.sqrt(2 * math.log(max(2, tried)) / n)
    w, base = np.zeros(size), math.log(share / (1 - share))
    ahead, ahead_base, momentum = w.copy(), base, 1.0
    step = 4.0 / max(1.0, np.sqrt(size) / 8)
    for _ in range(rounds):
        inner = ahead / scale
        error = _sigmoid(_product(row, column, inner, n) + ahead_base - inner @ rate) - y
        gradient = (np.bincount(column, error[row], minlength=size) / n - rate * error.mean()) / scale
        new = ahead - step * gradient
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_base = ahead_base - step * error.mean()
        later = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        ahead, ahead_base = new + (momentum - 1) / later * (new - w), new_base + (momentum - 1) / later * (new_base - base)
        change = np.abs(new - w).max(initial=0)
        w, base, momentum = new, new_base, later
        if change < 1e-5:
            break
    chosen = np.argsort(-np.abs(w), kind="stable")[: min(most_chosen, int((w != 0).sum()))]
    place = np.full(size, -1)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((n, len(chosen) + dense.shape[1] + 1))
    inside = place[column] >= 0
    x[row[inside], place[column[inside]]] = 1
    x[:, len(chosen) : -1], x[:, -1] = dense, 1
    beta = np.zeros(x.shape[1])
    beta[-1] = math.log(share / (1 - share))
    ridge = np.full(len(beta), 0.2)
    ridge[-1] = 1e-6
    for _ in range(25):
        p = _sigmoid(x @ beta)
        curve = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(ridge)
        change = np.linalg.solve(curve, x.T @ (y - p) - ridge * beta)
        beta += change * min(1.0, 4.0 / max(1e-9, np.abs(change).max()))
        if np.abs(change).max() < 1e-6:
            break
    out = np.zeros(size)
    out[chosen] = beta[: len(chosen)]
    return out, beta[len(chosen) : -1], float(beta[-1])


class Link:
    """One category's linear model; its inputs are a text's words and the probabilities of the categories before it."""

    def __init__(self, category: str, weights: dict[str, float], before: list[float], intercept: float):
        self.category, self.weights, self.before, self.intercept = category, weights, before, intercept

    def probability(self, words: set[str], before: list[float]) -> float:
        z = self.intercept + sum(self.weights[w] for w in sorted(self.weights.keys() & words)) + sum(a * b for a, b in zip(self.before, before))
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def vocabularies(rows: DataFrame, category: str, folds: int, most: int) -> list[tuple[int, int, int, list[str]]]:
    """For every model, without fold 0, 1, ... and then from all rows: (rows, positive rows, words tried, its words).

    A model's words are counted over its own rows alone, so that a fold's texts
    and labels have no part in the model that scores it. Its words are the
    ``most`` that are most related to the label, of those in two rows or more.
    """
    exploded = rows.select("fold", category, F.explode("words").alias("word"))
    part = lambda c, m: F.sum(F.when(F.col("fold") != m, c).otherwise(0))
    own = [x for m in range(folds + 1) for x in (part(F.lit(1), m).alias(f"n{m}"), part(F.col(category), m).alias(f"hit{m}"))]
    counts = written(exploded.groupBy("word").agg(*own), "vocabulary")
    sizes = rows.agg(*own).first()
    out = []
    for m in range(folds + 1):
        n, positive = sizes[f"n{m}"] or 0, sizes[f"hit{m}"] or 0
        c, hit = F.col(f"n{m}"), F.col(f"hit{m}")
        known = counts.filter(c > 1)
        if positive in (0, n):
            out.append((n, positive, 0, []))
            continue
        related = F.abs(hit - c * (positive / n)) / F.sqrt(c * (1 - c / (n + 1.0)))
        out.append((n, positive, known.count(), [r["word"] for r in known.orderBy(related.desc(), "word").limit(most).collect()]))
    dropped(counts)
    return out


def _links(rows: DataFrame, category: str, before: list[str], folds: int, vocabulary: int, most_chosen: int) -> list[Link]:
    """The category's models: one without each fold, then one from all rows (id, words, fold, labels, p_<before>).

    A model whose rows all have one label is a constant: 1 or 0; without any row it is 0.
    """
    rows = rows.filter(F.col(category).isNotNull())
    known = vocabularies(rows, category, folds, vocabulary)
    made = {m: Link(category, {}, [0.0] * len(before), 35.0 if n and n == positive else -35.0) for m, (n, positive, _, _) in enumerate(known) if positive in (0, n)}
    handle = rows.sparkSession.sparkContext.broadcast([{w: i for i, w in enumerate(best)} for *_, best in known])
    inputs = [f"p_{c}" for c in before]

    @F.pandas_udf("array<array<int>>")
    def places(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in words:
            yield part.map(lambda ws: [[own[w] for w in ws if w in own] for own in handle.value])

    dealt = rows.select("id", "fold", F.col(category).alias("y"), F.array(*inputs).cast("array<double>").alias("dense"), F.posexplode(places("words")).alias("model", "places"))
    dealt = dealt.filter((F.col("model") != F.col("fold")) & ~F.col("model").isin(list(made)) if made else F.col("model") != F.col("fold"))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        with lean():
            part = part.sort_values("id")
            _, _, tried, best = known[int(part["model"].iloc[0])]
            y = part["y"].to_numpy(dtype=float)
            dense = np.array(part["dense"].tolist(), dtype=float).reshape(len(y), -1)
            weights, own, intercept = fit_logistic(list(part["places"]), dense, y, len(best), tried, most_chosen)
            return pd.DataFrame({"model": part["model"].iloc[:1], "weights": [weights.tolist()], "before": [own.tolist()], "intercept": [intercept]})

    found = dealt.groupBy("model").applyInPandas(fit, "model int, weights array<double>, before array<double>, intercept double").collect()
    made |= {r["model"]: Link(category, {w: x for w, x in zip(known[r["model"]][3], r["weights"]) if x}, list(r["before"]), r["intercept"]) for r in found}
    return [made[m] for m in range(folds + 1)]


def fit_chain(docs: DataFrame, labels: DataFrame, categories: list[str], folds: int = 3, sample: int = SAMPLE, vocabulary: int = VOCABULARY, most_chosen: int = CHOSEN) -> list[Link]:
    """The models of the categories, in their order.

    labels: doc_id and a 0/1 column for each category. Of several rows for one
    doc_id the largest label counts; a null label leaves the document out for
    that category only. About ``sample`` labelled documents, chosen by hash of
    doc_id, are used (all, if there are fewer). A later model learns from
    probabilities that the earlier ones gave out of fold: each of ``folds``
    parts is scored by models that saw neither its texts nor its labels. A
    model tries the ``vocabulary`` words most related to its label and keeps at
    most ``most_chosen`` of them. A category with a single label value is a
    constant; without any label it is 0.
    """
    labels = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(*[F.max(c).cast("int").alias(c) for c in categories])
    n = max(1, labels.count())
    chosen = labels.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < min(1.0, sample / n) * 1_000_000)
    # chosen has about `sample` rows of a few numbers, so it may go to every task.
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    own = with_words(texts.join(F.broadcast(chosen), "id", "left_semi"))
    rows = written(own.join(F.broadcast(chosen), "id").withColumn("fold", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(folds))), "labelled")
    chain: list[Link] = []
    for i, category in enumerate(categories):
        links = _links(rows, category, categories[:i], folds, vocabulary, most_chosen)
        chain.append(links[-1])
        if i + 1 < len(categories):
            before = F.array(*[f"p_{c}" for c in categories[:i]]).cast("array<double>")
            rows = written(rows.withColumn(f"p_{category}", _out_of_fold(links)("words", "fold", before)), "labelled")
    return chain


def _out_of_fold(links: list[Link]) -> Callable:
    """The probability of a row by the model that was fit without its fold."""

    @F.pandas_udf("double")
    def scored(words: pd.Series, fold: pd.Series, before: pd.Series) -> pd.Series:
        return pd.Series([links[f].probability(set(w), list(b)) for w, f, b in zip(words, fold, before)], dtype=float)

    return scored


def score(docs: DataFrame, chain: list[Link], threshold: float = 0.5) -> DataFrame:
    """docs with p_<category> for every model of the chain and ``<last category>``: whether its probability reaches ``threshold``.

    Whole texts are read; a null or empty text has no words, so the models'
    base rates. Repeated rows are kept; an empty table gives an empty result.
    Columns of docs with these names are replaced, others are kept.
    """
    last, names = chain[-1].category, [f"p_{link.category}" for link in chain]
    handle = docs.sparkSession.sparkContext.broadcast(chain)

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            out = []
            for text in part:
                words, found = words_of(text), []
                for link in handle.value:
                    found.append(link.probability(words, found))
                out.append(found)
            yield pd.DataFrame(out, columns=names)

    kept = docs.drop(last, *names)
    rows = kept.withColumn("_toxicity", scored(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return rows.select(*[F.col(f"`{c}`") for c in kept.columns], "_toxicity.*").withColumn(last, F.col(names[-1]) >= threshold)


def op1_toxicity(spark, sf_dir):
    """The toxicity of every document; edge cases as in ``fit_chain`` and ``score``."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    chain = fit_chain(docs, labels, ["quality", "toxic"])
    return score(docs.select("doc_id", "text"), chain).drop("text")
