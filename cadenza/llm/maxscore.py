"""Exact top-k search by inner product: MaxScore over sharded postings."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Postings:
    """One shard's inverted index: for every term the weights of the items, their least and greatest.

    Items are in the order of their ids, so that a smaller row wins a tie.
    Terms that an item lacks weigh 0 in it. Weights are kept term by term, as
    64-bit floats where every sum is exact in them, else as integers.
    """

    def __init__(self, vectors: list[np.ndarray], width: int, largest_query: int):
        table = np.zeros((width, len(vectors)), dtype=np.int64)
        for row, v in enumerate(vectors):
            table[: len(v), row] = v
        size = int(np.abs(table).max(initial=0)) * largest_query * max(1, width)
        self.lists = table.astype(np.float64) if size < 1 << 53 else table
        self.least, self.greatest = self.lists.min(axis=1), self.lists.max(axis=1)
        self.n = len(vectors)

    def search(self, query: np.ndarray, k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best items other than ``own`` rows; ties to the smaller row."""
        query = np.asarray(query, dtype=self.lists.dtype)
        terms = np.flatnonzero(query)
        bounds = np.maximum(query[terms] * self.least[terms], query[terms] * self.greatest[terms])
        order = np.argsort(-bounds, kind="stable")
        terms, bounds = terms[order], bounds[order]
        rest = np.append(np.cumsum(bounds[::-1])[::-1], 0)
        barred = np.zeros(self.n, dtype=bool)
        barred[own] = True
        # The k-th best of a first few items is a score to beat.
        head = np.flatnonzero(~barred[: 64 * k])
        first = query[terms] @ self.lists[np.ix_(terms, head)] if len(terms) else np.zeros(len(head))
        beat = np.partition(first, len(first) - k)[len(first) - k] if len(first) >= k else -np.inf
        # Essential terms: without one of them, an item can't reach the score to beat.
        essential = int(np.searchsorted(-rest, -beat, side="left")) if beat > -np.inf else len(terms)
        essential = min(len(terms), max(essential, 8))
        scores = query[terms[:essential]] @ self.lists[terms[:essential]] if essential else np.zeros(self.n, dtype=self.lists.dtype)
        alive = np.flatnonzero((scores + rest[essential] >= beat) & ~barred)
        scores = scores[alive]
        # Probe the other terms, largest bound first, while an item is competitive.
        at = essential
        while at < len(terms) and len(alive):
            end = min(len(terms), at + 8)
            part = terms[at:end]
            scores = scores + query[part] @ self.lists[np.ix_(part, alive)]
            if end < len(terms):
                keep = scores + rest[end] >= beat
                alive, scores = alive[keep], scores[keep]
            at = end
        if len(alive) > k:
            edge = np.partition(scores, len(scores) - k)[len(scores) - k]
            keep = scores >= edge
            alive, scores = alive[keep], scores[keep]
        best = np.lexsort((alive, -scores))[:k]
        return alive[best], scores[best]


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component as a double, as a long; null for vectors that are null or hold null or non-finite components.

    Components beyond the longs are cut to the greatest or least one, which
    ``top_k`` refuses.
    """
    doubles = F.transform(vector, lambda x: x.cast("double"))
    sound = ~F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = lambda x: F.least(F.greatest(F.floor(x * F.lit(float(scale))).cast("double"), F.lit(-9.2e18)), F.lit(9.2e18)).cast("long")
    return F.when(sound, F.transform(doubles, whole))


#: Below the range of a long by more than sums of floats can be off.
_RANGE = 2.0**63 * (1 - 1e-9)


def _most_by_component(items: DataFrame, queries: DataFrame, width: int) -> float:
    """The sum over components of the greatest of any item times the greatest of any query: no score is beyond it."""
    greatest = lambda df: df.agg(*[F.max(F.abs(F.get("vector", F.lit(i)).cast("double"))).alias(f"c{i}") for i in range(width)]).first()
    return sum((a or 0.0) * (b or 0.0) for a, b in zip(greatest(items), greatest(queries)))


def top_k(items: DataFrame, queries: DataFrame, k: int = 5, block_mb: int = 32) -> DataFrame:
    """(query_id, rank int, id, score long): the k items with the greatest inner product for every query.

    items: id long, vector array<long>; queries: query_id long, vector
    array<long>. Items with a query's id are its own and not candidates. Ties
    go to the smaller id; shorter vectors count as padded with zeros. Rows with
    a null id or vector take no part. Every row counts: an item given twice can
    be found twice, and the rows of one query_id share its k places. With no
    other item a query has no rows. Other columns are ignored. If a score could
    pass the range of a long by the greatest components of items and queries,
    a ValueError is raised: component by component, so that an outlier in one
    that no query has large is no reason.

    Items are dealt by hash over shards, queries over blocks, each of at most
    about ``block_mb`` MB (small tables: so many shards that all cores work);
    each pair of a shard and a block is one task, whose best k a query are
    merged at the end. So an item is copied once for every block of queries
    (for 64 components, of 65,536), a query once for every shard.
    """
    items = items.select(F.col("id").cast("long").alias("id"), "vector").filter("id is not null and vector is not null")
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), "vector").filter("query_id is not null and vector is not null")
    size = F.aggregate("vector", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x.cast("double"))))
    n, width, greatest = items.agg(F.count("*"), F.max(F.size("vector")), F.max(size)).first()
    asked, longest, largest = queries.agg(F.count("*"), F.max(F.size("vector")), F.max(size)).first()
    width, largest = max(1, width or 0, longest or 0), max(1, int(largest or 0))
    if (greatest or 0) * largest * width >= _RANGE and _most_by_component(items, queries, width) >= _RANGE:
        raise ValueError("scores could pass the range of 64 bits: scale the vectors down")
    most = max(1, (block_mb << 20) // (8 * width))
    cores = items.sparkSession.sparkContext.defaultParallelism
    shards, blocks = max(1, math.ceil(n / most), min(2 * cores, math.ceil(n / 4096))), max(1, math.ceil(asked / most))
    # A row's place in its task takes part in the hash, so that repeated rows are spread too.
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("id", "vector", F.monotonically_increasing_id()), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    posed = queries.withColumn("block", F.pmod(F.xxhash64("query_id", "vector", F.monotonically_increasing_id()), F.lit(blocks))).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def run(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(asked):
            own = own.sort_values("id", kind="stable")
            ids = own["id"].to_numpy()
            index = Postings(list(own["vector"]), width, largest)
            for query_id, vector in zip(asked["query_id"], asked["vector"]):
                query = np.zeros(width, dtype=np.int64)
                query[: len(vector)] = vector
                mine = np.arange(np.searchsorted(ids, query_id, "left"), np.searchsorted(ids, query_id, "right"))
                rows, scores = index.search(query, k, mine)
                out += [(query_id, int(ids[r]), int(s)) for r, s in zip(rows, scores)]
        return pd.DataFrame(out, columns=["query_id", "id", "score"])

    near = dealt.groupBy("block", "shard").cogroup(posed.groupBy("block", "shard")).applyInPandas(run, "query_id long, id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op5_exact_top_k(spark, sf_dir):
    """The 5 nearest vectors of every 50th vector; edge cases as in ``quantised`` and ``top_k``."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), quantised(F.col("embedding"), 256).alias("vector"))
    queries = vectors.filter("id % 50 = 0").withColumnRenamed("id", "query_id")
    return top_k(vectors, queries, 5).withColumnRenamed("id", "vec_id")


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
