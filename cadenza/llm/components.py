"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm._shared import written


def _stars(edges: DataFrame, both: bool) -> DataFrame:
    """One star step over edges (u, v), u > v.

    Large star (``both``): every larger neighbour of a node is hung under the
    smallest of its neighbours and itself. Small star: every smaller neighbour
    and the node itself are hung under the smallest of them.
    """
    if both:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Written, so that both sides of the join are shuffled for it alone and adaptive execution can split a hub.
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), "least")
    near = edges.join(least, "u")
    if both:
        hung = near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        hung = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return hung.filter("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v); the component is its smallest node.

    Edges may come in any direction, repeatedly, or as loops (ignored); edges
    with a null end are ignored. No edges: an empty result. The number of
    rounds grows with the logarithm of the longest chain; each round is two
    aggregations and two joins on edges, written to the shared folder.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    edges = written(edges, "edges")
    digest = None
    while True:
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == digest:
            break
        digest = tuple(row)
        if not row[0]:
            break
        edges = written(_stars(_stars(edges, True), False), "edges")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
