"""Ranking of scored pairs; ties go by combo type, then song ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _order() -> list:
    return [F.col("score_total").desc_nulls_last(), F.col("combo_type").asc(), F.col("vocal_song_id").asc(), F.col("inst_song_id").asc()]


def top(candidates: DataFrame, n: int) -> DataFrame:
    if n < 0:
        raise ValueError("a limit can't be negative")
    return candidates.orderBy(*_order()).limit(n)


def at_least(candidates: DataFrame, min_score: float = 0.0, limit: int = 100) -> DataFrame:
    return top(candidates.filter(F.col("score_total") >= float(min_score)), limit)


def for_song(candidates: DataFrame, song_id: int, role: str = "vocal", combo_type: str | None = None) -> DataFrame:
    """A song's pairs in one role: 'vocal' is the upper layer, anything else the lower."""
    found = candidates.filter(F.col("vocal_song_id" if role == "vocal" else "inst_song_id") == song_id)
    return found.filter(F.col("combo_type") == combo_type) if combo_type else found


def find_matches(candidates: DataFrame, song_id: int, top_k: int = 10, role: str = "vocal", combo_type: str | None = None) -> DataFrame:
    return top(for_song(candidates, song_id, role, combo_type), top_k)


def ranked(candidates: DataFrame, n: int) -> DataFrame:
    """The first n pairs with their rank; the rank is numbered over n rows only."""
    return top(candidates, n).withColumn("rank", F.row_number().over(Window.orderBy(*_order())))


def top_per_combo(candidates: DataFrame, n: int = 20) -> DataFrame:
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy("combo_type").orderBy(*_order()))).filter(F.col("rank") <= n)
