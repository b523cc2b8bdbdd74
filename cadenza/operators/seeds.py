"""A seed's best pairs from the features, without scoring all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.constants import VOCAL_OVER_INSTRUMENTAL, MatchConfig
from cadenza.functions import scalars as S
from cadenza.operators import pairs, rank
from cadenza.tables import written

#: A total is rounded to 4 decimals, so it can lie so far above the bound of its parts.
_ROUNDED = 5.1e-5


def bounded(features: DataFrame, songs: DataFrame, seed: int, combo: str = VOCAL_OVER_INSTRUMENTAL, role: str = "vocal", config: MatchConfig | None = None) -> DataFrame:
    """The seed's unscored pairs with ``bound``: the most that its tempo and key leave for the total."""
    config = config or MatchConfig()
    named = pairs.with_titles(features, songs)
    top = named.filter(F.col("stem_type") == ("vocals" if combo == VOCAL_OVER_INSTRUMENTAL else "instrumental"))
    bed = named.filter("stem_type = 'instrumental'")
    own = F.col("song_id") == seed
    top, bed = (top.filter(own), bed) if role == "vocal" else (top, bed.filter(own))
    found = pairs.few_pairs(top, bed, combo, config, role)
    tempo = F.when(S.bpm_min_diff(F.col("vocal_bpm"), F.col("inst_bpm")) < 25, S.bpm_score(F.col("vocal_bpm"), F.col("inst_bpm"))).otherwise(0.2)
    most = S.total_score(tempo, S.camelot_score(F.col("vocal_camelot"), F.col("inst_camelot")), F.lit(1.0), F.lit(1.0), config)
    return found.withColumn("bound", most + _ROUNDED if min(config.weights.values(), default=0) >= 0 else F.lit(float("inf")))


def best_matches(features: DataFrame, songs: DataFrame, seed: int, top_k: int = 10, combo: str = VOCAL_OVER_INSTRUMENTAL, role: str = "vocal", config: MatchConfig | None = None) -> tuple[DataFrame, int]:
    """The rows that ``rank.find_matches`` gives for the seed, and how many pairs were scored for them.

    Tempo and key bound the total in a few classes, which are visited best
    first: so many that k pairs are scored, then all whose bound reaches the
    k-th of these. No other pair can be among the best.
    """
    if top_k < 0:
        raise ValueError("a limit can't be negative")
    config = config or MatchConfig()
    known = written(bounded(features, songs, seed, combo, role, config), "bounded")
    classes = sorted(known.groupBy("bound").agg(F.count("*").alias("n")).collect(), reverse=True)  # a few classes of tempo and key
    need, n, least = max(top_k, 1), 0, float("inf")
    for bound, count in classes:
        if n >= need:
            break
        n, least = n + count, bound
    visit = lambda bound: known.filter(F.col("bound") >= bound)
    first = rank.top(pairs.scored(visit(least), combo, config), top_k)
    worst = first.agg(F.count("*").alias("n"), F.min("score_total").alias("worst")).first()
    if worst["n"] >= top_k > 0:
        least = min(least, worst["worst"])
    return rank.top(pairs.scored(visit(least), combo, config), top_k), sum(count for bound, count in classes if bound >= least)
