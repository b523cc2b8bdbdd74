"""Blocks of pairs in NumPy against the pairs that a nested-loop join makes and scores."""

import random

import pytest
from pyspark.sql import functions as F

from cadenza.constants import INSTRUMENTAL_OVER_INSTRUMENTAL, VOCAL_OVER_INSTRUMENTAL, MatchConfig
from cadenza.functions import scalars as S
from cadenza.operators import blocks, pairs, rank
from cadenza.plans import queries

SF = "/root/testdata/sf0.001"
FEATURES = "song_id long, stem_type string, bpm double, key string, mode string, camelot string, loudness_rms double, energy double, mfcc array<double>"


@pytest.fixture(scope="module")
def odd(spark):
    """Songs with unknown, zero, repeated and missing values; tempos at the exact bounds, some rows twice."""
    draw, rows = random.Random(4), []
    vectors = [None, [], [0.0, 0.0, 0.0], [1.0, None, 2.0], [1.0, 2.0, 2.0], [2.0, 4.0, 4.0], [-1.0, -2.0, -2.0]]
    for song in range(30):
        for stem in ("full", "vocals", "instrumental"):
            vector = draw.choice(vectors) if song % 3 else [draw.gauss(0, 1) for _ in range(3)]
            row = (song, stem, draw.choice([None, 0.0, -5.0, 65.0, 70.0, 75.1, 85.1, 130.0, 140.0, 150.3, 60 + draw.randrange(1200) / 10]), "C", "major", draw.choice([None, "?", "", "8B", "9B", "8A", "10B", "12B", "1B", "13x"]),
                   draw.choice([None, 0.0, -1.0, 0.2, 0.2, draw.random()]), draw.choice([None, 0.0, 3.0, draw.random()]), vector)
            rows += [row] * (1 + (song == 7))
    songs = spark.createDataFrame([(i, f"T{i}", "A") for i in range(28)], "id long, title string, artist string")
    return spark.createDataFrame(rows, FEATURES).cache(), songs


@pytest.fixture
def small(monkeypatch):
    """Chunks and blocks of a few rows."""
    monkeypatch.setattr(blocks, "CHUNK", 6)
    monkeypatch.setattr(blocks, "CELLS", 40)
    monkeypatch.setattr(pairs, "JOIN_CHUNK", 9)


CONFIGS = [MatchConfig(), MatchConfig(bpm_max=40.0, key_min=0.25, weights={"bpm": 0.1, "key": 0.2, "timbre": 0.7}), MatchConfig(bpm_max=0.0, key_min=0.5, weights={"bpm": -1.0, "key": 0.5, "energy": 0.5, "timbre": -0.5})]


@pytest.mark.parametrize("config", CONFIGS)
def test_counts_and_sums_are_those_of_all_pairs(spark, odd, small, config):
    every = pairs.score_all(*odd, config, "literal").groupBy("combo_type").agg(F.count("*").alias("n"), F.round(F.avg("score_total"), 9).alias("m"))
    expected = sorted(map(tuple, every.collect()))
    assert len(expected) == 2
    assert sorted(map(tuple, blocks.summary(*odd, config).select("combo_type", "n_pairs", F.round("mean_total", 9)).collect())) == expected
    assert sorted(map(tuple, blocks.counts(*odd, config).collect())) == [x[:2] for x in expected]


@pytest.mark.parametrize("config", CONFIGS)
@pytest.mark.parametrize("most", [7])
def test_best_holds_the_first_of_all_pairs(spark, odd, small, config, most):
    shown = ["combo_type", "vocal_song_id", "inst_song_id", "vocal_title", "score_total", "score_bpm", "score_key", "score_energy", "score_timbre"]
    every = pairs.score_all(*odd, config, "literal").cache()
    found = blocks.best(*odd, most, config).cache()
    assert found.columns == every.columns
    for cut in (lambda df: rank.top(df, most), lambda df: rank.top(df.filter(F.col("combo_type") == INSTRUMENTAL_OVER_INSTRUMENTAL), most), lambda df: rank.at_least(df, 0.6, most)):
        assert [tuple(r) for r in cut(found).select(*shown).collect()] == [tuple(r) for r in cut(every).select(*shown).collect()]


def test_values_that_are_no_numbers(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, s, b, "C", "major", "8B", e, 1.0, [v, 1.0]) for i, (b, e, v) in enumerate([(100.0, nan, 1.0), (100.0, 0.5, nan), (101.0, inf, 2.0), (102.0, inf, inf), (nan, 1.0, 1.0), (inf, 1.0, 1.0), (103.0, 0.3, 3.0)]) for s in ("vocals", "instrumental")]
    f, songs = spark.createDataFrame(rows, FEATURES), spark.createDataFrame([(i, "T", "A") for i in range(7)], "id long, title string, artist string")
    every = pairs.score_all(f, songs, None, "literal").cache()
    assert every.filter(F.isnan("score_total")).count() > 0
    number = lambda df: [(a, b, c, repr(x)) for a, b, c, x in df.select("combo_type", "vocal_song_id", "inst_song_id", "score_total").collect()]
    assert number(rank.top(blocks.best(f, songs, 9), 9)) == number(rank.top(every, 9))
    sums = lambda df, n, m: sorted((r["combo_type"], r[n], repr(r[m])) for r in df.collect())
    assert sums(blocks.summary(f, songs), "n_pairs", "mean_total") == sums(every.groupBy("combo_type").agg(F.count("*").alias("n"), F.avg("score_total").alias("m")), "n", "m")


def test_vectors_of_different_lengths_are_an_error(spark):
    rows = [(i, s, 100.0, "C", "major", "8B", 0.5, 1.0, [1.0] * (1 + i)) for i in range(2) for s in ("vocals", "instrumental")]
    f, songs = spark.createDataFrame(rows, FEATURES), spark.createDataFrame([(i, "T", "A") for i in range(2)], "id long, title string, artist string")
    for made in (lambda: blocks.summary(f, songs), lambda: blocks.best(f, songs, 3), lambda: pairs.score_all(f, songs)):
        with pytest.raises(Exception, match="different lengths"):
            made().collect()


def test_no_side_at_all(spark, odd):
    f = odd[0].filter("stem_type = 'full'")
    assert blocks.counts(f, odd[1]).count() == blocks.summary(f, odd[1]).count() == blocks.best(f, odd[1], 3).count() == 0
    assert blocks.best(*odd, 0).count() >= 0 and rank.top(blocks.best(*odd, 0), 0).count() == 0


def test_rounding_is_that_of_decimals(spark):
    draw = random.Random(1)
    values = [draw.uniform(-2, 2) for _ in range(3000)] + [k / 20_000 for k in range(-300, 300)] + [(k + 0.5) / 1e6 for k in range(300)] + [1e300, 1e12 + 0.00005, -0.00001, 0.0, float("nan"), float("inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "x double").select(*[f(F.col("x"), n).alias(f"{name}{n}") for n in (4, 6) for name, f in (("a", F.round), ("b", S.rounded))])
    assert all(repr(r["a4"]) == repr(r["b4"]) and repr(r["a6"]) == repr(r["b6"]) for r in df.collect())


@pytest.mark.parametrize("name", ["all_pairs_by_combo", "candidates_min_score"])
def test_no_join_makes_all_pairs(spark, monkeypatch, name):
    """Rows of pairs are made only of the few that blocks have found."""
    made = []
    monkeypatch.setattr(pairs, "pairs", lambda *a, **k: made.append(a))
    assert queries.__dict__[name](spark, SF).count() > 0 and not made


@pytest.mark.parametrize("strategy", ["literal", "equi", "banded"])
def test_pairs_of_one_file_are_spread_over_tasks(spark, tmp_path, strategy):
    """A side read by one task isn't joined by one task."""
    rows = spark.range(3000).coalesce(1)
    rows.select(F.col("id").alias("song_id"), F.expr("explode(array('vocals', 'instrumental'))").alias("stem_type"), (60.0 + F.col("id") % 997 / 7).alias("bpm"), F.lit("C").alias("key"), F.lit("major").alias("mode"), F.lit("8B").alias("camelot"),
                F.lit(0.5).alias("loudness_rms"), F.lit(1.0).alias("energy"), F.array(F.lit(1.0), F.col("id") * 1.0).alias("mfcc")).write.parquet(f"{tmp_path}/f")
    rows.select("id", F.lit("T").alias("title"), F.lit("A").alias("artist")).write.parquet(f"{tmp_path}/s")
    read = lambda n: spark.read.parquet(f"{tmp_path}/{n}").coalesce(1)
    made = pairs.score_all(read("f"), read("s"), None, strategy, (VOCAL_OVER_INSTRUMENTAL,))
    assert made.groupBy(F.spark_partition_id()).count().count() >= 4


def test_scoring_is_left_out_of_the_joins_method(spark):
    """Java doesn't compile a method of over 8,000 bytes; the join's loop had 10,827 with the scores in it."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = [queries.vocal_over_instrumental(spark, SF), queries.vocal_over_instrumental_literal(spark, SF)]
        parts = [df._jdf.queryExecution().debug().codegenToSeq() for df in made]
        assert max(x.apply(i)._3().maxMethodCodeSize() for x in parts for i in range(x.size())) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("strategy", ["literal", "banded"])
def test_sides_in_chunks_make_the_same_pairs(spark, odd, small, monkeypatch, strategy):
    shown = ["combo_type", "vocal_song_id", "inst_song_id", "score_total"]
    expected = sorted(map(repr, pairs.score_all(*odd, None, "literal").select(*shown).collect()))
    monkeypatch.setattr(pairs, "BROADCAST_ROWS", 3)
    assert sorted(map(repr, pairs.score_all(*odd, None, strategy).select(*shown).collect())) == expected
