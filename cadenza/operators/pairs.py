"""Compatible pairs: a theta join of features on a directional tempo range and key compatibility, with scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.constants import INSTRUMENTAL_OVER_INSTRUMENTAL, VOCAL_OVER_INSTRUMENTAL, MatchConfig
from cadenza.functions import scalars as S
from cadenza.tables import written

SIDE = ["song_id", "title", "artist", "bpm", "key", "mode", "camelot", "loudness_rms", "energy"]
#: Up to so many features of one side (about 300 bytes each) are sent to every task; beyond, both sides are shuffled.
BROADCAST_ROWS = 50_000
MOST_CODES = 2_000
#: Rows of a side that a key of a join has at most, pairs that a task tests, about, and the most tasks.
JOIN_CHUNK, JOIN_TESTS, MOST_TASKS = 4_096, 100_000_000, 20_000
#: The longest vectors whose places are added in compiled code.
MOST_PLACES = 32


def with_titles(features: DataFrame, songs: DataFrame) -> DataFrame:
    """features with title and artist; features of unknown songs fall out."""
    return features.join(songs.select(F.col("id").alias("song_id"), "title", "artist"), "song_id")


def sided(features: DataFrame, side: str) -> DataFrame:
    """The columns of one side of a pair, with what its scores need of that side alone: loud, norm, number and letter of the code."""
    number, letter = S.camelot_parts(F.col("camelot"))
    made = {"loud": S.loudness(F.col("loudness_rms"), F.col("energy")), "norm": S.mfcc_norm(F.col("mfcc")), "number": number, "letter": letter}
    more = [c for c in ("row",) if c in features.columns]
    return features.select(*more, *[F.col(c).alias(f"{side}_{c}") for c in [*SIDE, "mfcc"]], *[c.alias(f"{side}_{n}") for n, c in made.items()])


def _orders(combo: str) -> Column:
    a, b = F.col("vocal_song_id"), F.col("inst_song_id")
    return a < b if combo == INSTRUMENTAL_OVER_INSTRUMENTAL else a != b


def passes(config: MatchConfig) -> Column:
    return (S.bpm_min_diff(F.col("vocal_bpm"), F.col("inst_bpm")) <= config.bpm_max) & (_key_score() >= config.key_min)


def _key_score() -> Column:
    return S.camelot_parts_score(*[F.col(f"{side}_{n}") for side in ("vocal", "inst") for n in ("number", "letter")])


def literal_pairs(top: DataFrame, bed: DataFrame, combo: str, config: MatchConfig, known: dict) -> DataFrame:
    """The predicate as it stands: a nested-loop join, best for small inputs. Beyond the broadcast bound both sides are cut into chunks that meet one another."""
    vocal, inst = sided(top, "vocal"), sided(bed, "inst")
    if known["beds"] <= BROADCAST_ROWS:
        return vocal.repartition(tasks_for(vocal.sparkSession, known["tests"], JOIN_TESTS)).join(F.broadcast(inst), _orders(combo) & passes(config))
    one = F.lit(0).alias("all")
    vocal, inst, keys = dealt(vocal.select("*", one, F.col("vocal_song_id").alias("row")), inst.select("*", one, F.col("inst_song_id").alias("row")), ["all"], JOIN_CHUNK, JOIN_TESTS)
    return vocal.drop("row").join(inst.drop("row"), keys).filter(_orders(combo) & passes(config)).drop(*keys)


def key_compat(top: DataFrame, bed: DataFrame, config: MatchConfig) -> DataFrame:
    """(vocal_code, inst_code) of the observed codes that go together; null codes are '?'."""
    codes = lambda df, name: df.select(F.coalesce("camelot", F.lit("?")).alias(name)).distinct()
    return codes(top, "vocal_code").join(codes(bed, "inst_code"), S.camelot_score(F.col("vocal_code"), F.col("inst_code")) >= config.key_min)


def dealt(tops: DataFrame, beds: DataFrame, keys: list[str], chunk: int, task_tests: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of a join by ``keys`` and the keys under which to join them, in tasks of about ``task_tests`` pairs to test.

    A key with more than ``chunk`` rows of a side is cut into chunks by a hash
    of its rows' ``row``; every chunk meets every chunk of the other side once.
    """
    size = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    sizes = written(size(tops, "n").join(size(beds, "m"), keys), "sizes")
    tests = sizes.agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0.0
    large = sizes.filter((F.col("n") > chunk) | (F.col("m") > chunk)).select(*keys, F.ceil(F.col("n") / chunk).alias("ni"), F.ceil(F.col("m") / chunk).alias("nj"))
    at = lambda n: F.pmod(F.xxhash64("row"), F.coalesce(F.col(n), F.lit(1)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(n), F.lit(1)) - 1))
    tasks = tasks_for(tops.sparkSession, tests, task_tests)
    new = [*keys, "i", "j"]
    keyed = lambda df, i, j: df.join(F.broadcast(large), keys, "left").withColumn("i", i).withColumn("j", j).drop("ni", "nj").repartition(tasks, *new)
    return keyed(tops, at("ni"), every("nj")), keyed(beds, every("ni"), at("nj")), new


def tasks_for(spark: SparkSession, tests: float, task_tests: int) -> int:
    """So many tasks that each has about ``task_tests`` of the tests, and all cores some if there is enough to do."""
    few = 3 * spark.sparkContext.defaultParallelism
    return max(1, min(max(few, math.ceil(tests / task_tests)), math.ceil(50 * tests / task_tests), MOST_TASKS))


def banded(tops: DataFrame, beds: DataFrame, top_bpm: str, bed_bpm: str, config: MatchConfig) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``band``: a top's own, and for a bed those within ``bpm_max`` of its tempo, half and twice of it, every band once."""
    width = max(config.bpm_max, 1e-6) * (1 + 1e-9)
    band = lambda x: F.floor(F.least(x / width, F.lit(1e15)))
    around = [band(F.col(bed_bpm) * k) + i for k in (1.0, 0.5, 2.0) for i in (-1, 0, 1)]
    return tops.withColumn("band", band(F.col(top_bpm))), beds.withColumn("band", F.explode(F.array_distinct(F.array(*around))))


def equi_pairs(top: DataFrame, bed: DataFrame, combo: str, config: MatchConfig, by_band: bool, tests: float | None = None) -> DataFrame:
    """Joined by key code over ``key_compat``; ``by_band``: by tempo band too, in chunks of bounded size, so that no task holds more than a band of one code.

    A top lies in one band and a bed in every band that it can match from, so
    no pair comes twice. tests: how many pairs there are to test.
    """
    compat = key_compat(top, bed, config)
    vocal = sided(top, "vocal").filter("vocal_bpm > 0").withColumn("vocal_code", F.coalesce("vocal_camelot", F.lit("?")))
    inst = sided(bed, "inst").filter("inst_bpm > 0").withColumn("inst_code", F.coalesce("inst_camelot", F.lit("?")))
    small = compat.count() <= MOST_CODES
    keys = ["inst_code"]
    if by_band:
        reached = vocal.withColumn("row", F.col("vocal_song_id")).join(F.broadcast(compat) if small else compat, "vocal_code")
        reached, inst = banded(reached, inst.withColumn("row", F.col("inst_song_id")), "vocal_bpm", "inst_bpm", config)
        reached, inst, keys = dealt(reached, inst, ["inst_code", "band"], JOIN_CHUNK, JOIN_TESTS)
        reached, inst = reached.drop("row"), inst.drop("row")
    else:
        vocal = vocal.repartition(tasks_for(vocal.sparkSession, tests or 0.0, JOIN_TESTS))
        reached, inst = vocal.join(F.broadcast(compat) if small else compat, "vocal_code"), F.broadcast(inst)
    return reached.join(inst, keys).filter(_orders(combo) & passes(config)).drop("vocal_code", "inst_code", "band", "i", "j")


def few_pairs(top: DataFrame, bed: DataFrame, combo: str, config: MatchConfig, role: str = "vocal") -> DataFrame:
    """Unscored pairs where one side (role 'vocal': the top) is a seed of a row or two, which is sent to the other side's scan."""
    vocal, inst = sided(top, "vocal"), sided(bed, "inst")
    vocal, inst = (F.broadcast(vocal), inst) if role == "vocal" else (vocal, F.broadcast(inst))
    return vocal.join(inst, _orders(combo) & passes(config))


def pairs(top: DataFrame, bed: DataFrame, combo: str, config: MatchConfig | None = None, strategy: str = "auto", broadcast_rows: int = BROADCAST_ROWS, known: dict | None = None) -> DataFrame:
    """Scored pairs of features (with titles): combo_type, vocal_*, inst_*, score_total, score_bpm, score_key, score_energy, score_timbre.

    strategy: 'literal', 'equi', 'banded', or 'auto', which broadcasts the bed
    only up to ``broadcast_rows``. known: what ``measured`` says of the sides.
    """
    config = config or MatchConfig()
    known = known or measured(top, bed)
    strategy = plan_for(known, strategy, broadcast_rows)
    if strategy == "literal":
        joined = literal_pairs(top, bed, combo, config, known)
    else:
        joined = equi_pairs(top, bed, combo, config, strategy == "banded", known["tests"])
    return scored(joined, combo, config, known["length"])


def scored(joined: DataFrame, combo: str, config: MatchConfig, length: int | None = None) -> DataFrame:
    """The columns of ``pairs`` of unscored ones. length: a usual one of their vectors."""
    c = F.col
    found = joined.withColumn("_apart", S.bpm_min_diff(c("vocal_bpm"), c("inst_bpm")))
    parts = found.select(
        F.lit(combo).alias("combo_type"), *[c(f"{side}_{n}") for side in ("vocal", "inst") for n in SIDE],
        S.bpm_score_of(c("_apart")).alias("score_bpm"), _key_score().alias("score_key"), S.energy_score(c("vocal_loud"), c("inst_loud")).alias("score_energy"),
        S.mfcc_cosine_of(c("vocal_mfcc"), c("inst_mfcc"), c("vocal_norm"), c("inst_norm"), length).alias("score_timbre"),
    )
    return parts.withColumn("score_total", S.total_score(c("score_bpm"), c("score_key"), c("score_energy"), c("score_timbre"), config))


def measured(top: DataFrame, bed: DataFrame) -> dict:
    """beds: how many; tests: pairs of the sides; length: of all vectors that aren't empty, if it is one of at most ``MOST_PLACES``."""
    n = F.when(F.size("mfcc") > 0, F.size("mfcc"))
    sides = top.select(F.lit(1).alias("top"), n.alias("n")).unionAll(bed.select(F.lit(0).alias("top"), n.alias("n")))
    found = sides.agg(F.count("*").alias("all"), F.coalesce(F.sum("top"), F.lit(0)).alias("tops"), F.min("n").alias("least"), F.max("n").alias("most")).first()
    beds = found["all"] - found["tops"]
    return {"beds": beds, "tests": float(found["tops"]) * beds, "length": found["most"] if found["least"] == found["most"] and (found["most"] or MOST_PLACES + 1) <= MOST_PLACES else None}


def plan_for(known: dict, strategy: str = "auto", broadcast_rows: int = BROADCAST_ROWS) -> str:
    """The strategy of ``pairs``; 'auto' goes by the number of beds."""
    if strategy != "auto":
        return strategy
    return "equi" if known["beds"] <= broadcast_rows else "banded"


def score_all(features: DataFrame, songs: DataFrame, config: MatchConfig | None = None, strategy: str = "auto", combos: tuple[str, ...] = (VOCAL_OVER_INSTRUMENTAL, INSTRUMENTAL_OVER_INSTRUMENTAL)) -> DataFrame:
    """Pairs of the kinds asked for: vocals over instrumentals, and instrumentals over instrumentals of higher song id. The sides are measured once for both."""
    named = with_titles(features, songs)
    vocals, beds = named.filter("stem_type = 'vocals'"), named.filter("stem_type = 'instrumental'")
    known = measured(vocals, beds)
    made = [pairs(vocals if combo == VOCAL_OVER_INSTRUMENTAL else beds, beds, combo, config, strategy, known=known) for combo in combos]
    return made[0] if len(made) == 1 else made[0].unionByName(made[1])


def score_changed(features: DataFrame, songs: DataFrame, old_features: DataFrame, old_songs: DataFrame, config: MatchConfig | None = None, strategy: str = "auto") -> DataFrame:
    """Those pairs of ``score_all`` in which a side is new or has changed in a column that pairs are made of.

    Changed sides meet all, and unchanged ones the changed, so no pair comes
    twice. Pairs of which neither side has changed keep their scores.
    """
    read = [*SIDE, "stem_type", "mfcc"]
    now = written(with_titles(features, songs).select(*read), "sides")
    new = written(now.join(with_titles(old_features, old_songs).select(*read).alias("o"), [F.col(f"o.{c}").eqNullSafe(now[c]) for c in read], "left_anti"), "changed")
    same = now.join(new.select("song_id", "stem_type").distinct(), ["song_id", "stem_type"], "left_anti")
    of = lambda rows, kind: rows.filter(F.col("stem_type") == kind)
    found = None
    for kind, combo in (("vocals", VOCAL_OVER_INSTRUMENTAL), ("instrumental", INSTRUMENTAL_OVER_INSTRUMENTAL)):
        for top, bed in ((new, now), (same, new)):
            made = pairs(of(top, kind), of(bed, "instrumental"), combo, config, strategy)
            found = made if found is None else found.unionByName(made)
    return found


def counts(features: DataFrame, songs: DataFrame, config: MatchConfig | None = None) -> DataFrame:
    """(combo_type, scored, skipped): how many ordered pairs passed and failed the filter.

    Skipped is counted from the sides' sizes, so that failing pairs are never made.
    """
    from cadenza.operators import blocks

    named = with_titles(features, songs)
    vocals, beds = named.filter("stem_type = 'vocals'"), named.filter("stem_type = 'instrumental'")
    scored = blocks.counts(features, songs, config)
    per_song = vocals.groupBy("song_id").agg(F.count("*").alias("v")).join(beds.groupBy("song_id").agg(F.count("*").alias("b")), "song_id", "full_outer").na.fill(0)
    sizes = per_song.agg(F.sum("v").alias("v"), F.sum("b").alias("b"), F.sum(F.col("v") * F.col("b")).alias("same"), F.sum(F.col("b") * F.col("b")).alias("mirror")).na.fill(0)
    possible = sizes.select(F.explode(F.array(
        F.struct(F.lit(VOCAL_OVER_INSTRUMENTAL).alias("combo_type"), (F.col("v") * F.col("b") - F.col("same")).alias("n")),
        F.struct(F.lit(INSTRUMENTAL_OVER_INSTRUMENTAL).alias("combo_type"), ((F.col("b") * F.col("b") - F.col("mirror")) / 2).cast("long").alias("n")),
    )).alias("p")).select("p.*")
    return possible.join(scored, "combo_type", "left").na.fill(0).select("combo_type", "scored", (F.col("n") - F.col("scored")).alias("skipped"))
