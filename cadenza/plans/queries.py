"""Queries over the derived catalogue, one or more for every operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.constants import CAMELOT_MAJOR, CAMELOT_MINOR, INSTRUMENTAL_OVER_INSTRUMENTAL, KEY_NAMES, SEMITONES, STATUSES, VOCAL_OVER_INSTRUMENTAL
from cadenza.functions import scalars as S
from cadenza.operators import audio, blocks, pairs, rank, report, seeds, spectrum, store
from cadenza.plans.fixtures import candidates, features, songs, stems, table
from cadenza.sources import acquire, ingest
from cadenza.tables import written

c = F.col
SCORES = ["score_total", "score_bpm", "score_key", "score_energy", "score_timbre"]


def _round_scores(df: DataFrame) -> DataFrame:
    """Component scores to 6 decimals, as engines differ in the last bit of exp and sqrt."""
    return df.withColumns({n: S.rounded(c(n), 6) for n in SCORES if n in df.columns})


def _short(df: DataFrame) -> DataFrame:
    return _round_scores(df.select("combo_type", "vocal_song_id", "inst_song_id", "vocal_title", "inst_title", "vocal_bpm", "inst_bpm", "vocal_camelot", "inst_camelot", *SCORES))


def songs_scan(spark, sf):
    return songs(spark, sf).orderBy("id")


def work_queue(spark, sf):
    return acquire.work_queue(songs(spark, sf)).select("id", "title", "status")


def features_for_song(spark, sf):
    rows = features(spark, sf).withColumn("mfcc_json", F.to_json("mfcc")).filter((c("song_id") == 42) & (c("stem_type") == "full"))
    return rows.select("song_id", "stem_type", "bpm", "camelot", F.size(F.from_json("mfcc_json", "array<double>")).alias("n_mfcc"), F.round(F.get(F.from_json("mfcc_json", "array<double>"), F.lit(0)), 6).alias("first_mfcc")).limit(1)


def features_with_titles(spark, sf):
    return pairs.with_titles(features(spark, sf), songs(spark, sf)).filter("stem_type = 'vocals'").drop("mfcc")


def _dealt(spark: SparkSession, sf: str, first: list, second: list) -> DataFrame:
    """(event_id, a, b): two values for every event, so that all combinations come in turn."""
    n = len(first)
    pick = lambda values, i: F.get(F.array(*[F.lit(v).cast("string") for v in values]), i.cast("int"))
    return table(spark, sf, "events").select("event_id", pick(first, c("event_id") % n).alias("a"), pick(second, F.floor(c("event_id") / n) % len(second)).alias("b"))


def semitone_shift_matrix(spark, sf):
    keys = [*SEMITONES, "H", "", None]
    return _dealt(spark, sf, keys, keys).select("event_id", c("a").alias("vocal_key"), c("b").alias("inst_key"), S.semitone_shift(c("a"), c("b")).alias("semitone_shift"))


def camelot_lookup(spark, sf):
    rows = _dealt(spark, sf, KEY_NAMES, ["major", "minor", "dorian"])
    return rows.select("event_id", c("a").alias("key"), c("b").alias("mode"), S.camelot_of(c("event_id") % 12, c("b")).alias("camelot"))


def camelot_score_matrix(spark, sf):
    codes = [*CAMELOT_MAJOR, *CAMELOT_MINOR, "", "?", "8b", "B", "13B", None]
    return _dealt(spark, sf, codes, codes).select("event_id", c("a").alias("c1"), c("b").alias("c2"), S.camelot_score(c("a"), c("b")).alias("score"))


def _neighbours(spark, sf) -> DataFrame:
    """Each song's vocals beside the instrumental of the song 7 ids on."""
    f = features(spark, sf)
    a = f.filter("stem_type = 'vocals'").select("song_id", c("bpm").alias("b1"), S.loudness(c("loudness_rms"), c("energy")).alias("e1"), c("mfcc").alias("m1"))
    b = f.filter("stem_type = 'instrumental'").select((c("song_id") - 7).alias("song_id"), c("bpm").alias("b2"), S.loudness(c("loudness_rms"), c("energy")).alias("e2"), c("mfcc").alias("m2"))
    return a.join(b, "song_id")


def bpm_score_pairs(spark, sf):
    return _neighbours(spark, sf).select("song_id", F.round(S.bpm_min_diff(c("b1"), c("b2")), 6).alias("min_diff"), F.round(S.bpm_score(c("b1"), c("b2")), 6).alias("score"))


def energy_score_pairs(spark, sf):
    return _neighbours(spark, sf).select("song_id", F.round(S.energy_score(c("e1"), c("e2")), 6).alias("score"))


def mfcc_cosine_pairs(spark, sf):
    return _neighbours(spark, sf).select("song_id", F.round(S.mfcc_cosine(c("m1"), c("m2")), 6).alias("score"))


def pair_filter_counts(spark, sf):
    return pairs.counts(features(spark, sf), songs(spark, sf))


def vocal_over_instrumental(spark, sf):
    return _short(candidates(spark, sf, combo=VOCAL_OVER_INSTRUMENTAL))


def vocal_over_instrumental_banded(spark, sf):
    """The plan for inputs beyond the broadcast bound; same rows."""
    return _short(candidates(spark, sf, "banded", VOCAL_OVER_INSTRUMENTAL))


def vocal_over_instrumental_literal(spark, sf):
    return _short(candidates(spark, sf, "literal", VOCAL_OVER_INSTRUMENTAL))


def instrumental_over_instrumental(spark, sf):
    return _short(candidates(spark, sf, combo=INSTRUMENTAL_OVER_INSTRUMENTAL))


def all_pairs_by_combo(spark, sf):
    return blocks.summary(features(spark, sf), songs(spark, sf)).withColumn("mean_total", F.round("mean_total", 6))


def _best(spark, sf, most: int, combos=blocks.BOTH) -> DataFrame:
    """The first ``most`` pairs of each kind, and a few others."""
    return blocks.best(features(spark, sf), songs(spark, sf), most, None, combos)


def candidates_min_score(spark, sf):
    return _short(rank.at_least(_best(spark, sf, 100), 0.8, 100))


def candidates_for_song_vocal(spark, sf):
    return _short(rank.for_song(candidates(spark, sf, combo=VOCAL_OVER_INSTRUMENTAL), 5, "vocal", VOCAL_OVER_INSTRUMENTAL))


def candidates_for_song_inst(spark, sf):
    return _short(rank.for_song(candidates(spark, sf), 5, "inst"))


def find_matches_topk(spark, sf):
    return _short(rank.find_matches(candidates(spark, sf, combo=VOCAL_OVER_INSTRUMENTAL), 5, 10, "vocal", VOCAL_OVER_INSTRUMENTAL))


def find_matches_pruned(spark, sf):
    """As ``find_matches_topk``, from the features by bounds."""
    return _short(seeds.best_matches(features(spark, sf), songs(spark, sf), 5, 10)[0])


def score_changed_pairs(spark, sf):
    """Pairs to score anew after every hundredth song has another tempo."""
    old = features(spark, sf)
    new = old.withColumn("bpm", F.when(c("song_id") % 100 == 5, c("bpm") + 1.0).otherwise(c("bpm")))
    return _short(pairs.score_changed(new, songs(spark, sf), old, songs(spark, sf)))


def seed_title(spark, sf):
    """Titles of two seeds, one of them missing."""
    seeds = spark.createDataFrame([(5,), (-1,)], "seed long")
    named = seeds.join(songs(spark, sf), c("seed") == c("id"), "left")
    return named.select("seed", F.when(c("id").isNull(), F.concat(F.lit("Song #"), c("seed"))).otherwise(F.concat("title", F.lit(" — "), "artist")).alias("title"))


def db_report_top20(spark, sf):
    return report.report_pairs(_best(spark, sf, 20), 20)


def db_report_features(spark, sf):
    return report.report_features(songs(spark, sf), features(spark, sf)).select("id", "title", "artist", "status", "stem_type", "bpm", "key", "mode", "camelot", "loudness_rms", "energy")


def export_rows(spark, sf):
    files = stems(spark, sf).filter("song_id % 5 <> 0").select(c("file_path").alias("path"))
    return _round_scores(report.export_rows(_best(spark, sf, 20), stems(spark, sf), files, 20))


def session_plan(spark, sf):
    return report.session_plan(_best(spark, sf, 10, (VOCAL_OVER_INSTRUMENTAL,)), stems(spark, sf), 10).select("rank", "folder", "vocal_song_id", "inst_song_id", "bpm_stretch_ratio", "semitone_shift", "vocal_wav_path", "inst_wav_path")


def format_results_text(spark, sf):
    rows = rank.find_matches(candidates(spark, sf, combo=VOCAL_OVER_INSTRUMENTAL), 5, 10, "vocal", VOCAL_OVER_INSTRUMENTAL).collect()
    text = report.format_results(rows, "Seed", VOCAL_OVER_INSTRUMENTAL)
    return spark.createDataFrame([(i, x) for i, x in enumerate(text.split("\n"))], "line int, text string")


def _song_batch(spark, sf) -> DataFrame:
    """Pages as tracks: some addresses are old songs', some come twice, some are empty."""
    p = table(spark, sf, "pages")
    url = F.when(c("page_id") % 17 == 0, "").otherwise(F.concat(F.lit("https://example.invalid/t/"), (c("page_id") * 3 % 400 * 13).cast("string")))
    path = F.when(c("page_id") % 2 == 0, "").otherwise(F.concat(F.lit("/new/"), c("page_id").cast("string")))
    return p.select(F.concat(F.lit("T"), c("page_id").cast("string")).alias("title"), F.lit("A").alias("artist"), F.lit("g").alias("genre"), url.alias("source_url"), c("page_id").cast("double").alias("duration_secs"),
                    F.lit("queued").alias("status"), path.alias("raw_path"), S.duration_str(c("page_id").cast("double")).alias("duration_str"), c("page_id").alias("seq"))


def upsert_song(spark, sf):
    return store.upsert_songs(songs(spark, sf), _song_batch(spark, sf))


def upsert_stem(spark, sf):
    batch = table(spark, sf, "embeddings").select((c("vec_id") * 5 + 1).alias("song_id"), F.lit("vocals").alias("stem_type"), F.concat(F.lit("/v2/"), c("vec_id").cast("string")).alias("file_path"), c("vec_id").alias("seq"))
    return store.upsert_stems(stems(spark, sf), batch)


def upsert_features(spark, sf):
    old = features(spark, sf).drop("mfcc")
    batch = old.filter("song_id % 3 = 0").select((c("song_id") * 2).alias("song_id"), "stem_type", (c("bpm") + 1).alias("bpm"), "camelot", "loudness_rms", "energy", "key", "mode", c("id").alias("seq"))
    return store.upsert_features(old, batch)


def upsert_candidate(spark, sf):
    found = candidates(spark, sf).drop("vocal_key", "vocal_mode", "inst_key", "inst_mode")
    old = found.filter("vocal_song_id % 2 = 0").withColumn("id", c("vocal_song_id") * 10_000_000 + c("inst_song_id") * 2 + (c("combo_type") == VOCAL_OVER_INSTRUMENTAL).cast("long")).withColumn("vocal_title", F.lit("old")).withColumn("score_total", F.lit(0.0))
    batch = found.filter("vocal_song_id % 4 <> 2").withColumn("seq", F.struct("combo_type", "vocal_song_id", "inst_song_id"))
    merged = store.upsert_candidates(old, batch)
    return _round_scores(merged.select("id", "combo_type", "vocal_song_id", "inst_song_id", "vocal_title", *SCORES))


def update_status(spark, sf):
    changes = songs(spark, sf).filter("id % 4 = 0").select("id", F.lit("stemmed").alias("status"), F.when(c("id") % 8 == 0, "").otherwise(F.concat(F.lit("/new/"), c("id").cast("string"))).alias("raw_path"))
    return store.update_status(songs(spark, sf), changes).select("id", "status", "raw_path")


def update_duration(spark, sf):
    changes = songs(spark, sf).filter("id % 4 = 0").select("id", (c("duration_secs") * 20).alias("duration_secs"))
    return store.update_duration(songs(spark, sf), changes).select("id", "duration_secs", "duration_str")


def migrate_columns(spark, sf):
    return store.add_missing(songs(spark, sf).drop("duration_str"))


def stem_map(spark, sf):
    return store.stem_map(stems(spark, sf)).select("song_id", F.concat_ws(";", F.transform(F.map_entries("stems"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias("stems"))


def existing_files(spark, sf):
    """Songs whose audio exists and that have a stem."""
    s = songs(spark, sf)
    files = s.filter("id % 3 <> 0").select(c("raw_path").alias("path"))
    return acquire.with_files(s, files).join(stems(spark, sf).select(c("song_id").alias("id")).distinct(), "id", "left_semi").select("id", "raw_path")


def normalise_tracks(spark, sf):
    info = F.to_json(F.struct(F.concat(F.lit("T"), c("page_id").cast("string")).alias("title"), F.when(c("page_id") % 3 == 0, "").otherwise("up").alias("uploader"), F.lit("ch").alias("channel"), c("url").alias("webpage_url"),
                              (c("page_id") * 1.5).alias("duration"), (c("page_id") + 0.9).alias("like_count"), F.concat(c("page_id").cast("string"), F.when(c("page_id") % 2 == 0, ".9").otherwise("")).alias("view_count"), (c("page_id") % 2 == 0).alias("repost_count")))
    lines = table(spark, sf, "pages").select(c("page_id").alias("line"), F.when(c("page_id") % 7 == 0, "{bad").when(c("page_id") % 11 == 0, F.concat(F.lit('{"_type":"playlist","entries":[null,7,'), info, F.lit("]}"))).otherwise(info).alias("value"))
    return ingest.normalise(lines).drop("entry")


def duration_strings(spark, sf):
    return table(spark, sf, "events").select("event_id", S.duration_str(c("value") * 50 - 10).alias("text"))


def safe_names(spark, sf):
    t = F.concat("text", F.lit(" - (é)"))
    a = F.concat(F.lit("Ça va? "), c("source"))
    return table(spark, sf, "documents").select("doc_id", S.file_name_part(t).alias("file_part"), S.stem_file_name(t, a, "vocals").alias("stem_name"), S.folder_name_part(t).alias("folder"))


def clean_titles(spark, sf):
    title = F.concat("p_name", F.lit(" (Official) [HD] "), c("p_partkey").cast("string"))
    return table(spark, sf, "part").select("p_partkey", S.clean_title(title).alias("title"))


def youtube_like_urls(spark, sf):
    u = F.when(c("page_id") % 4 == 0, F.concat(F.lit(" HTTPS://YouTu.be/"), c("page_id").cast("string"))).when(c("page_id") % 4 == 1, F.concat(F.lit("ytsearch5:"), c("url"))).otherwise(c("url"))
    return table(spark, sf, "pages").select("page_id", S.is_youtube_like(u).alias("is_youtube"))


def search_plan(spark, sf):
    return acquire.search_plan(songs(spark, sf))


def attempt_ladder_first_success(spark, sf):
    s = songs(spark, sf).withColumn("source_url", F.when(c("id") % 2 == 0, F.lit("https://youtu.be/x")).otherwise(c("source_url")))
    plan = acquire.attempt_plan(s.select("id", "source_url")).withColumn("ok", (c("id") + c("ord")) % 3 == 2)
    return acquire.first_success(plan, ["id"], "ord", "ok").select("id", "ord", "label", "format", "extractor_args", "use_cookies")


def fallback_search_first_long(spark, sf):
    plan = acquire.search_plan(songs(spark, sf)).withColumn("duration_secs", (c("id") * 7 + c("query_ord") * 5 + c("result_rank") * 3) % 40 + F.lit(0.0))
    return acquire.first_long_result(plan).select("id", "query_ord", "result_rank", "duration_secs")


def preview_decision(spark, sf):
    secs = S.probed_duration(F.when(c("event_id") % 3 == 0, c("value")), c("event_id") * 1000)
    origin = F.get(F.array(*[F.lit(x) for x in ("existing", "fresh", "fallback")]), (c("event_id") % 3).cast("int"))
    odd = F.get(F.array(*[F.lit(x) for x in ("fresh", "fallback", "existing")]), (c("event_id") % 3).cast("int"))
    return table(spark, sf, "events").select("event_id", S.download_state(origin, secs).alias("state"), S.download_state(odd, secs).alias("other_state"))


def key_detection(spark, sf):
    chroma = F.transform(F.slice("embedding", 1, 12), lambda x: F.abs(x.cast("double")))
    return table(spark, sf, "embeddings").select("vec_id", audio.detect_key(chroma).alias("k")).select("vec_id", "k.*")


def rms_zcr(spark, sf):
    samples = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(audio.rms(samples), 6).alias("rms"), F.round(audio.zero_crossing_rate(samples), 6).alias("zcr"))


def frame_rms_zcr(spark, sf):
    samples = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(audio.frame_rms(samples, 16, 4), 6).alias("rms"), F.round(audio.frame_zero_crossing_rate(samples, 16, 4), 6).alias("zcr"))


def frame_energy(spark, sf):
    samples = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(audio.frame_energy(samples, 16, 4), 6).alias("energy"))


def _chunks(spark: SparkSession, sf: str, size: int) -> DataFrame:
    """Embeddings as signals, cut into chunks."""
    return spectrum.chunked(table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("samples")), size, ("vec_id",))


def _frames(spark: SparkSession, sf: str, hop: int) -> DataFrame:
    return written(spectrum.spectra(_chunks(spark, sf, 16), 16, 8000, 16, hop, 6, ("vec_id",)), "frames")


def spectral_shape(spark, sf):
    frames = spectrum.spectra(_chunks(spark, sf, 16), 16, 8000, 16, 4, 6, ("vec_id",))
    return frames.groupBy("vec_id").agg(*[F.round(F.avg(n), 6).alias(n) for n in ("energy", "centroid", "rolloff")])


def mfcc_means(spark, sf):
    found = spectrum.mfcc(spectrum.decibels(_frames(spark, sf, 4), ("vec_id",)), 6, 5, ("vec_id",))
    return found.select("vec_id", F.posexplode("mfcc").alias("k", "v")).select("vec_id", "k", (F.round("v", 4) + 0.0).alias("value"))


def chroma_means(spark, sf):
    found = spectrum.chroma(_chunks(spark, sf, 32), 32, 64, 32, 8, 4.0, 2, 0.0, ("vec_id",))
    return found.select("vec_id", F.posexplode("chroma").alias("class", "v")).select("vec_id", "class", F.round("v", 6).alias("value"))


def beat_periods(spark, sf):
    envelopes = spectrum.onsets(spectrum.decibels(_frames(spark, sf, 1), ("vec_id",)), ("vec_id",))
    return spectrum.rhythm(envelopes, 8, 1, ("vec_id",)).select("vec_id", "lag")


def _attempted(row: dict) -> dict:
    """A made-up download tool: the fallback's results exist unless the id divides by 5, even ids' own addresses work at once."""
    if row.get("query"):
        return {"path": f"/alt/{row['id']}/{row['query_ord']}/{row['result_rank']}"} if row["id"] % 5 and row["ord"] == 0 else {}
    return {"path": f"/new/{row['id']}/{row['ord']}"} if row["id"] % 2 == 0 else {}


def _probed(got: dict) -> dict:
    _, kind, song, *rest = got["path"].split("/")
    if kind == "old":
        return {"secs": 20.0 if int(song) % 2 == 0 else 200.0}
    if kind == "new":
        return {"secs": 30.0 if int(song) % 3 == 0 else 180.0}
    return {"secs": 36.0 if (5 * int(rest[0]) + int(rest[1]) + int(song)) % 11 == 0 else 10.0}


def download_outcomes(spark, sf):
    """Files there already, fresh downloads, previews with their search fallback, failures; and what they change in the songs."""
    got = acquire.download(songs(spark, sf), _attempted, _probed, lambda row: {"path": f"/old/{row['id']}"} if row["id"] % 7 == 0 else {})
    todo = acquire.work_queue(songs(spark, sf))
    return acquire.settled(todo, got).select("id", "raw_path", "status", "duration_secs")


def bpm_confidence(spark, sf):
    per_user = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("beats"), F.sum(F.floor(c("value") * 10)).alias("samples"))
    return per_user.select("user_id", F.round(S.bpm_confidence(c("beats"), c("samples")), 6).alias("confidence"))


def mfcc_json_roundtrip(spark, sf):
    f = features(spark, sf).withColumn("back", F.from_json(F.to_json("mfcc"), "array<double>"))
    return f.select("id", F.coalesce(F.size("back"), F.lit(-1)).alias("n"), F.coalesce(c("back") == c("mfcc"), c("mfcc").isNull()).alias("same"))


def status_counts(spark, sf):
    """How many songs are at each step of the state machine."""
    known = F.array(*[F.lit(s) for s in STATUSES])
    return songs(spark, sf).groupBy("status").agg(F.count("*").alias("n")).withColumn("step", F.array_position(known, c("status")))
