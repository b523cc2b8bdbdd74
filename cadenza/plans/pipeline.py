"""The stages over a store, and their command line."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.constants import INSTRUMENTAL_OVER_INSTRUMENTAL, STEM_TYPES, VOCAL_OVER_INSTRUMENTAL, MatchConfig
from cadenza.operators import audio, pairs, rank, report, spectrum
from cadenza.operators.store import TABLES, Store, numbered, update_status
from cadenza.sources import acquire, listing, waves
from cadenza.sources.ingest import read_tracks, run_metadata_tool
from cadenza.sources.track_source import tracks_of
from cadenza.tables import written

STAGES = ["ingest", "download", "stems", "analysis", "match"]


def run_ingest(store: Store, path: str | None = None, urls: list[str] | None = None, fetch: Callable[[str], str] = run_metadata_tool) -> DataFrame:
    """Upserts the tracks of JSON lines in files (path), or of what fetch gives for addresses; every one is queued (again)."""
    spark = store.spark
    found = written(read_tracks(spark, path) if path else tracks_of(spark, urls or [], fetch), "tracks")  # the addresses are asked once
    tracks = numbered(found, ["line", "entry"], "seq").drop("line", "entry")
    return store.merge("songs", tracks.withColumn("status", F.lit("queued")).withColumn("raw_path", F.lit("")))


def run_download(store: Store, fetch: acquire.Effect, probe: acquire.Effect, existing: acquire.Effect | None = None, discard: acquire.Effect | None = None) -> DataFrame:
    """Downloads what is queued or failed before; see ``acquire.download``. The effects run once: their outcome is written before songs are changed."""
    got = written(acquire.download(store.read("songs"), fetch, probe, existing, discard), "downloads")
    return store.update("songs", got, acquire.settled)


def run_stems(store: Store, split: acquire.Effect, exists: Callable[[DataFrame], DataFrame] = listing.existing) -> DataFrame:
    """Stems of every song whose raw file exists: those that are there are kept, the others come from split; the raw file is stem 'full'.

    A song is then stemmed, or error where split failed. exists: which of paths are files.
    """
    songs, stems = store.read("songs"), store.read("stems")
    files = written(exists(songs.select(F.col("raw_path").alias("path")).unionByName(stems.select(F.col("file_path").alias("path")))), "files")
    made = written(acquire.separate(songs, stems, split, files), "separated")
    good = made.filter("error is null")
    stems = store.merge("stems", numbered(good.select("song_id", "stem_type", "file_path"), ["song_id", "stem_type"], "seq"))
    status = F.when(F.max("error").isNull(), "stemmed").otherwise("error").alias("status")
    store.update("songs", made.groupBy(F.col("song_id").alias("id")).agg(status).withColumn("raw_path", F.lit("")), update_status)
    return stems


def audio_files(stems: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """The stems to analyse, by song and in the order full, vocals, instrumental; files (path): those that exist, others are skipped (None: all)."""
    order = F.array_position(F.array(*[F.lit(s) for s in STEM_TYPES]), F.col("stem_type"))
    if files is not None:
        stems = stems.join(files.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi")
    return stems.filter(order > 0).orderBy("song_id", order).select("song_id", "stem_type", "file_path")


def wave_features(stems: DataFrame, folder: str, size: int = 65536, seconds: float | None = 30.0) -> DataFrame:
    """Features of stems (song_id, stem_type, file_path) whose files are WAV files below a folder; others have none, unreadable ones an error."""
    chunks = written(waves.load_waves(stems.sparkSession, folder, size, spectrum.RATE, seconds), "chunks")
    named = chunks.join(stems.withColumn("path", waves.plain_path(F.col("file_path"))), "path")
    found = spectrum.analysed(named.filter("samples is not null"), size)
    failed = named.filter("samples is null").select("song_id", "stem_type", F.coalesce("error", F.lit("no samples")).alias("error")).distinct()
    return found.unionByName(failed, allowMissingColumns=True)


def run_analysis(store: Store, backend: acquire.Effect | None = None, files: DataFrame | None = None, folder: str | None = None, exists: Callable[[DataFrame], DataFrame] = listing.existing) -> DataFrame:
    """Features of the stems whose files exist, by a backend or, without one, of the WAV files below a folder; their songs are then analysed.

    files (path): those that exist, where that is known already.
    """
    stems = store.read("stems")
    files = exists(stems.select(F.col("file_path").alias("path"))) if files is None else files
    todo = audio_files(stems, files)
    if backend is None and folder is None:
        raise ValueError("name a backend or a folder of WAV files")
    got = audio.analyse(todo, backend) if backend else wave_features(todo, folder)
    found = written(got, "analysed").filter("error is null").drop("error")
    features = store.merge("features", numbered(found, ["song_id", "stem_type"], "seq"))
    done = found.select(F.col("song_id").alias("id"), F.lit("analysed").alias("status"), F.lit("").alias("raw_path")).distinct()
    store.update("songs", done, update_status)
    return features


def totals(store: Store) -> dict[str, int]:
    """How many rows every table has, and how many songs are in each status."""
    out = {t: store.read(t).count() for t in TABLES}
    return out | {f"songs {r['status']}": r["n"] for r in store.read("songs").groupBy("status").agg(F.count("*").alias("n")).orderBy("status").collect()}


def run_match(store: Store, config: MatchConfig | None = None, incremental: bool = False) -> DataFrame:
    """Scores and upserts all pairs; incremental: only those with a side that is new or changed since the last run, if its features and songs are still there."""
    now = {t: store.manifest(t)["version"] for t in ("features", "songs")}
    then = store.manifest("mashup_candidates").get("matched", {})
    read = lambda v: (store.read("features", v.get("features")).withColumn("mfcc", F.from_json("mfcc_json", "array<double>")), store.read("songs", v.get("songs")))
    if incremental and then and all(v in store.versions(t) for t, v in then.items()):
        scored = pairs.score_changed(*read(now), *read(then), config)
    else:
        scored = pairs.score_all(*read({}), config)
    return store.merge("mashup_candidates", numbered(scored, ["combo_type", "vocal_song_id", "inst_song_id"], "seq"), notes={"matched": now})


def seed_text(store: Store, seed: int, top_k: int = 10) -> str:
    """The seed's best pairs of either kind, as text."""
    song = store.read("songs").filter(F.col("id") == seed).select("title", "artist").first()
    title = f"{song['title']} — {song['artist']}" if song else f"Song #{seed}"
    candidates = store.read("mashup_candidates")
    return "\n".join(report.format_results(rank.find_matches(candidates, seed, top_k, "vocal", c).collect(), title, c) for c in (VOCAL_OVER_INSTRUMENTAL, INSTRUMENTAL_OVER_INSTRUMENTAL))


def parse_args(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description="Catalogue pairing on Spark")
    p.add_argument("--store", required=True)
    p.add_argument("--url", action="append", default=[], help="address to ingest by the metadata tool (may be repeated)")
    p.add_argument("--tracks", help="JSON lines to ingest instead")
    p.add_argument("--audio", help="folder, shared by all executors, for downloads and with the stems' WAV files")
    p.add_argument("--stages", nargs="*", choices=STAGES, help="default: all")
    p.add_argument("--seed", type=int, default=1)
    p.add_argument("--seed-stem", choices=STEM_TYPES, default="vocals", help="accepted; as before, the seed is looked up as the upper layer of either kind")
    p.add_argument("--cand-stem", choices=STEM_TYPES, default="instrumental", help="accepted; see --seed-stem")
    p.add_argument("--top-n", type=int, default=20)
    p.add_argument("--export", "--export-mashups", nargs="?", const="mashup_report", metavar="FILE")
    p.add_argument("--prep", "--prep-session", nargs="?", const="fl_session", metavar="DIR")
    p.add_argument("--db-report", action="store_true", help="print the report and end")
    p.add_argument("--reset", action="store_true")
    return p.parse_args(argv)


def best_files(store: Store, top_n: int) -> DataFrame:
    """(path): the stem files of the best pairs that exist; only their folders are listed."""
    best = rank.top(store.read("mashup_candidates"), top_n)
    songs = best.select(F.explode(F.array("vocal_song_id", "inst_song_id")).alias("song_id")).distinct()
    return listing.existing(store.read("stems").join(songs, "song_id", "left_semi").select(F.col("file_path").alias("path")))


def _exports(store: Store, args: argparse.Namespace) -> None:
    if args.export:
        report.write_report(report.export_rows(store.read("mashup_candidates"), store.read("stems"), best_files(store, args.top_n), args.top_n), args.export)
    if args.prep:
        report.write_sessions(report.session_plan(store.read("mashup_candidates"), store.read("stems"), args.top_n), args.prep)


def main(argv: list[str] | None = None) -> int:
    """Runs the stages asked for (all, if none is named) in their order, then the report and the exports.

    Without an address, tracks and stages, exports run alone. Stems need a
    model that isn't part of this library; the stage takes those that exist.
    """
    args = parse_args(argv)
    spark = SparkSession.builder.appName("cadenza").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = Store(spark, args.store)
    if args.reset:
        store.reset(sure=True)
    show = lambda: print(report.report_text(store.read("songs"), store.read("features"), store.read("mashup_candidates"), args.top_n))
    if args.db_report:
        show()
        return 0
    if (args.export or args.prep) and not (args.url or args.tracks or args.stages):
        _exports(store, args)
        return 0
    stages = args.stages or STAGES
    if "ingest" in stages:
        if not args.tracks and not args.url:
            print("ingest: --url or --tracks is missing")
            return 1
        if run_ingest(store, args.tracks, args.url).isEmpty():
            print("ingest: no songs found")
            return 1
    for stage in ("download", "analysis"):
        if stage in stages and not args.audio:
            print(f"{stage}: skipped, as --audio is missing")
    if "download" in stages and args.audio:
        run_download(store, **acquire.tool_effects(args.audio))
    if "stems" in stages:
        run_stems(store, no_model)
    if "analysis" in stages and args.audio:
        run_analysis(store, folder=args.audio)
    if "match" in stages:
        run_match(store)
        print(seed_text(store, args.seed))
    print("  ".join(f"{k}: {n}" for k, n in totals(store).items()))
    show()
    _exports(store, args)
    return 0


def no_model(row: dict) -> dict:
    """Stands for the separation model, which is handed to ``run_stems`` where there is one."""
    raise RuntimeError("no separation model")


if __name__ == "__main__":
    raise SystemExit(main())
