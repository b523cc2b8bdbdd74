"""Audio files and tools outside Spark: what to run is planned in columns, effects are passed in as functions.

An effect runs once a row inside ``mapInPandas``; it gets a dict and returns a
dict, and a raised error becomes the row's ``error``.
"""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.constants import ATTEMPTS, PREVIEW_KB, PREVIEW_SECS, SEARCH_RESULTS
from cadenza.functions import scalars as S
from cadenza.operators.store import update_duration, update_status

Effect = Callable[[dict], dict]
LADDER = [dict(zip(("ord", "label", "format", "extractor_args", "use_cookies"), (i, *a))) for i, a in enumerate(ATTEMPTS)]


def run_effect(rows: DataFrame, effect: Effect, schema: str) -> DataFrame:
    """rows with the columns of schema, as the effect returns them for each row, and error (null: none)."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.to_dict("records"):
                try:
                    found = effect(row) | {"error": None}
                except Exception as e:  # any failure of an outside tool belongs to its row
                    found = {"error": f"{type(e).__name__}: {e}"}
                out.append(row | {n: found.get(n) for n in [*names, "error"]})
            yield pd.DataFrame(out, columns=[*part.columns, *names, "error"])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{own}, {schema}, error string")


def work_queue(songs: DataFrame) -> DataFrame:
    """Songs to download: queued ones and earlier failures."""
    return songs.filter(F.col("status").isin("queued", "error"))


def with_files(songs: DataFrame, files: DataFrame) -> DataFrame:
    """Songs whose raw_path is among files (path)."""
    return songs.filter("raw_path <> ''").join(files.select(F.col("path").alias("raw_path")).distinct(), "raw_path", "left_semi")


def attempt_plan(songs: DataFrame) -> DataFrame:
    """Every song's ordered download attempts: four for video-site addresses, else one without their extractor arguments."""
    plain = F.transform(F.slice(S.attempts(), 1, 1), lambda a: a.withField("extractor_args", F.lit("")))
    ladder = F.when(S.is_youtube_like(F.col("source_url")), S.attempts()).otherwise(plain)
    return songs.withColumn("attempt", F.explode(ladder)).select(*songs.columns, "attempt.*")


def first_success(attempts: DataFrame, keys: list[str], order: str, ok: str) -> DataFrame:
    """For every key that has one, its first successful row."""
    good = attempts.filter(ok)
    rest = [c for c in attempts.columns if c not in keys]
    return good.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_first")).select(*keys, "_first.*")


def search_plan(songs: DataFrame) -> DataFrame:
    """(id, query_ord, query, result_rank): fallback searches and the results to try, in order."""
    queries = songs.select("id", F.posexplode(S.search_queries(F.col("title"), F.col("artist"))).alias("query_ord", "query"))
    return queries.withColumn("result_rank", F.explode(F.sequence(F.lit(1), F.lit(SEARCH_RESULTS))))


def first_long_result(results: DataFrame) -> DataFrame:
    """The first result (by query_ord, result_rank) of every id that is longer than a preview."""
    order = Window.partitionBy("id").orderBy("query_ord", "result_rank")
    return results.filter(F.col("duration_secs") > PREVIEW_SECS).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def download_arguments(url: str, target: str, fmt: str, extractor_args: str = "", use_cookies: bool = False, item: int | None = None) -> list[str]:
    """The download tool's command line."""
    out = ["yt-dlp", "-f", fmt, "--extract-audio", "--audio-format", "mp3", "--audio-quality", "0", "-o", target]
    out += ["--extractor-args", extractor_args] if extractor_args else []
    out += ["--cookies-from-browser", "chrome"] if use_cookies else []
    out += ["--playlist-items", str(item)] if item else ["--no-playlist"]
    return [*out, url]


def clean_outputs(target: Path) -> None:
    """Deletes what a tool left under the target's stem; what can't be deleted stays."""
    for path in target.parent.glob(f"{target.stem}.*"):
        try:
            path.unlink()
        except OSError:
            pass


def run_download_tool(row: dict, target: Path, run: Callable = subprocess.run, seconds: int = 300) -> dict:
    """One attempt: cleans up, runs the download tool and gives the target's path and size; a file of its stem is renamed to it. {}: failed.

    row: source_url or query (with result_rank), format, extractor_args, use_cookies.
    """
    clean_outputs(target)
    argv = download_arguments(row.get("query") or row["source_url"], f"{target.with_suffix('')}.%(ext)s", row["format"], row.get("extractor_args") or "", bool(row.get("use_cookies")), row.get("result_rank"))
    try:
        done = run(argv, capture_output=True, text=True, timeout=seconds)
    except (FileNotFoundError, subprocess.TimeoutExpired):
        return {}
    if done.returncode:
        return {}
    if not target.exists():
        found = next(iter(sorted(target.parent.glob(f"{target.stem}.*"))), None)
        if found is None:
            return {}
        found.rename(target)
    return {"path": str(target), "size_bytes": target.stat().st_size}


def download(songs: DataFrame, fetch: Effect, probe: Effect, existing: Effect | None = None, discard: Effect | None = None) -> DataFrame:
    """(id, raw_path, duration_secs, state, error) of the songs to download.

    fetch gives path and size_bytes ({}: failed), probe gives secs, existing
    the file that is there already, discard deletes a file. A full file that is
    there is used again. Else the attempts at the song's address run until one
    gives a file; if it is a preview, the searches' results are tried in order,
    each by its own attempts, until one is longer. state: 'full', 'preview'
    (nothing longer was found) or 'error'. duration_secs is known for files of
    the fallback only, as the song's own metadata hold for the others.
    """
    probed = lambda got: _or_small(probe(got).get("secs"), got.get("size_bytes"))
    drop = discard or (lambda got: {})

    def first(row: dict, attempts: list) -> dict:
        return next((got for a in attempts if (got := fetch(row | dict(a))).get("path")), {})

    def tried(row: dict) -> dict:
        got = existing(row) if existing else {}
        if got.get("path"):
            if (probed(got) or 0) > PREVIEW_SECS:
                return {"raw_path": got["path"], "state": "full"}
            drop(got)
        got = first(row, [a.asDict() if hasattr(a, "asDict") else a for a in row["attempts"]])
        if not got:
            raise RuntimeError("no attempt succeeded")
        secs = probed(got)
        if not secs or secs > PREVIEW_SECS:
            return {"raw_path": got["path"], "state": "full"}
        drop(got)
        for query_ord, query in enumerate(row["queries"]):
            for rank in range(1, SEARCH_RESULTS + 1):
                got = first(row | {"query": query, "query_ord": query_ord, "result_rank": rank}, LADDER)
                if got:
                    if (secs := probed(got) or 0) > PREVIEW_SECS:
                        return {"raw_path": got["path"], "duration_secs": secs, "state": "full"}
                    drop(got)
        return {"state": "preview"}

    plan = attempt_plan(work_queue(songs).select("id", "title", "artist", "source_url"))
    fields = F.struct("ord", "label", "format", "extractor_args", "use_cookies")
    per_song = plan.groupBy("id", "title", "artist", "source_url").agg(F.array_sort(F.collect_list(fields)).alias("attempts"))
    per_song = per_song.withColumn("queries", S.search_queries(F.col("title"), F.col("artist"))).withColumn("_file", S.download_name(F.col("title"), F.col("artist")))
    got = run_effect(per_song, tried, "raw_path string, duration_secs double, state string")
    return got.select("id", F.coalesce("raw_path", F.lit("")).alias("raw_path"), "duration_secs", F.coalesce("state", F.lit("error")).alias("state"), "error")


def settled(songs: DataFrame, got: DataFrame) -> DataFrame:
    """songs after ``download`` gave got: downloaded with a path (and the fallback's duration), or error."""
    status = F.when(F.col("state") == "full", "downloaded").otherwise("error")
    songs = update_status(songs, got.select("id", status.alias("status"), "raw_path"))
    return update_duration(songs, got.filter("duration_secs is not null").select("id", "duration_secs"))


def _or_small(secs: float | None, size_bytes: int | None) -> float | None:
    """As ``scalars.probed_duration``, for one file inside an effect."""
    return secs if secs is not None else 30.0 if size_bytes is not None and size_bytes / 1024 < PREVIEW_KB else None


def separate(songs: DataFrame, stems: DataFrame, split: Effect, files: DataFrame | None = None) -> DataFrame:
    """(song_id, stem_type, file_path, error) of songs with a raw file: vocals, instrumental and the raw file as 'full'.

    files (path): those that exist (None: all that are named). A song whose two
    stems exist keeps them without a call; split gives the paths of the others.
    """
    if files is not None:
        songs = with_files(songs, files)
        stems = stems.join(files.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi")
    last = lambda kind: F.max_by("file_path", F.when(F.col("stem_type") == kind, F.col("id"))).alias(kind)
    have = stems.filter("stem_type in ('vocals', 'instrumental')").groupBy("song_id").agg(last("vocals"), last("instrumental")).filter("vocals is not null and instrumental is not null")
    todo = songs.filter("raw_path <> ''").select("id", "title", "artist", "raw_path").join(have, F.col("id") == F.col("song_id"), "left").drop("song_id")
    there = todo.filter("vocals is not null").withColumn("error", F.lit(None).cast("string"))
    done = run_effect(todo.filter("vocals is null").drop("vocals", "instrumental"), split, "vocals string, instrumental string").unionByName(there)
    made = F.array(*[F.struct(F.lit(t).alias("stem_type"), F.col(c).alias("file_path")) for t, c in (("vocals", "vocals"), ("instrumental", "instrumental"), ("full", "raw_path"))])
    return done.select(F.col("id").alias("song_id"), F.explode(made).alias("s"), "error").select("song_id", "s.*", "error")


def probe_seconds(path: str, run: Callable = subprocess.run, seconds: int = 15) -> float | None:
    """A file's length by the probing tool; None if that is missing, fails, takes too long or prints no number."""
    argv = ["ffprobe", "-v", "error", "-show_entries", "format=duration", "-of", "default=noprint_wrappers=1:nokey=1", path]
    try:
        done = run(argv, capture_output=True, text=True, timeout=seconds)
        return float(done.stdout.strip()) if done.returncode == 0 else None
    except (FileNotFoundError, subprocess.TimeoutExpired, ValueError):
        return None


def tool_effects(folder: str) -> dict[str, Effect]:
    """The effects of ``download`` by outside tools, with files ``{title}_{artist}.mp3`` in a folder that all executors share."""

    def target(row: dict) -> Path:
        return Path(folder) / row["_file"]

    def existing(row: dict) -> dict:
        path = target(row)
        return {"path": str(path), "size_bytes": path.stat().st_size} if path.exists() else {}

    def discard(got: dict) -> dict:
        Path(got["path"]).unlink(missing_ok=True)
        return {}

    return {"fetch": lambda row: run_download_tool(row, target(row)), "probe": lambda got: {"secs": probe_seconds(got["path"])}, "existing": existing, "discard": discard}
