"""Track metadata: JSON lines to normalised song rows."""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.scalars import duration_str


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("info", f"$.{path}", kind)


def _whole(path: str) -> Column:
    """A whole number: numbers are cut, true is 1, strings count only as integer literals, anything else is 0."""
    kind = F.schema_of_variant(F.try_variant_get("info", f"$.{path}", "variant"))
    text = F.trim(_get(path))
    number = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("long"))
    return F.coalesce(F.when(kind == "BOOLEAN", _get(path, "boolean").cast("long")).when(kind == "STRING", number).otherwise(_get(path, "double").try_cast("long")), F.lit(0).cast("long"))


def _first(*paths: str) -> Column:
    return F.coalesce(*[F.nullif(_get(p), F.lit("")) for p in paths])


def _thumbnail() -> Column:
    listed = F.coalesce(F.try_variant_get("info", "$.thumbnails", "array<variant>"), F.array().cast("array<variant>"))
    url = lambda v: F.coalesce(F.try_variant_get(v, "$.url", "string"), F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    urls = F.filter(F.transform(listed, lambda v: F.trim(url(v))), lambda u: u.isNotNull() & (u != ""))
    return F.coalesce(F.nullif(F.trim(_get("thumbnail")), F.lit("")), F.get(F.reverse(urls), F.lit(0)), F.lit(""))


def normalise(lines: DataFrame) -> DataFrame:
    """Song rows of JSON lines (columns line, value), with their place (line, entry).

    Blank lines and bad JSON are skipped, playlists with entries become their
    entries, and what isn't an object is dropped.
    """
    parsed = lines.filter(F.trim("value") != "").select("line", F.try_parse_json("value").alias("v")).filter("v is not null")
    entries = F.try_variant_get("v", "$.entries", "array<variant>")
    is_list = (F.try_variant_get("v", "$._type", "string") == "playlist") & (F.size(entries) > 0)
    rows = parsed.select("line", F.posexplode(F.when(is_list, entries).otherwise(F.array("v"))).alias("entry", "info"))
    rows = rows.filter(F.schema_of_variant("info").startswith("OBJECT"))
    secs = F.coalesce(_get("duration", "double"), F.lit(0.0))
    text = lambda p: F.coalesce(_get(p), F.lit(""))
    return rows.select(
        "line", "entry", F.coalesce(_first("title"), F.lit("Unknown")).alias("title"), F.coalesce(_first("uploader", "channel", "artist"), F.lit("Unknown")).alias("artist"),
        F.trim(text("genre")).alias("genre"), F.coalesce(_first("webpage_url", "url"), F.lit("")).alias("source_url"), secs.alias("duration_secs"), duration_str(secs).alias("duration_str"),
        text("uploader_id").alias("artist_id"), text("id").alias("track_id"), text("upload_date").alias("upload_date"), _thumbnail().alias("thumbnail"),
        _whole("like_count").alias("likes"), _whole("repost_count").alias("reposts"), _whole("comment_count").alias("comments"), _whole("view_count").alias("plays"),
    )


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Normalised tracks of text files with JSON lines; line numbers order files by name, then lines."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    ordered = raw.select(F.struct("file", "block", "n").alias("line"), "value")
    return normalise(ordered)


def run_metadata_tool(url: str, run: Callable = subprocess.run, seconds: int = 120) -> str:
    """What the metadata tool prints for an address; '' if it is missing, fails or takes too long."""
    try:
        done = run(["yt-dlp", "--dump-json", "--no-warnings", url], capture_output=True, text=True, timeout=seconds)
    except (FileNotFoundError, subprocess.TimeoutExpired):
        return ""
    return done.stdout if done.returncode == 0 else ""


def fetch_tracks(urls: DataFrame, fetch: Callable[[str], str] = run_metadata_tool) -> DataFrame:
    """Normalised tracks of addresses (column url); fetch gives an address's JSON lines and runs once for each, on the executors."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([(url, i, text) for url in part["url"] for i, text in enumerate(fetch(url).splitlines())], columns=["url", "n", "value"])

    lines = urls.select("url").mapInPandas(run, "url string, n long, value string")
    return normalise(lines.select(F.struct("url", "n").alias("line"), "value"))


def first_track(tracks: DataFrame) -> DataFrame:
    """The first track by place; no row if there is none."""
    return tracks.orderBy("line", "entry").limit(1)
