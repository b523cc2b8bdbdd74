"""Store, ingest, acquisition, pairs, reports and the stages from end to end."""

import csv
import json
import subprocess
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cadenza.constants import VOCAL_OVER_INSTRUMENTAL, MatchConfig
from cadenza.operators import audio, pairs, rank, report, seeds
from cadenza.operators import store as st
from cadenza.plans import fixtures, pipeline
from cadenza.sources import acquire, ingest
from cadenza.streaming.work_queue import ingest_stream

SF = "/root/testdata/sf0.001"
LINES = [
    '{"title":"A","uploader":"","channel":"ch","duration":225.5,"like_count":3.9,"view_count":"12","comment_count":"3.9","repost_count":true,"thumbnails":[{"url":"u1"},{"url":"u2"},{"x":1}]}',
    "{bad",
    "",
    '{"_type":"playlist","entries":[{"title":"E1","artist":"ar"},null,7,{"title":null,"thumbnail":" t "}]}',
    '{"_type":"playlist","title":"P","entries":[]}',
    "[1]",
    '{"title":"Z","duration":226.5,"like_count":null,"thumbnails":["a"," b "]}',
]


def test_normalise(spark):
    rows = ingest.normalise(spark.createDataFrame(list(enumerate(LINES)), "line int, value string")).orderBy("line", "entry").collect()
    found = [(r["title"], r["artist"], r["likes"], r["plays"], r["comments"], r["reposts"], r["thumbnail"], r["duration_str"]) for r in rows]
    assert found == [("A", "ch", 3, 12, 0, 1, "u2", "3:46"), ("E1", "ar", 0, 0, 0, 0, "", ""), ("Unknown", "Unknown", 0, 0, 0, 0, "t", ""), ("P", "Unknown", 0, 0, 0, 0, "", ""), ("Z", "Unknown", 0, 0, 0, 0, "b", "3:46")]


def test_upsert_is_sequential(spark):
    target = spark.createDataFrame([(4, "old", "u1", "/p1"), (7, "o2", None, "")], "id long, title string, source_url string, raw_path string")
    batch = spark.createDataFrame([(1, "n1", "u2", ""), (2, "x1", "u1", ""), (3, "n2", "u2", "/a"), (4, "n3", "u2", ""), (5, "z", None, ""), (6, "z", None, "")], "seq long, title string, source_url string, raw_path string")
    once = st.upsert_songs(target, batch)
    found = sorted((r["id"], r["title"], r["source_url"] or "-", r["raw_path"]) for r in once.collect())
    assert found == [(4, "x1", "u1", "/p1"), (7, "o2", "-", ""), (8, "n3", "u2", "/a"), (9, "z", "-", ""), (10, "z", "-", "")]
    keyed = batch.filter("source_url is not null")
    twice = st.upsert_songs(st.upsert_songs(target, keyed), keyed)
    assert sorted(map(str, twice.collect())) == sorted(map(str, st.upsert_songs(target, keyed).collect()))
    assert st.upsert_songs(target.filter("false"), batch.filter("false")).count() == 0


@pytest.mark.parametrize("adaptive, coalesce", [("true", "true"), ("true", "false"), ("false", "false")])
def test_numbering_has_no_gaps(spark, tmp_path, adaptive, coalesce):
    """600,000 wide rows, so that ranges are sampled and partitions coalesced."""
    wide = [F.sha2(F.concat(F.lit(f"{i}-"), F.col("id").cast("string")), 256).alias(f"c{i}") for i in range(3)]
    rows = spark.range(600_000).select("id", F.pmod(F.xxhash64("id"), F.lit(1_000_000_007)).alias("k"), *wide)
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        for c, v in zip(old, (adaptive, coalesce, "13")):
            spark.conf.set(c, v)
        st.numbered(rows, ["k", "id"], "n").write.parquet(str(tmp_path / "n"))
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    found = spark.read.parquet(str(tmp_path / "n"))
    best = found.agg(F.count("*"), F.countDistinct("n"), F.min("n"), F.max("n"), F.countDistinct("id")).first()
    assert tuple(best) == (600_000, 600_000, 1, 600_000, 600_000)
    places = found.select("k", "id", "n").toPandas().sort_values(["k", "id"])["n"]
    assert places.tolist() == list(range(1, 600_001))


def test_repeated_changes_do_not_multiply_songs(spark):
    songs = spark.createDataFrame([(1, "queued", "", 5.0, "0:05"), (2, "queued", "/b", 6.0, "0:06")], "id long, status string, raw_path string, duration_secs double, duration_str string")
    changes = spark.createDataFrame([(1, "downloaded", "/a", 9.0), (1, "downloaded", "/a", 9.0), (1, "downloaded", None, 8.0)], "id long, status string, raw_path string, duration_secs double")
    assert sorted(map(tuple, st.update_status(songs, changes).collect())) == [(1, "downloaded", "/a", 5.0, "0:05"), (2, "queued", "/b", 6.0, "0:06")]
    assert sorted(map(tuple, st.update_duration(songs, changes).collect())) == [(1, "queued", "", 9.0, "0:09"), (2, "queued", "/b", 6.0, "0:06")]


@pytest.mark.parametrize("key_min", [0.85, 0.55, 0.5, 0.25])
def test_pair_plans_agree(spark, key_min):
    named = pairs.with_titles(fixtures.features(spark, SF).filter("song_id % 3 = 0"), fixtures.songs(spark, SF))
    top, bed = named.filter("stem_type = 'vocals'"), named.filter("stem_type = 'instrumental'")
    config = MatchConfig(key_min=key_min)
    found = [sorted(map(tuple, pairs.pairs(top, bed, VOCAL_OVER_INSTRUMENTAL, config, s).select("vocal_song_id", "inst_song_id", "score_total").collect())) for s in ("literal", "equi", "banded")]
    assert found[0] == found[1] == found[2] != []


@pytest.mark.parametrize("combo, role", [(VOCAL_OVER_INSTRUMENTAL, "vocal"), (VOCAL_OVER_INSTRUMENTAL, "inst"), ("instrumental_over_instrumental", "vocal")])
def test_pruned_seeds_give_the_same_rows(spark, combo, role):
    features, songs = fixtures.features(spark, SF), fixtures.songs(spark, SF)
    every = pairs.score_all(features, songs).cache()
    total, n_scored = every.filter(F.col("combo_type") == combo).count(), []
    for seed, k in ((5, 10), (42, 3), (8, 1000), (-1, 5), (9, 0)):
        found, n = seeds.best_matches(features, songs, seed, k, combo, role)
        assert found.collect() == rank.find_matches(every, seed, k, role, combo).select(found.columns).collect()
        n_scored.append(n)
    assert n_scored[0] * 10 < total and n_scored[1] <= n_scored[2] or not n_scored[2] and n_scored[3] == 0


def test_changed_pairs_bring_the_store_up_to_date(spark, tmp_path):
    songs = fixtures.songs(spark, SF).select("id", "title", "artist", "source_url", "status", "raw_path")
    features = fixtures.features(spark, SF).withColumn("mfcc_json", F.to_json("mfcc")).drop("mfcc").filter("song_id <= 120")
    changed = features.filter("song_id % 60 = 5").withColumn("bpm", F.col("bpm") + 1.5).unionByName(features.filter("song_id = 7").withColumn("song_id", F.lit(130).cast("long")))
    runs = []
    for name, incremental in (("a", True), ("b", False)):
        store = st.Store(spark, str(tmp_path / name), 8)
        store.put("songs", songs)
        store.put("features", features)
        pipeline.run_match(store)
        store.merge("features", changed.drop("id").withColumn("seq", F.struct("song_id", "stem_type")))
        found = pipeline.run_match(store, incremental=incremental)
        runs.append(sorted(map(repr, found.drop("scored_at").collect())))
        if incremental:  # nothing has changed since
            version = store.versions("mashup_candidates")[-1]
            assert sorted(map(repr, pipeline.run_match(store, incremental=True).drop("scored_at").collect())) == runs[0]
            assert store.manifest("mashup_candidates")["folders"] == store.manifest("mashup_candidates", version)["folders"]
    assert runs[0] == runs[1] and len(runs[0]) > 500


def test_ranks(spark):
    found = spark.createDataFrame([("b", 1, 2, 0.5), ("a", 2, 1, 0.5), ("a", 1, 2, 0.9), ("a", 1, 3, None)], "combo_type string, vocal_song_id long, inst_song_id long, score_total double")
    assert [r["rank"] for r in rank.ranked(found, 3).orderBy("rank").collect()] == [1, 2, 3]
    assert [r["combo_type"] for r in rank.top(found, 4).collect()] == ["a", "a", "b", "a"]
    assert rank.for_song(found, 2, "anything").count() == 2
    with pytest.raises(ValueError):
        rank.top(found, -1)


def test_search_fallback_takes_the_first_long_result(spark):
    plan = acquire.search_plan(spark.createDataFrame([(1, "S (x)", "A")], "id long, title string, artist string"))
    assert plan.count() == 15 and plan.select("query").distinct().count() == 3
    secs = plan.withColumn("duration_secs", F.when((F.col("query_ord") == 1) & (F.col("result_rank") >= 3), 40.0).otherwise(35.0))
    row = acquire.first_long_result(secs).first()
    assert (row["query_ord"], row["result_rank"], row["query"]) == (1, 3, "ytsearch5:A S lyrics")
    assert acquire.download_arguments("u", "t", "f", "e", True, 2)[-1] == "u"


def test_stages_end_to_end(spark, tmp_path):
    (tmp_path / "tracks").mkdir()
    lines = [json.dumps({"title": f"T{i}", "uploader": "U", "url": f"https://youtu.be/{i}", "duration": 100 + i}) for i in range(6)]
    (tmp_path / "tracks/a.jsonl").write_text("\n".join(lines))
    store = st.Store(spark, str(tmp_path / "store"))
    assert store.read("songs").count() == 0
    assert pipeline.run_ingest(store, str(tmp_path / "tracks")).count() == 6
    assert [r["title"] for r in store.read("songs").orderBy("id").collect()] == [f"T{i}" for i in range(6)]

    def fetch(row):
        if row["source_url"].endswith("5"):
            raise OSError("gone")
        return {"path": f"/raw/{row['id']}.mp3", "size_bytes": 10**7} if row["ord"] == 1 else {}

    pipeline.run_download(store, fetch, lambda got: {"secs": 20.0 if "/1." in got["path"] else 200.0})
    assert {r["status"]: r["n"] for r in store.read("songs").groupBy("status").agg(F.count("*").alias("n")).collect()} == {"downloaded": 4, "error": 2}
    pipeline.run_stems(store, lambda row: {"vocals": f"/s/{row['id']}v.wav", "instrumental": f"/s/{row['id']}i.wav"}, exists=lambda paths: paths)
    assert store.read("stems").count() == 12
    base = {"n_beats": 60, "n_samples": 661500, "chroma": [1.0, 0, 0.5, 0, 0.7, 0.3, 0, 0.9, 0, 0.4, 0, 0.2], "loudness_rms": 0.1, "energy": 5.0, "mfcc": [1.0] * 13, "spectral_centroid": 1.0, "spectral_rolloff": 2.0, "zero_crossing_rate": 0.1}
    pipeline.run_analysis(store, lambda row: base | {"bpm": 100.0 + row["song_id"]}, exists=lambda paths: paths)
    assert store.read("features").filter("camelot = '8B'").count() == 12
    first = pipeline.run_match(store).count()
    assert first == 4 * 3 + 6 and pipeline.run_match(store).count() == first
    assert "TOP:" in pipeline.seed_text(store, 3) and "No qualifying" in pipeline.seed_text(store, 99)
    candidates, stems = store.read("mashup_candidates"), store.read("stems")
    assert report.write_report(report.export_rows(candidates, stems, None, 5), str(tmp_path / "r.csv"))
    with (tmp_path / "r.csv").open() as f:
        rows = list(csv.DictReader(f))
    assert [r["rank"] for r in rows] == list("12345") and list(rows[0]) == list(report.CSV_FIELDS)
    text = (tmp_path / "r.txt").read_text()
    assert "SCORE:" in text and text.count("Tempo: play the lower layer at") == 5 and "so that it runs at 10" in text and "Pitch: move the lower layer by +0 semitones" in text
    assert report.write_sessions(report.session_plan(candidates, stems, 2), str(tmp_path / "fl")) == 2
    infos = [p.read_text() for p in Path(tmp_path / "fl").glob("*/session_info.txt")]
    assert len(infos) == 2 and all("Tempo:" in t and t.count("Warning:") == 2 for t in infos)
    text = report.report_text(store.read("songs"), store.read("features"), candidates, 2)
    assert text.startswith("Songs: 6 (shown: 2)") and "MFCC [1.0" in text and "(shown: 12)" in text and "centroid 1.0" in text
    assert pipeline.totals(store)["stems"] == 12 and pipeline.totals(store)["songs analysed"] == 4
    with pytest.raises(ValueError):
        store.reset()
    store.reset(sure=True)
    assert store.read("songs").count() == 0 and not report.write_report(report.export_rows(store.read("mashup_candidates"), store.read("stems")), str(tmp_path / "none"))


def test_download_reuses_falls_back_and_cleans_up(spark):
    songs = spark.createDataFrame([(i, f"S{i} (live)", "A", u, "queued", "", 10.0, "0:10") for i, u in ((1, "https://youtu.be/1"), (2, "u2"), (3, "u3"), (4, "u4"), (5, "https://youtu.be/5"))], "id long, title string, artist string, source_url string, status string, raw_path string, duration_secs double, duration_str string")

    def fetch(row):
        if row.get("query"):
            hit = row["id"] == 3 and (row["query"], row["result_rank"], row["ord"]) == ("ytsearch5:A S3 lyrics", 2, 3)
            return {"path": "/alt/long"} if hit else {"path": "/alt/short"} if row["id"] == 4 and row["ord"] == 0 else {}
        return {} if row["id"] == 5 else {"path": f"/raw/{row['id']}/{row['ord']}", "size_bytes": 1000 if row["id"] in (3, 4) else 10**7} if row["ord"] == (2 if row["id"] == 1 else 0) else {}

    probe = lambda got: {"secs": {"/old/2": 99.0, "/old/1": 9.0, "/alt/long": 50.0, "/alt/short": 35.0}.get(got["path"])}
    got = acquire.download(songs, fetch, probe, lambda row: {"path": f"/old/{row['id']}"} if row["id"] < 3 else {})
    found = {r["id"]: (r["status"], r["raw_path"], r["duration_secs"], r["duration_str"]) for r in acquire.settled(songs, got).collect()}
    assert found == {1: ("downloaded", "/raw/1/2", 10.0, "0:10"), 2: ("downloaded", "/old/2", 10.0, "0:10"), 3: ("downloaded", "/alt/long", 50.0, "0:50"), 4: ("error", "", 10.0, "0:10"), 5: ("error", "", 10.0, "0:10")}


def test_download_tool(tmp_path):
    target = tmp_path / "song.mp3"
    (tmp_path / "song.part").write_text("old")
    (tmp_path / "song2.mp3").write_text("other")
    row = {"source_url": "u", "format": "f", "extractor_args": "e", "use_cookies": True}
    calls = []

    def run(argv, **kw):
        calls.append((argv, kw["timeout"], sorted(p.name for p in tmp_path.iterdir())))
        (tmp_path / "song.webm").write_text("abc")
        return subprocess.CompletedProcess(argv, 0, "", "")

    assert acquire.run_download_tool(row, target, run) == {"path": str(target), "size_bytes": 3} and target.read_text() == "abc"
    assert calls[0][1:] == (300, ["song2.mp3"]) and calls[0][0][-1] == "u" and "--no-playlist" in calls[0][0]
    acquire.run_download_tool(row | {"query": "ytsearch5:q", "result_rank": 4}, target, run)
    assert calls[1][0][-1] == "ytsearch5:q" and "4" in calls[1][0]
    assert acquire.run_download_tool(row, target, lambda a, **k: subprocess.CompletedProcess(a, 1, "", "")) == {}
    assert acquire.run_download_tool(row, target, lambda a, **k: subprocess.CompletedProcess(a, 0, "", "")) == {}
    assert ingest.run_metadata_tool("u", lambda a, **k: subprocess.CompletedProcess(a, 0, "x", "")) == "x" and ingest.run_metadata_tool("u", lambda a, **k: subprocess.CompletedProcess(a, 2, "x", "")) == ""
    for e in (FileNotFoundError(), subprocess.TimeoutExpired("x", 1)):
        def fail(*a, error=e, **k):
            raise error
        assert acquire.run_download_tool(row, target, fail) == {} and ingest.run_metadata_tool("u", fail) == ""


def test_fetched_tracks(spark):
    urls = spark.createDataFrame([("a",), ("b",), ("c",)], "url string")
    tracks = ingest.fetch_tracks(urls, lambda u: {"a": "\n".join(LINES), "c": ""}.get(u, '{"title":"B"}\n'))
    assert [r["title"] for r in tracks.orderBy("line", "entry").collect()] == ["A", "E1", "Unknown", "P", "Z", "B"]
    assert [r["title"] for r in ingest.first_track(tracks).collect()] == ["A"] and ingest.first_track(tracks.filter("false")).count() == 0


def test_stem_order_skips_missing_files(spark):
    stems = spark.createDataFrame([(2, "full", "/f"), (1, "instrumental", "/i"), (1, "vocals", "/v"), (1, "full", "/g"), (1, "odd", "/o")], "song_id long, stem_type string, file_path string")
    files = spark.createDataFrame([("/i",), ("/g",), ("/o",), ("/f",), ("/f",)], "path string")
    assert [r["file_path"] for r in pipeline.audio_files(stems, files).collect()] == ["/g", "/i", "/f"] and pipeline.audio_files(stems).count() == 4


def test_frame_means(spark):
    y = [float(x) for x in (1, -2, 3, 4, -5, 6, 0, -1, 2)]
    row = spark.createDataFrame([(y, [[1.0, 4.0], [3.0, 0.0]], [])], "y array<double>, f array<array<double>>, e array<array<double>>").select(
        audio.frame_rms(F.col("y"), 4, 2).alias("rms"), audio.frame_zero_crossing_rate(F.col("y"), 4, 2).alias("zcr"), audio.frame_mean(F.col("f")).alias("mean"), audio.frame_mean(F.col("e")).alias("none")).first()
    frames = [y[max(0, i * 2 - 2) : i * 2 + 2] for i in range(len(y) // 2 + 1)]
    assert row["rms"] == pytest.approx(sum((sum(v * v for v in f) / 4) ** 0.5 for f in frames) / len(frames))
    assert row["zcr"] == pytest.approx(sum(sum((a >= 0) != (b >= 0) for a, b in zip(f, f[1:])) / 4 for f in frames) / len(frames))
    assert row["mean"] == [2.0, 2.0] and row["none"] is None


def test_score_names_fall_back():
    old = {"vocal_title": "V", "total": 0.5, "score_bpm": 0.0, "bpm_score": 0.25, "score_key": 0.75}
    text = report.format_results([type("R", (), {"asDict": lambda self: old})()])
    assert "Score: 0.500  |  BPM: 0.25  Key: 0.75  Energy: 0.00  Timbre: 0.00" in text and "V — ?  [? BPM  ?]" in text


def test_stream_merges_into_the_store(spark, tmp_path):
    schema = "seq long, title string, artist string, source_url string"
    spark.createDataFrame([(1, "a", "x", "u1"), (2, "b", "x", "u2"), (3, "c", "x", "u1")], schema).write.parquet(str(tmp_path / "in"))
    store = st.Store(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    ingest_stream(stream, store, str(tmp_path / "cp")).awaitTermination(120)
    assert sorted((r["title"], r["status"]) for r in store.read("songs").collect()) == [("b", "queued"), ("c", "queued")]
