"""Listing, the data source of tracks, and stages over real files."""

import csv
import json

import numpy as np
from pyspark.sql import functions as F

from cadenza.operators import store as st
from cadenza.plans import pipeline
from cadenza.sources import acquire, ingest, listing, track_source
from tests.test_spectrum import clicks
from tests.test_waves import write

SONG = "id long, title string, artist string, source_url string, status string, raw_path string"


def test_many_files_in_many_tasks(spark, tmp_path):
    for i in range(50):
        (tmp_path / f"f{i}").mkdir()
        for k in range(40):
            (tmp_path / f"f{i}" / f"{k}.wav").touch()
    folders = spark.createDataFrame([(str(tmp_path / f"f{i}"),) for i in range(50)] + [(str(tmp_path / "none"),), (None,), (str(tmp_path / "f0"),)], "path string")
    found = listing.list_folders(folders)
    assert found.count() == 2000 and found.select("path").distinct().count() == 2000
    assert found.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    tree = listing.list_tree(spark.createDataFrame([(str(tmp_path),)], "path string"))
    assert tree.count() == 2000
    asked = spark.createDataFrame([(str(tmp_path / "f3" / "7.wav"),)] * 2 + [(str(tmp_path / "f3" / "77.wav"),), (str(tmp_path / "f3"),), ("",), (None,), ("/no/such",)], "path string")
    assert [r["path"] for r in listing.existing(asked).collect()] == [str(tmp_path / "f3" / "7.wav")]


def test_data_source_equals_captured_lines(spark, tmp_path):
    lines = ['{"title":"A","uploader":"","channel":"ch","duration":225.5,"like_count":3.9}', "{bad", "", '{"_type":"playlist","entries":[{"title":"E1"},null,7]}', '{"title":"Z"}']
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    captured = ingest.read_tracks(spark, str(tmp_path)).orderBy("line", "entry").drop("line", "entry").collect()
    found = track_source.tracks_of(spark, ["u1", "u2"], lambda u: "\n".join(lines[:3] if u == "u1" else lines[3:]))
    assert found.orderBy("line", "entry").drop("line", "entry").collect() == captured and len(captured) == 3
    assert track_source.tracks_of(spark, [], lambda u: "").count() == 0


def test_a_limit_reads_one_partition(spark, tmp_path):
    def fetch(url):
        (tmp_path / url).touch()
        return json.dumps({"title": url})

    spark.dataSource.register(track_source.track_source(fetch))
    lines = spark.read.format("tracks").option("urls", json.dumps(["a", "b", "c"])).load()
    assert lines.rdd.getNumPartitions() == 3 and lines.limit(1).collect()[0]["url"] == "a"
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a"]


def test_attempts_of_other_sites_have_no_extractor_arguments(spark):
    songs = spark.createDataFrame([(1, "https://other.invalid/x"), (2, "https://youtu.be/x")], "id long, source_url string")
    found = {}
    for r in acquire.attempt_plan(songs).orderBy("id", "ord").collect():
        found.setdefault(r["id"], []).append(r["extractor_args"])
    assert found[1] == [""] and len(found[2]) == 4 and all(found[2])


def test_the_last_update_holds(spark):
    songs = spark.createDataFrame([(1, "queued", "/old", 5.0, "0:05")], "id long, status string, raw_path string, duration_secs double, duration_str string")
    changes = spark.createDataFrame([(1, "queued", "/a", 9.0, 1), (1, "downloaded", "", 7.0, 2)], "id long, status string, raw_path string, duration_secs double, seq long")
    assert st.update_status(songs, changes).first()[:3] == (1, "downloaded", "/a")
    assert st.update_duration(songs, changes).first()["duration_str"] == "0:07"


def test_stems_are_judged_by_their_files(spark, tmp_path):
    for name in ("1.mp3", "2.mp3", "3.mp3", "4.mp3", "1v.wav", "1i.wav", "2v.wav"):
        (tmp_path / name).touch()
    path = lambda name: str(tmp_path / name)
    store = st.Store(spark, str(tmp_path / "store"))
    rows = [(i, f"T{i}", "A", f"u{i}", "downloaded", path(f"{i}.mp3")) for i in (1, 2, 3, 4, 5)]
    store.put("songs", spark.createDataFrame(rows, SONG))
    old = [(1, 1, "vocals", path("1v.wav")), (2, 1, "instrumental", path("1i.wav")), (3, 2, "vocals", path("2v.wav")), (4, 2, "instrumental", path("gone.wav"))]
    store.put("stems", spark.createDataFrame(old, st.STEMS))

    def split(row):
        if row["id"] == 1:
            raise AssertionError("its stems exist")
        if row["id"] == 4:
            raise OSError("no memory")
        return {"vocals": f"/new/{row['id']}v", "instrumental": f"/new/{row['id']}i"}

    stems = {(r["song_id"], r["stem_type"]): r["file_path"] for r in pipeline.run_stems(store, split).collect()}
    assert stems == {
        (1, "vocals"): path("1v.wav"), (1, "instrumental"): path("1i.wav"), (1, "full"): path("1.mp3"), (2, "vocals"): "/new/2v", (2, "instrumental"): "/new/2i", (2, "full"): path("2.mp3"),
        (3, "vocals"): "/new/3v", (3, "instrumental"): "/new/3i", (3, "full"): path("3.mp3"),
    }
    assert {r["id"]: r["status"] for r in store.read("songs").collect()} == {1: "stemmed", 2: "stemmed", 3: "stemmed", 4: "error", 5: "downloaded"}


def test_command_line_analyses_waves_and_matches(spark, tmp_path, capsys):
    audio = tmp_path / "audio"
    audio.mkdir()
    (tmp_path / "t.jsonl").write_text("\n".join(json.dumps({"title": f"T{i}", "uploader": "U", "url": f"https://other.invalid/{i}"}) for i in range(2)))
    run = lambda *argv: pipeline.main(["--store", str(tmp_path / "store"), *argv])
    assert run() == 1 and "--url or --tracks is missing" in capsys.readouterr().out
    assert run("--tracks", str(tmp_path / "t.jsonl"), "--stages", "ingest") == 0
    store = st.Store(spark, str(tmp_path / "store"))
    stems = []
    for song, bpm in ((1, 120), (2, 120)):
        for kind in ("full", "vocals", "instrumental"):
            write(audio / f"{song}{kind}.wav", clicks(bpm, 8) * 0.5 + 0.2 * np.sin(2 * np.pi * 440 * np.arange(8 * 22050) / 22050), 22050)
            stems.append((song, kind, str(audio / f"{song}{kind}.wav"), len(stems)))
    (audio / "broken.wav").write_bytes(b"x")
    stems += [(2, "odd", str(audio / "broken.wav"), 9), (1, "full2", "/no/such.wav", 10)]
    store.put("stems", st.upsert_stems(store.read("stems"), spark.createDataFrame(stems, "song_id long, stem_type string, file_path string, seq long")))
    assert run("--stages", "analysis", "match", "--audio", str(audio), "--seed-stem", "full", "--export", str(tmp_path / "r")) == 0
    features = store.read("features").collect()
    assert len(features) == 6 and all(abs(r["bpm"] / 120 - 1) < 0.02 and r["key"] == "A" and len(json.loads(r["mfcc_json"])) == 13 for r in features)
    assert {r["status"] for r in store.read("songs").collect()} == {"analysed"}
    out = capsys.readouterr().out
    assert "songs analysed: 2" in out and "BPM" in out.upper()
    rows = list(csv.DictReader((tmp_path / "r.csv").open()))
    assert rows and {r["vocal_wav_path"] for r in rows} <= {str(audio / f"{i}vocals.wav") for i in (1, 2)}
    (audio / "2instrumental.wav").unlink()
    assert run("--export", str(tmp_path / "again")) == 0
    assert f"FILE_MISSING:{audio / '2instrumental.wav'}" in {r["inst_wav_path"] for r in csv.DictReader((tmp_path / "again.csv").open())}
