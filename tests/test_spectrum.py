"""Spectral features against plain NumPy, tones and click tracks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.constants import KEY_NAMES
from cadenza.operators import audio, spectrum

RATE = 22050


def signals(spark, by_key, size):
    rows = [(k, "full", [float(x) for x in v]) for k, v in by_key.items()]
    return spectrum.chunked(spark.createDataFrame(rows, "song_id long, stem_type string, samples array<double>"), size)


def plain(x, rate, frame, hop, bands, coefficients):
    """Means of the features as their definitions say, over whole arrays."""
    padded = np.concatenate([np.zeros(frame // 2), x, np.zeros(frame)])
    rows = np.array([padded[i * hop : i * hop + frame] for i in range(len(x) // hop + 1)])
    heard = rows * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(frame) / frame))
    turns = np.exp(-2j * np.pi * np.outer(np.arange(frame), np.arange(frame // 2 + 1)) / frame)
    magnitude = np.abs(heard @ turns)
    bins = np.arange(frame // 2 + 1) * rate / frame
    centroid = [(m * bins).sum() / m.sum() if m.sum() else 0 for m in magnitude]
    rolloff = [next(f for f, r in zip(bins, np.cumsum(m)) if r >= 0.85 * m.sum() - 1e-12) for m in magnitude]
    mel = magnitude**2 @ spectrum.mel_filters(rate, frame, bands).T
    db = 10 * np.log10(np.maximum(mel, 1e-10))
    db = np.maximum(db, db.max() - 80)
    basis = np.array([[np.sqrt((1 if k == 0 else 2) / bands) * np.cos(np.pi * k * (b + 0.5) / bands) for b in range(bands)] for k in range(coefficients)])
    return {"energy": (magnitude**2).mean(), "centroid": np.mean(centroid), "rolloff": np.mean(rolloff), "rms": np.sqrt((rows**2).mean(axis=1)).mean()}, (db @ basis.T).mean(axis=0), db


@pytest.mark.parametrize("n", [1, 40, 64, 100, 256])
def test_features_match_plain_numpy(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    chunks = signals(spark, {1: x, 2: x[::-1], 3: np.zeros(n)}, 32)
    frames = spectrum.spectra(chunks, 32, 1000, 16, 4, 6).cache()
    heard = spectrum.decibels(frames)
    got = {r["song_id"]: r for r in frames.groupBy("song_id").agg(*[F.avg(c).alias(c) for c in ("energy", "centroid", "rolloff", "rms", "crossings")], F.count("*").alias("n")).collect()}
    coefficients = {r["song_id"]: r["mfcc"] for r in spectrum.mfcc(heard, 6, 5).collect()}
    envelope = {r["song_id"]: r["onset"] for r in spectrum.onsets(heard).collect()}
    for song, y in ((1, x), (2, x[::-1]), (3, np.zeros(n))):
        means, cepstrum, db = plain(y, 1000, 16, 4, 6, 5)
        assert got[song]["n"] == n // 4 + 1
        assert all(abs(got[song][k] - v) < 1e-6 for k, v in means.items())
        assert np.allclose(coefficients[song], cepstrum, atol=1e-4)
        rise = np.concatenate([[0], np.maximum(0, np.diff(db, axis=0)).mean(axis=1)])
        assert np.allclose(envelope[song], rise)
    column = spark.createDataFrame([([float(v) for v in x],)], "x array<double>").select(audio.frame_rms(F.col("x"), 16, 4).alias("rms"), audio.frame_zero_crossing_rate(F.col("x"), 16, 4).alias("zcr"), audio.frame_energy(F.col("x"), 16, 4).alias("energy")).first()
    assert np.allclose([got[1]["rms"], got[1]["crossings"], got[1]["energy"]], column)


def test_pure_tones_give_their_own_class(spark):
    t = np.arange(3 * RATE) / RATE
    tones = {p: 0.5 * np.sin(2 * np.pi * spectrum.LOWEST * 2 ** (p / 12) * t) for p in (12, 21, 28, 35, 43, 54)}
    found = {r["song_id"]: r["chroma"] for r in spectrum.chroma(signals(spark, tones, 16384), 16384).collect()}
    assert {p: int(np.argmax(c)) for p, c in found.items()} == {p: p % 12 for p in tones}
    assert all(np.sort(c)[-2] < 0.6 * max(c) for c in found.values())


def test_chord_gives_its_key(spark):
    t = np.arange(2 * RATE) / RATE
    scale = {0: 1.0, 4: 0.8, 7: 0.9, 2: 0.3, 5: 0.4, 9: 0.4, 11: 0.3}
    chord = sum(a * np.sin(2 * np.pi * spectrum.LOWEST * 2 ** ((24 + 2 + s) / 12) * t) for s, a in scale.items())
    row = spectrum.chroma(signals(spark, {1: chord}, 16384), 16384).select(audio.detect_key(F.col("chroma")).alias("k")).first()["k"]
    assert (row["key"], row["mode"]) == (KEY_NAMES[2], "major")


def clicks(bpm, seconds=30):
    x = np.zeros(seconds * RATE)
    for at in np.arange(0.2, seconds - 0.1, 60 / bpm):
        n = round(at * RATE)
        x[n : n + 400] += np.sin(2 * np.pi * 1000 * np.arange(400) / RATE) * np.exp(-np.arange(400) / 80)
    return x


def test_click_tracks(spark):
    tempi = [60, 75, 90, 120, 133, 150, 180]
    chunks = signals(spark, {b: clicks(b) for b in tempi}, 65536)
    found = {r["song_id"]: r for r in spectrum.analysed(chunks, 65536).collect()}
    assert {b: abs(found[b]["bpm"] / b - 1) < 0.02 for b in tempi} == dict.fromkeys(tempi, True), {b: found[b]["bpm"] for b in tempi}
    for b in tempi:
        n_beats = found[b]["bpm_confidence"] * 30 * RATE / 512
        assert abs(n_beats - 29.7 * b / 60) <= 3


def test_beats_are_the_best_sequence():
    """Against all sequences of steps of half to twice the period, on a short envelope."""
    rng = np.random.default_rng(4)
    onset, period = rng.random(14), 3.0
    around = np.arange(-3, 4)
    local = np.convolve(onset / onset.std(), np.exp(-0.5 * (around * 32 / period) ** 2), "full")[3:17]

    def best(i):
        options = [best(j) - 100 * np.log((i - j) / period) ** 2 for j in range(i) if 2 <= i - j <= 6]
        return local[i] + max([0.0, *options])

    found = spectrum.beats(onset, period)
    total = sum(local[found]) - sum(100 * np.log(np.diff(found) / period) ** 2)
    assert len(found) and abs(total - max(best(i) for i in range(8, 14))) < max(local) + 1e-9


def test_silence_and_nothing(spark):
    schema = "song_id long, stem_type string, samples array<double>"
    rows = spark.createDataFrame([(1, "full", [0.0] * 5000), (2, "full", []), (3, "full", None)], schema)
    found = spectrum.analysed(spectrum.chunked(rows, 16384), 16384).collect()
    assert [(r["song_id"], r["bpm"], r["energy"], r["spectral_centroid"], r["key"], r["mode"], r["error"]) for r in found] == [(1, 0.0, 0.0, 0.0, "C", "minor", None)]
    assert spectrum.analysed(spectrum.chunked(rows.limit(0), 16384), 16384).count() == 0


def test_a_long_signal_is_cut_over_tasks(spark):
    chunks = signals(spark, {1: np.random.default_rng(1).normal(size=4096)}, 64)
    margins = spectrum.with_margins(chunks, 64, 32, 8)
    assert margins.agg(F.max(F.size("left") + F.size("samples") + F.size("right"))).first()[0] <= 64 + 32 and margins.count() == 65
