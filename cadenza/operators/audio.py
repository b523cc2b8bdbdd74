"""Audio features that columns can say: key detection, RMS, zero crossings; the rest comes from a backend passed in."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.constants import KEY_NAMES, MAJOR_PROFILE, MINOR_PROFILE
from cadenza.functions.scalars import camelot_of


def _rolled(profile: list[float], by: int) -> list[float]:
    return [profile[(i - by) % 12] for i in range(12)]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def detect_key(chroma: Column) -> Column:
    """struct(key, mode, camelot) of a mean chroma vector of 12: the best Pearson correlation with 24 rotated profiles.

    Ties go to major, then to the first key. A constant vector has no
    correlation; it counts as C minor. Null stays null. The profiles are
    centred constants, so that the vector needn't be.
    """
    fits = []
    for mode, profile in (("major", MAJOR_PROFILE), ("minor", MINOR_PROFILE)):
        for i in range(12):
            own = _rolled(profile, i)
            middle = sum(own) / 12
            norm = sum((x - middle) ** 2 for x in own) ** 0.5
            fits.append(F.struct(F.lit(0 if mode == "major" else -1).alias("prefer"), F.lit(-i).alias("minus"), F.lit(mode).alias("mode"), F.array(*[F.lit((x - middle) / norm) for x in own]).alias("weights")))
    spread = _let(_sum(chroma) / F.size(chroma), lambda m: _sum(F.transform(chroma, lambda x: (x - m) * (x - m))))
    fit = lambda q: lambda c: F.struct(F.round(_sum(F.zip_with(chroma, c["weights"], lambda x, w: x * w)) / F.sqrt(q), 12).alias("r"), c["prefer"].alias("prefer"), c["minus"].alias("minus"), c["mode"].alias("mode"))
    best = _let(spread, lambda q: F.when(q > 0, F.array_max(F.transform(F.array(*fits), fit(q)))))
    names = F.array(*[F.lit(k) for k in KEY_NAMES])
    found = _let(best, lambda b: F.when(b.isNotNull(), F.struct(F.get(names, -b["minus"]).alias("key"), b["mode"].alias("mode"), camelot_of(-b["minus"], b["mode"]).alias("camelot"))))
    silent = F.struct(F.lit("C").alias("key"), F.lit("minor").alias("mode"), F.lit("5A").alias("camelot"))
    return F.when(chroma.isNotNull(), F.coalesce(found, silent))


def rms(samples: Column) -> Column:
    return F.sqrt(F.aggregate(samples, F.lit(0.0), lambda s, v: s + v * v) / F.size(samples))


def zero_crossing_rate(samples: Column) -> Column:
    """Sign changes (zero counts as positive) over the number of samples."""
    signs = F.transform(samples, lambda x: (x >= 0).cast("int"))
    changes = F.zip_with(F.slice(signs, 1, F.size(signs) - 1), F.slice(signs, 2, F.size(signs) - 1), lambda a, b: (a != b).cast("int"))
    return F.aggregate(changes, F.lit(0), lambda s, v: s + v).cast("double") / F.size(samples)


def frame_mean(frames: Column) -> Column:
    """The mean vector of frames (array of equally long arrays); null for none."""
    total = F.aggregate(F.slice(frames, 2, F.greatest(F.size(frames) - 1, F.lit(0))), F.get(frames, F.lit(0)), lambda s, f: F.zip_with(s, f, lambda a, b: a + b))
    return F.when(F.size(frames) > 0, F.transform(total, lambda v: v / F.size(frames)))


def _framed(samples: Column, value: Callable[[Column], Column], frame: int, hop: int) -> Column:
    """The mean over frames, centred at every ``hop`` samples, of what value makes of a frame's samples."""
    starts = F.transform(F.sequence(F.lit(0), F.floor(F.size(samples) / hop).cast("int")), lambda i: i * hop - frame // 2)
    cut = lambda at: F.slice(samples, F.greatest(at, F.lit(0)) + 1, F.least(at + frame, F.size(samples)) - F.greatest(at, F.lit(0)))
    values = F.transform(starts, lambda at: value(cut(at)))
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values)


def frame_rms(samples: Column, frame: int = 2048, hop: int = 512) -> Column:
    """The mean of the frames' RMS; beyond the ends there is silence."""
    return _framed(samples, lambda f: F.sqrt(F.aggregate(f, F.lit(0.0), lambda s, v: s + v * v) / frame), frame, hop)


def frame_zero_crossing_rate(samples: Column, frame: int = 2048, hop: int = 512) -> Column:
    """The mean of the frames' sign changes over the frame's length; beyond the ends nothing changes."""
    return _framed(samples, lambda f: zero_crossing_rate(f) * F.size(f) / frame, frame, hop)


def frame_energy(samples: Column, frame: int = 2048, hop: int = 512) -> Column:
    """The mean power of the spectrum's bins over windowed frames, without a transform.

    By Parseval's identity the power of all bins is that of the samples times
    the frame's length; of the bins from 0 to the highest all but these two
    occur twice, so half the sum of everything and of the two is theirs.
    """
    window = F.array(*[F.lit(0.5 - 0.5 * math.cos(2 * math.pi * i / frame)) for i in range(frame)])
    padded = F.concat(F.array_repeat(F.lit(0.0), frame // 2), samples, F.array_repeat(F.lit(0.0), frame))
    rows = F.transform(F.sequence(F.lit(0), F.floor(F.size(samples) / hop).cast("int")), lambda i: F.zip_with(F.slice(padded, i * hop + 1, F.lit(frame)), window, lambda x, w: x * w))
    square = lambda v: v * v
    turning = lambda f: _sum(F.transform(f, lambda v, i: F.when(i % 2 == 0, v).otherwise(-v)))
    power = lambda f: (frame * _sum(F.transform(f, square)) + square(_sum(f)) + square(turning(f))) / (2 * (frame // 2 + 1))
    values = F.transform(rows, power)
    return _sum(values) / F.size(values)


def analyse(files: DataFrame, backend: Callable[[dict], dict]) -> DataFrame:
    """Features of files (song_id, stem_type, file_path) by a backend that decodes audio.

    The backend returns bpm, n_beats, n_samples, chroma (12), samples' loudness_rms, energy,
    mfcc, spectral_centroid, spectral_rolloff, zero_crossing_rate; key, mode,
    Camelot code and confidence follow from them in columns.
    """
    from cadenza.functions.scalars import bpm_confidence
    from cadenza.sources.acquire import run_effect

    schema = "bpm double, n_beats long, n_samples long, chroma array<double>, loudness_rms double, energy double, mfcc array<double>, spectral_centroid double, spectral_rolloff double, zero_crossing_rate double"
    got = run_effect(files.select("song_id", "stem_type", "file_path"), backend, schema)
    keyed = got.withColumn("_key", detect_key(F.col("chroma")))
    return keyed.select(
        "song_id", "stem_type", F.round("bpm", 2).alias("bpm"), bpm_confidence(F.col("n_beats"), F.col("n_samples")).alias("bpm_confidence"), "_key.*",
        F.round("loudness_rms", 6).alias("loudness_rms"), F.round("energy", 6).alias("energy"), F.transform("mfcc", lambda x: F.round(x, 4)).alias("mfcc"),
        F.round("spectral_centroid", 2).alias("spectral_centroid"), F.round("spectral_rolloff", 2).alias("spectral_rolloff"), F.round("zero_crossing_rate", 6).alias("zero_crossing_rate"), "error",
    )
