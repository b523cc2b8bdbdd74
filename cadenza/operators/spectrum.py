"""Spectral features of audio as plans over chunks of samples: energy, centroid, rolloff, MFCC, chroma, tempo and beats.

A chunk is a row (keys, chunk, samples): a signal's samples in equal chunks, of
which only the last may be shorter. Frames are centred at every ``hop``
samples, with silence beyond the ends; the tasks see one chunk and half a frame
on either side, never a whole signal.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.audio import detect_key
from cadenza.tables import written

KEYS = ("song_id", "stem_type")
RATE, FRAME, HOP, BANDS, COEFFICIENTS = 22050, 2048, 512, 128, 13
#: The chroma's longest kernel, its lowest pitch (C1 in hertz) and octaves.
CHROMA_FRAME, LOWEST, OCTAVES = 16384, 32.70319566257483, 7
#: Powers below this count as it; decibels below the signal's greatest by more than that are raised.
LEAST_POWER, RANGE_DB = 1e-10, 80.0


def chunked(signals: DataFrame, size: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, chunk, samples) of signals (keys, samples) that fit in a row; an empty or null signal has none."""
    n = F.ceil(F.size("samples") / size).cast("int")
    rows = signals.filter(F.size("samples") > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.select(*keys, F.col("chunk").cast("long").alias("chunk"), F.slice("samples", F.col("chunk") * size + 1, F.lit(size)).alias("samples"))


def with_margins(chunks: DataFrame, size: int, frame: int, hop: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, chunk, left, samples, right): every chunk with the half frame before and after it.

    A chunk sends its ends to its neighbours, so that one exchange of little
    more than the samples gives each task all that its frames need. A signal
    that ends with a full chunk gets one more without samples, for the frame
    that is centred on its end. Of repeated chunks one is taken.
    """
    if size % hop or size < frame // 2:
        raise ValueError("chunks must be a multiple of the hop and at least half a frame")
    half, n = frame // 2, F.size("samples")
    whole = F.struct(F.col("chunk"), F.lit(0).alias("place"), F.col("samples").alias("part"))
    tail = F.struct((F.col("chunk") + 1).alias("chunk"), F.lit(-1).alias("place"), F.slice("samples", F.greatest(n - half, F.lit(0)) + 1, F.lit(half)).alias("part"))
    head = F.struct((F.col("chunk") - 1).alias("chunk"), F.lit(1).alias("place"), F.slice("samples", 1, half).alias("part"))
    sent = F.array_compact(F.array(whole, F.when(n == size, tail), F.when(F.col("chunk") > 0, head)))
    at = lambda place: F.first(F.when(F.col("_p.place") == place, F.col("_p.part")), ignorenulls=True)
    parts = chunks.select(*keys, F.explode(sent).alias("_p"))
    none = F.array().cast("array<double>")
    met = parts.groupBy(*keys, F.col("_p.chunk").alias("chunk")).agg(at(-1).alias("left"), at(0).alias("samples"), at(1).alias("right"))
    return met.select(*keys, "chunk", *[F.coalesce(c, none).alias(c) for c in ("left", "samples", "right")])


def hann(n: int) -> np.ndarray:
    """The periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def _mel(hertz: np.ndarray) -> np.ndarray:
    """Slaney's mel scale: linear to 1,000 Hz, then 27 steps for a factor of 6.4."""
    return np.where(hertz < 1000, hertz * 3 / 200, 15 + np.log(np.maximum(hertz, 1000) / 1000) * 27 / math.log(6.4))


def _hertz(mel: np.ndarray) -> np.ndarray:
    return np.where(mel < 15, mel * 200 / 3, 1000 * np.exp((np.maximum(mel, 15) - 15) * math.log(6.4) / 27))


@lru_cache(maxsize=4)
def mel_filters(rate: int, frame: int, bands: int) -> np.ndarray:
    """Triangles (bands x bins) evenly spaced on the mel scale, each of unit area."""
    edges = _hertz(np.linspace(0, _mel(np.array(rate / 2)), bands + 2))
    bins = np.arange(frame // 2 + 1) * rate / frame
    rising = (bins - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    falling = (edges[2:, None] - bins) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(rising, falling)) * (2 / (edges[2:] - edges[:-2]))[:, None]


@lru_cache(maxsize=4)
def pitch_kernels(rate: int, frame: int, lowest: float, octaves: int, threshold: float) -> list[tuple[int, np.ndarray]]:
    """Constant-Q kernels as spectra: for each semitone its first bin and the bins from there that matter.

    A kernel is a complex tone under a Hann window of Q periods, at most one
    frame, in the frame's middle. Bins below threshold times its greatest are left out.
    """
    q = 1 / (2 ** (1 / 12) - 1)
    out = []
    for p in range(12 * octaves):
        pitch = lowest * 2 ** (p / 12)
        n = min(frame, math.ceil(q * rate / pitch))
        at = np.arange(n) + (frame - n) // 2
        kernel = np.zeros(frame, dtype=complex)
        kernel[at] = hann(n) / n * np.exp(2j * np.pi * pitch * (at - frame // 2) / rate)
        bins = np.conj(np.fft.fft(kernel)) / frame
        kept = np.flatnonzero(np.abs(bins) >= threshold * np.abs(bins).max())
        first, last = (kept[0], kept[-1] + 1) if kept[-1] <= frame // 2 else (0, frame)
        out.append((int(first), bins[first:last]))
    return out


def _frames(left: np.ndarray, samples: np.ndarray, right: np.ndarray, size: int, frame: int, hop: int) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's frames as rows: those centred in it, and on the signal's end if that is in it.

    Beyond the signal's ends the first have silence, the second its last sample.
    """
    half = frame // 2
    n = size // hop if len(samples) == size else len(samples) // hop + 1
    known = np.concatenate([left, samples, right])
    start = half - len(left)
    silent = np.zeros(half + size + frame)
    silent[start : start + len(known)] = known
    held = silent.copy()
    held[:start], held[start + len(known) :] = known[0], known[-1]
    cut = lambda x: np.lib.stride_tricks.sliding_window_view(x, frame)[::hop][:n]
    return cut(silent), cut(held)


def _per_frame(margins: DataFrame, size: int, frame: int, hop: int, features, schema: str, keys: tuple[str, ...]) -> DataFrame:
    """(keys, frame, columns of schema): what features makes of the frames of each chunk, 64 at a time."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = dict(margins.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.select(list(keys))
            for i in range(b.num_rows):
                left, samples, right = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("left", "samples", "right"))
                rows, held = _frames(left, samples, right, size, frame, hop)
                for at in range(0, len(rows), 64):
                    part = rows[at : at + 64]
                    place = np.arange(at, at + len(part)) + b.column("chunk")[i].as_py() * (size // hop)
                    values = [pa.array(list(v) if v.ndim > 1 else v) for v in features(part, held[at : at + 64])]
                    yield pa.RecordBatch.from_arrays([*(pa.repeat(c[i], len(part)) for c in own.columns), pa.array(place), *values], names=[*keys, "frame", *names])

    return margins.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "frame long", schema]))


def spectra(chunks: DataFrame, size: int, rate: int = RATE, frame: int = FRAME, hop: int = HOP, bands: int = BANDS, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, frame, rms, crossings, energy, centroid, rolloff, mel): a row for every frame of every signal.

    crossings: sign changes a sample (zero counts as positive). energy: the mean power of the bins, without a transform (Parseval's
    identity over all bins; the lowest and the highest count once, the others
    twice). centroid: the bins' mean frequency by magnitude (0 in silence);
    rolloff: the lowest frequency with 85 % of the magnitude at or below it.
    mel: the power in ``bands`` mel bands.
    """
    window = hann(frame)
    bins = np.arange(frame // 2 + 1) * rate / frame
    turns = np.where(np.arange(frame) % 2, -1.0, 1.0)

    def features(rows: np.ndarray, held: np.ndarray) -> list[np.ndarray]:
        heard = rows * window
        ends = heard.sum(axis=1) ** 2 + (heard @ turns) ** 2
        energy = (frame * (heard * heard).sum(axis=1) + ends) / 2 / len(bins)
        magnitude = np.abs(np.fft.rfft(heard, axis=1))
        total = magnitude.sum(axis=1)
        centroid = magnitude @ bins / np.where(total > 0, total, 1)
        running = np.cumsum(magnitude, axis=1)
        rolloff = bins[(running >= 0.85 * running[:, -1:]).argmax(axis=1)]
        positive = held >= 0
        crossings = (positive[:, 1:] != positive[:, :-1]).sum(axis=1) / frame
        return [np.sqrt((rows * rows).mean(axis=1)), crossings, energy, centroid, rolloff, magnitude**2 @ mel_filters(rate, frame, bands).T]

    return _per_frame(with_margins(chunks, size, frame, hop, keys), size, frame, hop, features, "rms double, crossings double, energy double, centroid double, rolloff double, mel array<double>", keys)


def chroma(chunks: DataFrame, size: int, rate: int = RATE, frame: int = CHROMA_FRAME, hop: int = HOP, lowest: float = LOWEST, octaves: int = OCTAVES, threshold: float = 0.0054, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, chroma array of 12): the mean over frames of the constant-Q magnitudes, summed over octaves and divided by the frame's greatest class.

    A silent frame counts as zeros. Class 0 is that of ``lowest`` (C).
    """

    def features(rows: np.ndarray, held: np.ndarray) -> list[np.ndarray]:
        kernels = pitch_kernels(rate, frame, lowest, octaves, threshold)
        half = all(first + len(kernel) <= frame // 2 + 1 for first, kernel in kernels)
        spectrum = (np.fft.rfft if half else np.fft.fft)(rows, axis=1)
        classes = np.zeros((len(rows), 12))
        for p, (first, kernel) in enumerate(kernels):
            classes[:, p % 12] += np.abs(spectrum[:, first : first + len(kernel)] @ kernel)
        most = classes.max(axis=1, keepdims=True)
        return [classes / np.where(most > 0, most, 1)]

    found = _per_frame(with_margins(chunks, size, frame, hop, keys), size, frame, hop, features, "classes array<double>", keys)
    return found.groupBy(*keys).agg(F.array(*[F.avg(F.get("classes", F.lit(i))) for i in range(12)]).alias("chroma"))


def decibels(frames: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """frames of ``spectra`` with db, the mel powers in decibels, at most ``RANGE_DB`` below the signal's greatest.

    The greatest is one row a signal; frames are read twice, so hand in a written table.
    """
    db = lambda x: 10 * F.log10(F.greatest(x, F.lit(LEAST_POWER)))
    loudest = frames.groupBy(*keys).agg(F.max(F.array_max("mel")).alias("_most"))
    same = [F.col(f"f.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]
    floor = db(F.col("_most")) - RANGE_DB
    return frames.alias("f").join(loudest.alias("m"), same).select("f.*", F.transform("mel", lambda x: F.greatest(db(x), floor)).alias("db"))


def mfcc(heard: DataFrame, bands: int = BANDS, n: int = COEFFICIENTS, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, mfcc): the mean over frames of the first n cosine coefficients (orthonormal) of the decibels by band.

    As the transform is linear, it is made of the bands' means.
    """
    means = heard.select(*keys, F.posexplode("db").alias("band", "v")).groupBy(*keys, "band").agg(F.avg("v").alias("v"))
    scale = lambda k: math.sqrt((1 if k == 0 else 2) / bands)
    return means.groupBy(*keys).agg(F.array(*[F.sum(F.col("v") * F.cos((F.col("band") + 0.5) * (math.pi * k / bands))) * scale(k) for k in range(n)]).alias("mfcc"))


def onsets(heard: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, onset): by frame, the mean over bands of the decibels' rise since the frame before; one array a signal, as short as its frames."""
    before = F.lag("db").over(Window.partitionBy(*keys).orderBy("frame"))
    rise = F.aggregate(F.zip_with("db", "_b", lambda a, b: F.greatest(a - b, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v) / F.size("db")
    risen = heard.withColumn("_b", before).select(*keys, F.struct("frame", F.coalesce(rise, F.lit(0.0)).alias("v")).alias("_o"))
    return risen.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("_o")), lambda o: o["v"]).alias("onset"))


def period_scores(onset: np.ndarray, per_second: float, least: float = 30.0, most: float = 300.0, middle: float = 120.0) -> np.ndarray:
    """By lag in frames, how well it fits as the beat's period; -1 for lags of other tempi.

    The autocorrelation loses what a half, third, fourth or fifth of the lag
    has too (else multiples of the period would do as well), and is weighted by
    a log-normal prior around ``middle`` beats a minute, an octave wide.
    """
    n = len(onset)
    level = onset - onset.mean() if n else onset
    size = 1 << max(1, (2 * n).bit_length())
    power = np.abs(np.fft.rfft(level, size)) ** 2
    own = np.maximum(0, np.fft.irfft(power, size)[:n])
    scores = np.full(n, -1.0)
    lags = np.arange(1, n)
    if n < 2 or own[0] <= 0:
        return scores
    own = own / own[0]
    bpm = 60 * per_second / lags
    within = (bpm >= least) & (bpm <= most)
    part = np.max([np.interp(lags / m, np.arange(n), own) for m in (2, 3, 4, 5)], axis=0)
    scores[1:][within] = (np.maximum(0, own[1:] - part) * np.exp(-0.5 * np.log2(bpm / middle) ** 2))[within]
    return scores


def tempo(onset: np.ndarray, per_second: float) -> float:
    """Beats a minute of the best lag, made finer by the peaks at its multiples; 0 without any."""
    scores = period_scores(onset, per_second)
    if not len(scores) or scores.max() <= 0:
        return 0.0
    period = float(scores.argmax())
    level = onset - onset.mean()
    own = np.correlate(level, level, "full")[len(level) - 1 :]
    times = 1
    while (2 * times + 1) * period < len(own) / 2:  # so far the next peak is within half a period of where it is looked for
        times *= 2
        around = np.arange(max(1, round(times * period - times / 2 - 1)), min(len(own), round(times * period + times / 2 + 2)))
        if times >= period / 4:
            around = np.arange(round(times * period - period / 4), round(times * period + period / 4) + 1)
        peak = around[own[around].argmax()]
        if own[peak] <= 0:
            break
        period = peak / times
    return 60 * per_second / period


def beats(onset: np.ndarray, period: float, tightness: float = 100.0) -> np.ndarray:
    """Frames of the beats: the sequence with the most onset, less ``tightness`` times the squared log of each step over the period (dynamic programming)."""
    n = len(onset)
    spread = onset.std() if n else 0.0
    if not spread or period <= 0:
        return np.zeros(0, dtype=np.int64)
    around = np.arange(-round(period), round(period) + 1)
    local = np.convolve(onset / spread, np.exp(-0.5 * (around * 32 / period) ** 2), "full")[round(period) : round(period) + n]
    steps = np.arange(max(1, round(period / 2)), round(2 * period) + 1)
    cost = tightness * np.log(steps / period) ** 2
    score, link = local.copy(), np.full(n, -1)
    for i in range(int(steps[0]), n):
        known = steps[steps <= i]
        before = score[i - known] - cost[: len(known)]
        best = before.argmax()
        if before[best] > 0:
            score[i], link[i] = local[i] + before[best], i - known[best]
    found = [int(np.arange(n)[max(0, n - round(2 * period)) :][score[max(0, n - round(2 * period)) :].argmax()])]
    while link[found[-1]] >= 0:
        found.append(int(link[found[-1]]))
    at = np.array(found[::-1])
    heard = local[at] >= 0.5 * np.sqrt(np.mean(local[at] ** 2))  # weak beats at either end go
    return at[heard.argmax() : len(at) - heard[::-1].argmax()] if heard.any() else at[:0]


def rhythm(envelopes: DataFrame, rate: int = RATE, hop: int = HOP, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, bpm, n_beats, lag) of onset envelopes; lag is the period in frames before it is made finer. All are 0 where nothing recurs."""
    kinds = dict(envelopes.dtypes)
    per_second = rate / hop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for i in range(b.num_rows):
                onset = b.column("onset")[i].values.to_numpy(zero_copy_only=False)
                bpm = tempo(onset, per_second)
                found.append((bpm, len(beats(onset, 60 * per_second / bpm)) if bpm else 0, int(period_scores(onset, per_second).argmax()) if bpm else 0))
            values = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.float64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *values], names=[*keys, "bpm", "n_beats", "lag"])

    return envelopes.select(*keys, "onset").mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "bpm double", "n_beats long", "lag long"]))


def analysed(chunks: DataFrame, size: int, rate: int = RATE, frame: int = FRAME, hop: int = HOP, bands: int = BANDS, chroma_frame: int = CHROMA_FRAME) -> DataFrame:
    """One row for every (song_id, stem_type) of chunks, with the columns of ``audio.analyse`` (error is null).

    Frames are written once, as loudest bands, means and onsets read them. A
    signal without samples has no row.
    """
    from cadenza.functions.scalars import bpm_confidence

    chunks = chunks.select(*KEYS, "chunk", F.col("samples").cast("array<double>").alias("samples"))
    frames = written(spectra(chunks, size, rate, frame, hop, bands), "frames")
    heard = decibels(frames)
    means = frames.groupBy(*KEYS).agg(*[F.avg(c).alias(c) for c in ("rms", "crossings", "energy", "centroid", "rolloff")])
    lengths = chunks.groupBy(*KEYS).agg(F.sum(F.size("samples")).alias("n_samples"))
    parts = [means, lengths, mfcc(heard, bands), chroma(chunks, size, rate, chroma_frame, hop), rhythm(onsets(heard), rate, hop)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.join(p, list(KEYS))
    keyed = whole.withColumn("_key", detect_key(F.col("chroma")))
    return keyed.select(
        *KEYS, F.round("bpm", 2).alias("bpm"), bpm_confidence(F.col("n_beats"), F.col("n_samples")).alias("bpm_confidence"), "_key.*", F.round("rms", 6).alias("loudness_rms"),
        F.round("energy", 6).alias("energy"), F.transform("mfcc", lambda x: F.round(x, 4)).alias("mfcc"), F.round("centroid", 2).alias("spectral_centroid"),
        F.round("rolloff", 2).alias("spectral_rolloff"), F.round("crossings", 6).alias("zero_crossing_rate"), F.lit(None).cast("string").alias("error"),
    )
