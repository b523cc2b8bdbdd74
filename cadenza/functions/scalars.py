"""Scalar functions as Column expressions; every one is total (no error on null or malformed input)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.constants import ATTEMPTS, CAMELOT_MAJOR, CAMELOT_MINOR, KEY_NAMES, PREVIEW_KB, PREVIEW_SECS, SEARCH_RESULTS, SEARCH_SUFFIXES, SEMITONES, MatchConfig


def _d(x: float) -> Column:
    return F.lit(float(x))


def _lookup(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def duration_str(secs: Column) -> Column:
    """h:mm:ss or m:ss of seconds rounded half to even; '' for null, zero and negative ones."""
    n = F.bround(secs, 0).cast("long")
    hours, minutes, rest = F.floor(n / 3600), F.floor(n % 3600 / 60), n % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    short = F.concat(F.floor(n / 60).cast("string"), F.lit(":"), two(rest))
    return F.when(secs.isNull() | (secs <= 0), "").when(hours > 0, F.concat(hours.cast("string"), F.lit(":"), two(minutes), F.lit(":"), two(rest))).otherwise(short)


def file_name_part(name: Column, most: int = 40) -> Column:
    """Letters, digits, spaces and hyphens only; runs of spaces and hyphens become one underscore; cut."""
    kept = F.trim(F.regexp_replace(text_or_empty(name), r"(?U)[^\w\s-]", ""))
    return F.substring(F.regexp_replace(kept, r"(?U)[\s-]+", "_"), 1, most)


def download_name(title: Column, artist: Column) -> Column:
    return F.concat(file_name_part(title), F.lit("_"), file_name_part(artist), F.lit(".mp3"))


def stem_file_name(title: Column, artist: Column, suffix: str) -> Column:
    part = lambda c, n: F.substring(F.regexp_replace(text_or_empty(c), r"(?U)[^\w]", "_"), 1, n)
    return F.concat(part(title, 40), F.lit("_"), part(artist, 30), F.lit(f"_{suffix}.wav"))


def folder_name_part(name: Column, most: int = 40) -> Column:
    """Other characters than letters, digits and underscores become one underscore; 'unknown' if nothing is left."""
    joined = F.regexp_replace(F.regexp_replace(text_or_empty(name), r"(?U)[^\w]", "_"), "_+", "_")
    cut = F.substring(F.regexp_replace(joined, "^_+|_+$", ""), 1, most)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("unknown"))


def session_folder(rank: Column, vocal: Column, inst: Column) -> Column:
    named = lambda c, empty: folder_name_part(F.coalesce(F.nullif(c, F.lit("")), F.lit(empty)))
    number = F.when(rank < 10, F.lpad(rank.cast("string"), 2, "0")).otherwise(rank.cast("string"))
    return F.concat(number, F.lit("_"), named(vocal, "vocal"), F.lit("_over_"), named(inst, "inst"))


def clean_title(title: Column) -> Column:
    """Without bracketed parts."""
    return F.trim(F.regexp_replace(text_or_empty(title), r"\s*[\(\[].*?[\)\]]", ""))


def is_youtube_like(url: Column) -> Column:
    u = F.lower(F.trim(text_or_empty(url)))
    return u.startswith("ytsearch") | u.contains("youtube.com/") | u.contains("youtu.be/") | u.contains("music.youtube.com")


def search_queries(title: Column, artist: Column) -> Column:
    """The ordered fallback searches."""
    lead = F.concat(F.lit(f"ytsearch{SEARCH_RESULTS}:"), text_or_empty(artist), F.lit(" "), clean_title(title))
    return F.array(*[F.concat(lead, F.lit(s)) for s in SEARCH_SUFFIXES])


def attempts() -> Column:
    """The ordered download attempts."""
    return F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(a).alias("label"), F.lit(b).alias("format"), F.lit(c).alias("extractor_args"), F.lit(d).alias("use_cookies")) for i, (a, b, c, d) in enumerate(ATTEMPTS)])


def probed_duration(probe_secs: Column, size_bytes: Column) -> Column:
    """The probe's seconds; without one, 30 for a small file, else null."""
    return F.coalesce(probe_secs, F.when(size_bytes / 1024 < PREVIEW_KB, _d(30.0)))


def download_state(origin: Column, secs: Column) -> Column:
    """'full', 'preview' or 'redo' by where a file comes from (existing, fresh, fallback) and its length, if known."""
    long = secs > PREVIEW_SECS
    existing = F.when(long, "full").otherwise("redo")
    fresh = F.when(secs <= PREVIEW_SECS, "preview").otherwise("full")
    fallback = F.when(long, "full").otherwise("preview")
    return F.when(origin == "existing", existing).when(origin == "fresh", fresh).otherwise(fallback)


def semitone(key: Column) -> Column:
    return F.try_element_at(_lookup(SEMITONES), key)


def semitone_shift(vocal_key: Column, inst_key: Column) -> Column:
    """Semitones, -5 to 6, from the instrumental's key to the vocal's; null if either is unknown."""
    up = F.pmod(semitone(vocal_key) - semitone(inst_key), F.lit(12))
    return F.when(up > 6, up - 12).otherwise(up)


def camelot_of(index: Column, mode: Column) -> Column:
    """The Camelot code of a key number and mode; '?' if there is none."""
    code = lambda codes: F.get(F.array(*[F.lit(c) for c in codes]), index.cast("int"))
    return F.coalesce(F.when(mode == "major", code(CAMELOT_MAJOR)).when(mode == "minor", code(CAMELOT_MINOR)), F.lit("?"))


def key_of_camelot(camelot: Column) -> tuple[Column, Column]:
    """(key, mode) of a Camelot code; nulls if it is none of the 24."""
    names = {c: k for codes in (CAMELOT_MAJOR, CAMELOT_MINOR) for k, c in zip(KEY_NAMES, codes)}
    modes = {c: m for m, codes in (("major", CAMELOT_MAJOR), ("minor", CAMELOT_MINOR)) for c in codes}
    return F.try_element_at(_lookup(names), camelot), F.try_element_at(_lookup(modes), camelot)


def camelot_parts(code: Column) -> tuple[Column, Column]:
    """A Camelot code's number (null: unknown) and last letter."""
    number = F.expr("1") * F.substring(code, 1, F.greatest(F.length(code) - 1, F.lit(0))).try_cast("int")
    return number, F.right(code, F.lit(1))


def camelot_score(c1: Column, c2: Column) -> Column:
    """How well two keys go together: 1 same, .85 a step, .75 relative, .55 two steps, .25 otherwise, .5 if one is unknown."""
    return camelot_parts_score(*camelot_parts(c1), *camelot_parts(c2))


def camelot_parts_score(n1: Column, l1: Column, n2: Column, l2: Column) -> Column:
    apart = F.abs(n1 - n2)
    known = n1.isNotNull() & n2.isNotNull()
    return (
        F.when(~F.coalesce(known, F.lit(False)), _d(0.5))
        .when((n1 == n2) & (l1 == l2), _d(1.0))
        .when((l1 == l2) & apart.isin(1, 11), _d(0.85))
        .when((n1 == n2) & (l1 != l2), _d(0.75))
        .when((l1 == l2) & apart.isin(2, 10), _d(0.55))
        .otherwise(_d(0.25))
    )


def bpm_min_diff(b1: Column, b2: Column) -> Column:
    """The least distance of b1 from b2, half of it and twice it (so not symmetric); 999 if either isn't positive or is null."""
    b1, b2 = F.coalesce(b1, _d(0)), F.coalesce(b2, _d(0))
    return F.when((b1 <= 0) | (b2 <= 0), _d(999)).otherwise(F.least(F.abs(b1 - b2), F.abs(b1 - b2 / 2.0), F.abs(b1 - b2 * 2.0)))


def bpm_score(b1: Column, b2: Column) -> Column:
    return bpm_score_of(bpm_min_diff(b1, b2))


def bpm_score_of(d: Column) -> Column:
    """The score of a ``bpm_min_diff``."""
    steps = [(0.5, 1.0), (3.0, 0.95), (6.0, 0.85), (10.0, 0.65), (15.0, 0.40), (25.0, 0.20)]
    out = F.when(d < steps[0][0], _d(steps[0][1]))
    for under, score in steps[1:]:
        out = out.when(d < under, _d(score))
    return out.otherwise(F.greatest(_d(0), _d(0.20) - (d - 25.0) / 100.0))


def loudness(rms: Column, energy: Column) -> Column:
    """RMS, or the energy where RMS is null or zero."""
    return F.coalesce(F.nullif(rms, _d(0)), energy)


def energy_score(e1: Column, e2: Column) -> Column:
    ratio = F.least(e1, e2) / F.greatest(e1, e2)
    known = F.coalesce((e1 > 0) & (e2 > 0), F.lit(False))
    return F.when(known, F.exp(-((1.0 - ratio) * (1.0 - ratio)) / (2.0 * 0.25 * 0.25))).otherwise(_d(0.5))


def _dot(x: Column, y: Column, length: int | None = None) -> Column:
    """Of vectors of one length. length: a usual one, at which places are added one by one, in the same order but in compiled code.

    The other branch isn't compiled, which also keeps a projection of pairs out
    of the one method that Spark makes of a stage: that would be longer than
    the 8,000 bytes up to which Java compiles a method.
    """
    some = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), _d(0), lambda s, v: s + v)
    if length is None:
        return some
    return F.when(F.size(x) == length, sum((F.get(x, F.lit(k)) * F.get(y, F.lit(k)) for k in range(length)), _d(0))).otherwise(some)


def mfcc_norm(v: Column) -> Column:
    return F.sqrt(_dot(v, v))


def mfcc_cosine(a: Column, b: Column) -> Column:
    """The cosine, clipped to 0..1; .5 if one is missing or empty, 0 if one is zero; unequal lengths raise."""
    return mfcc_cosine_of(a, b, mfcc_norm(a), mfcc_norm(b))


def mfcc_cosine_of(a: Column, b: Column, norm_a: Column, norm_b: Column, length: int | None = None) -> Column:
    """``mfcc_cosine`` with the norms given. length: a usual one."""
    norms = norm_a * norm_b
    missing = F.coalesce((F.size(a) <= 0) | (F.size(b) <= 0), F.lit(True))
    return (
        F.when(missing, _d(0.5))
        .when(F.size(a) != F.size(b), F.raise_error("vectors of different lengths").cast("double"))
        .when(norms == 0, _d(0.0))
        .otherwise(F.least(_d(1.0), F.greatest(_d(0.0), F.try_divide(_dot(a, b, length), norms))))
    )


def rounded(x: Column, digits: int) -> Column:
    """``F.round``, which makes a decimal of every number, only where x is close to a half or isn't small; the same result elsewhere."""
    scale = 10.0**digits
    scaled = x * scale
    plain = (F.abs(scaled - F.rint(scaled)) < 0.4999) & (F.abs(scaled) < 1e11)
    return F.when(plain, F.rint(scaled) / scale + 0.0).otherwise(F.round(x, digits))


def total_score(bpm: Column, key: Column, energy: Column, timbre: Column, config: MatchConfig) -> Column:
    w = {k: float(v) for k, v in (config.weights or MatchConfig().weights).items()}
    parts = [(n, c) for n, c in (("bpm", bpm), ("key", key), ("energy", energy), ("timbre", timbre))]
    return rounded(sum((c * w.get(n, 0.0) for n, c in parts[1:]), parts[0][1] * w.get("bpm", 0.0)), 4)


def bpm_stretch(vocal_bpm: Column, inst_bpm: Column) -> Column:
    return F.round(F.try_divide(inst_bpm, vocal_bpm), 4)


def bpm_confidence(beats: Column, samples: Column, hop: int = 512) -> Column:
    """Beats per frame, 1 at most; null for no samples."""
    return F.least(F.try_divide(beats.cast("double"), samples / float(hop)), _d(1.0))
