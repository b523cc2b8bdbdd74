"""Reports of ranked pairs: rows as DataFrames, texts formatted on the driver from at most ``n`` rows."""

from __future__ import annotations

import csv
import json
import shutil
from pathlib import Path

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from cadenza.constants import INSTRUMENTAL_OVER_INSTRUMENTAL, VOCAL_OVER_INSTRUMENTAL
from cadenza.functions import scalars as S
from cadenza.operators.rank import ranked, top_per_combo

# The columns of the CSV report, in order.
CSV_FIELDS = (
    "rank combo_type vocal_title vocal_artist inst_title inst_artist vocal_bpm inst_bpm bpm_stretch_ratio vocal_key vocal_mode inst_key inst_mode "
    "vocal_camelot inst_camelot semitone_shift score_total score_bpm score_key score_energy score_timbre vocal_wav_path inst_wav_path"
).split()
#: Columns of the catalogue report.
SONG_COLUMNS = "id title artist status genre source_url track_id duration_secs duration_str plays likes upload_date".split()
FEATURE_COLUMNS = "bpm bpm_confidence key mode camelot loudness_rms energy spectral_centroid spectral_rolloff zero_crossing_rate mfcc_json".split()
# The names of the kinds of pairs, and the layout of a match's text in format_results.
LABELS = {VOCAL_OVER_INSTRUMENTAL: "Vocals → Instrumental", INSTRUMENTAL_OVER_INSTRUMENTAL: "Instrumental → Instrumental"}


def shown_path(path: Column, exists: Column) -> Column:
    return F.when(F.coalesce(path, F.lit("")) == "", "FILE_MISSING").when(exists, path).otherwise(F.concat(F.lit("FILE_MISSING:"), path))


def with_stem_paths(pairs: DataFrame, stems: DataFrame, top_layer: str = "vocals") -> DataFrame:
    """pairs with vocal_wav_path and inst_wav_path; the top layer's file is its ``top_layer`` stem for either combo type ('own': by combo type)."""
    paths = lambda kind, key, name: stems.filter(F.col("stem_type") == kind).select(F.col("song_id").alias(key), F.col("file_path").alias(name))
    out = pairs.join(paths("vocals", "vocal_song_id", "vocal_wav_path"), "vocal_song_id", "left").join(paths("instrumental", "inst_song_id", "inst_wav_path"), "inst_song_id", "left")
    if top_layer == "own":
        out = out.join(paths("instrumental", "vocal_song_id", "_own"), "vocal_song_id", "left")
        out = out.withColumn("vocal_wav_path", F.when(F.col("combo_type") == INSTRUMENTAL_OVER_INSTRUMENTAL, F.col("_own")).otherwise(F.col("vocal_wav_path"))).drop("_own")
    return out


def export_rows(candidates: DataFrame, stems: DataFrame, files: DataFrame | None = None, n: int = 20) -> DataFrame:
    """The CSV report's rows; files (path): those that exist (None: all)."""
    rows = with_stem_paths(ranked(candidates, n), stems)
    rows = rows.withColumn("bpm_stretch_ratio", S.bpm_stretch(F.col("vocal_bpm"), F.col("inst_bpm"))).withColumn("semitone_shift", S.semitone_shift(F.col("vocal_key"), F.col("inst_key")))
    for name in ("vocal_wav_path", "inst_wav_path"):
        exists = F.col(name).isNotNull()
        if files is not None:
            rows = rows.join(files.select(F.col("path").alias("_path")).distinct(), F.col(name) == F.col("_path"), "left")
            exists = F.col("_path").isNotNull()
        rows = rows.withColumn(name, shown_path(F.col(name), exists)).drop("_path")
    return rows.select(*CSV_FIELDS)


def session_plan(candidates: DataFrame, stems: DataFrame, n: int = 10) -> DataFrame:
    """(rank, folder, ...): the folders of the first n vocal-over-instrumental pairs."""
    rows = with_stem_paths(ranked(candidates.filter(F.col("combo_type") == VOCAL_OVER_INSTRUMENTAL), n), stems)
    return rows.withColumn("folder", S.session_folder(F.col("rank"), F.col("vocal_title"), F.col("inst_title"))).withColumn("bpm_stretch_ratio", S.bpm_stretch(F.col("vocal_bpm"), F.col("inst_bpm"))).withColumn("semitone_shift", S.semitone_shift(F.col("vocal_key"), F.col("inst_key")))


def report_features(songs: DataFrame, features: DataFrame) -> DataFrame:
    """Every song with its stems' features (none: nulls), by id and stem; of both, the report's columns that the tables have."""
    own = features.select("song_id", "stem_type", *[c for c in FEATURE_COLUMNS if c in features.columns])
    rows = songs.select(*[c for c in SONG_COLUMNS if c in songs.columns]).join(own, F.col("id") == F.col("song_id"), "left").drop("song_id")
    return rows.orderBy("id", F.col("stem_type").asc_nulls_first())


def report_text(songs: DataFrame, features: DataFrame, candidates: DataFrame, n: int = 20) -> str:
    """The first n songs with their features and the best 20 pairs of either kind, as text; says how many songs there are and are shown."""
    total = songs.count()
    first = songs.orderBy("id").limit(n)
    rows = report_features(first, features.join(first.select(F.col("id").alias("song_id")), "song_id", "left_semi")).collect()
    lines, last = [f"Songs: {total} (shown: {min(n, total)})"], None
    for r in (x.asDict() for x in rows):
        if r["id"] != last:
            last = r["id"]
            length = r.get("duration_str") or (f"{r['duration_secs']:.0f}s" if r.get("duration_secs") else "—")
            lines += ["", f"[{r['id']:>2}] {r['title']} — {r['artist']}", f"     {r['status']}  |  {r.get('genre') or '—'}  |  {r.get('source_url') or '—'}"]
            lines.append(f"     track {r.get('track_id') or '—'}  length {length}  plays {_plain(r.get('plays'))}  likes {_plain(r.get('likes'))}  upload {r.get('upload_date') or '—'}")
        if r["stem_type"]:
            mfcc = [round(x, 1) for x in json.loads(r.get("mfcc_json") or "[]")]
            lines.append(f"     {r['stem_type']:>12}: {_plain(r['bpm'])} BPM (confidence {_num(r.get('bpm_confidence'), '.3f')})  {_plain(r['key'])} {_plain(r['mode'])} {_plain(r['camelot'])}  RMS {_plain(r['loudness_rms'])}  energy {_plain(r['energy'])}")
            lines.append(f"                   centroid {_plain(r.get('spectral_centroid'))}  rolloff {_plain(r.get('spectral_rolloff'))}  ZCR {_plain(r.get('zero_crossing_rate'))}" + (f"  MFCC {mfcc}" if mfcc else ""))
    sizes = {r["combo_type"]: r["n"] for r in candidates.groupBy("combo_type").agg(F.count("*").alias("n")).collect()}
    best = top_per_combo(candidates, 20).orderBy("combo_type", "rank").collect()
    for combo, label in LABELS.items():
        own = [r.asDict() for r in best if r["combo_type"] == combo]
        if own:
            lines += ["", f"{label}: {sizes[combo]} pairs (shown: {len(own)})"]
            lines += [f"  {_num(r['score_total'], '.3f')}  {_scores(r, '  ')}  {r['vocal_title']} — {r['vocal_artist']} [{_plain(r['vocal_bpm'])} BPM {_plain(r['vocal_camelot'])}] over {r['inst_title']} — {r['inst_artist']} [{_plain(r['inst_bpm'])} BPM {_plain(r['inst_camelot'])}]" for r in own]
    return "\n".join(lines) + "\n"


def _plain(x: object) -> str:
    return "—" if x is None else str(x)


def report_pairs(candidates: DataFrame, n: int = 20) -> DataFrame:
    return top_per_combo(candidates, n).select("combo_type", "rank", "vocal_song_id", "inst_song_id", "score_total")


def _num(x: float | None, form: str) -> str:
    return "—" if x is None else format(x, form)


def _shift(x: int | None) -> str:
    return "?" if x is None else f"{x:+d}"


def format_results(rows: list[Row], seed_title: str = "", combo_type: str = "") -> str:
    """A text block for each match of a seed."""
    lines = []
    if seed_title:
        lines += [f"\n{'=' * 60}", f"  Seed: {seed_title}  [{LABELS.get(combo_type, 'Matches')}]", "=" * 60]
    if not rows:
        return "\n".join([*lines, "  No qualifying matches found for this seed.", "  (Check bpm_max and key_min)"])
    for i, r in enumerate(rows, 1):
        r = r.asDict()
        of = lambda side, n: r.get(f"{side}_{n}", "?")  # noqa: E731, B023
        name = lambda side: f"{of(side, 'title')} — {of(side, 'artist')}  [{of(side, 'bpm')} BPM  {of(side, 'camelot')}]"  # noqa: E731, B023
        lines.append(f"\n  #{i:>2}  TOP:   {name('vocal')}\n       BED:   {name('inst')}\n       Score: {_num(_score(r, 'total'), '.3f')}  |  {_scores(r, '  ')}")
    return "\n".join(lines)


def _score(r: dict, name: str) -> float | None:
    """A score by its stored name or, where that is missing, null or 0, by the name it has in unstored results; 0 for none."""
    return r.get(f"score_{name}") or r.get("total" if name == "total" else f"{name}_score", 0)


def _scores(r: dict, gap: str) -> str:
    return gap.join(f"{n}: {_num(_score(r, n.lower()), '.2f')}" for n in ("BPM", "Key", "Energy", "Timbre"))


def pair_lines(r: dict) -> list[str]:
    """A pair for people: what it is, its layers, what to do to the lower layer so that tempo and pitch fit, and the files."""
    layer = lambda side: f"{r[side + '_title'] or '?'} — {r[side + '_artist'] or '?'} | {_num(r[side + '_bpm'], '.2f')} BPM | {r[side + '_key'] or '?'} {r[side + '_mode'] or '?'} | {r[side + '_camelot'] or '?'}"
    stretch, shift = r["bpm_stretch_ratio"], r["semitone_shift"]
    way = "" if not shift else " (up)" if shift > 0 else " (down)"
    return [
        f"Rank {r['rank']}: {r['combo_type']}",
        f"  SCORE: {_num(r['score_total'], '.3f')} = {_scores(r, ', ')}",
        f"  Upper layer: {layer('vocal')}",
        f"  Lower layer: {layer('inst')}",
        f"  Tempo: play the lower layer at {f'{stretch:.4f}x' if stretch else '?'}, so that it runs at {_num(r['vocal_bpm'], '.2f')} BPM",
        f"  Pitch: move the lower layer by {_shift(shift)} semitones{way}",
        f"  Upper file: {r['vocal_wav_path'] or 'missing'}",
        f"  Lower file: {r['inst_wav_path'] or 'missing'}",
    ]


def write_report(rows: DataFrame, path: str) -> bool:
    """Writes ``path`` as .csv and .txt from ``export_rows``; no rows: writes nothing and returns False."""
    found = [r.asDict() for r in rows.orderBy("rank").collect()]
    if not found:
        return False
    with Path(path).with_suffix(".csv").open("w", newline="", encoding="utf-8") as f:
        out = csv.DictWriter(f, CSV_FIELDS)
        out.writeheader()
        out.writerows(found)
    text = "\n\n".join("\n".join(pair_lines(r)) for r in found)
    Path(path).with_suffix(".txt").write_text(f"{text}\n", encoding="utf-8")
    return True


def link_or_copy(source: Path, target: Path) -> None:
    """Puts a link at target, or a copy where links can't be made; what was there goes."""
    target.unlink(missing_ok=True)
    try:
        target.symlink_to(source.resolve())
    except OSError:
        shutil.copy2(source, target)


def write_sessions(plan: DataFrame, folder: str) -> int:
    """One folder a pair of ``session_plan`` with links and a text; a README if there is none."""
    found = [r.asDict() for r in plan.orderBy("rank").collect()]
    top = Path(folder)
    top.mkdir(parents=True, exist_ok=True)
    if not found:
        (top / "README.txt").write_text("No qualifying pairs yet.\n", encoding="utf-8")
    for r in found:
        own = top / r["folder"]
        own.mkdir(exist_ok=True)
        lines = pair_lines(r)
        for column, name in (("vocal_wav_path", "vocals.wav"), ("inst_wav_path", "instrumental.wav")):
            if r[column] and Path(r[column]).exists():
                link_or_copy(Path(r[column]), own / name)
            else:
                lines.append(f"  Warning: {name} isn't here, as its source is missing: {r[column]}")
        (own / "session_info.txt").write_text("\n".join(lines) + "\n", encoding="utf-8")
    return len(found)
