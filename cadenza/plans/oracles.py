"""DuckDB SQL of the registered queries, written by hand from the definitions, not from the plans."""

from __future__ import annotations

_FIXTURES = r"""
stem_kinds(o, stem_type) AS (VALUES (0, 'full'), (1, 'vocals'), (2, 'instrumental')),
songs0 AS (
  SELECT p_partkey + 1 AS id, p_name AS title, p_brand AS artist, p_type AS genre, 'https://example.invalid/t/' || p_partkey AS source_url, p_retailprice / 4 AS duration_secs,
    (['queued', 'downloaded', 'stemmed', 'analysed', 'error'])[p_size % 5 + 1] AS status FROM part),
songs AS (
  SELECT *, CASE WHEN status IN ('queued', 'error') THEN '' ELSE '/raw/' || id || '.mp3' END AS raw_path, DUR(duration_secs) AS duration_str FROM songs0),
stems AS (SELECT (s.id - 1) * 3 + o + 1 AS id, s.id AS song_id, stem_type, '/stems/' || stem_type || '/' || s.id AS file_path FROM songs s, stem_kinds WHERE s.id % 11 <> 0),
wheel(key, mode, camelot) AS (VALUES
  ('C','major','8B'),('C#','major','3B'),('D','major','10B'),('D#','major','5B'),('E','major','12B'),('F','major','7B'),('F#','major','2B'),('G','major','9B'),('G#','major','4B'),('A','major','11B'),('A#','major','6B'),('B','major','1B'),
  ('C','minor','5A'),('C#','minor','12A'),('D','minor','7A'),('D#','minor','2A'),('E','minor','9A'),('F','minor','4A'),('F#','minor','11A'),('G','minor','6A'),('G#','minor','1A'),('A','minor','8A'),('A#','minor','3A'),('B','minor','10A')),
features0 AS (
  SELECT vec_id * 3 + o + 1 AS id, vec_id + 1 AS song_id, stem_type, CASE WHEN vec_id % 97 = 0 THEN NULL ELSE CAST(60 AS DOUBLE) + ((37 * vec_id + 11 * o) % 1200) / CAST(10 AS DOUBLE) END AS bpm,
    CASE WHEN vec_id % 89 = 0 THEN NULL WHEN vec_id % 83 = 0 THEN '?' ELSE (1 + (7 * vec_id + o) % 12) || CASE WHEN label % 2 = 0 THEN 'A' ELSE 'B' END END AS camelot,
    CASE WHEN vec_id % 79 = 0 THEN NULL ELSE (1 + (13 * vec_id + o) % 500) / CAST(1000 AS DOUBLE) END AS loudness_rms, CAST(1 + (17 * vec_id + o) % 300 AS DOUBLE) AS energy,
    CASE WHEN vec_id % 73 = 0 THEN NULL ELSE CAST(list_slice(embedding, 1 + 13 * o, 13 + 13 * o) AS DOUBLE[]) END AS mfcc FROM embeddings, stem_kinds),
features AS (SELECT f.*, w.key, w.mode FROM features0 f LEFT JOIN wheel w USING (camelot)),
named AS (SELECT f.*, s.title, s.artist FROM features f JOIN songs s ON s.id = f.song_id)"""

_PAIRS = r""",
sides AS (
  SELECT 'vocal_over_instrumental' AS combo_type, a AS v, b AS i FROM named a, named b WHERE a.stem_type = 'vocals' AND b.stem_type = 'instrumental' AND a.song_id <> b.song_id
  UNION ALL SELECT 'instrumental_over_instrumental', a, b FROM named a, named b WHERE a.stem_type = 'instrumental' AND b.stem_type = 'instrumental' AND a.song_id < b.song_id),
measured AS (SELECT *, BPMDIFF(v.bpm, i.bpm) AS d, KEYSCORE(v.camelot, i.camelot) AS score_key FROM sides),
scored AS (
  SELECT *, BPMSCORE(d) AS score_bpm, ENERGY(coalesce(nullif(v.loudness_rms, 0), v.energy), coalesce(nullif(i.loudness_rms, 0), i.energy)) AS score_energy, COSINE(v.mfcc, i.mfcc) AS score_timbre
  FROM measured WHERE d <= 10 AND score_key >= 0.55),
candidates AS (
  SELECT combo_type, v.song_id AS vocal_song_id, v.title AS vocal_title, v.artist AS vocal_artist, v.bpm AS vocal_bpm, v.key AS vocal_key, v.mode AS vocal_mode, v.camelot AS vocal_camelot,
    i.song_id AS inst_song_id, i.title AS inst_title, i.artist AS inst_artist, i.bpm AS inst_bpm, i.key AS inst_key, i.mode AS inst_mode, i.camelot AS inst_camelot,
    round(score_bpm * CAST(0.25 AS DOUBLE) + score_key * CAST(0.3 AS DOUBLE) + score_energy * CAST(0.2 AS DOUBLE) + score_timbre * CAST(0.25 AS DOUBLE), 4) AS score_total,
    score_bpm, score_key, score_energy, score_timbre FROM scored)"""

_MACROS = {
    "DUR": lambda x: f"(CASE WHEN {x} IS NULL OR {x} <= 0 THEN '' WHEN round_even({x}, 0) >= 3600 THEN (CAST(round_even({x}, 0) AS BIGINT) // 3600) || ':' || lpad(CAST(CAST(round_even({x}, 0) AS BIGINT) % 3600 // 60 AS VARCHAR), 2, '0') ELSE CAST(CAST(round_even({x}, 0) AS BIGINT) // 60 AS VARCHAR) END || CASE WHEN {x} IS NULL OR {x} <= 0 THEN '' ELSE ':' || lpad(CAST(CAST(round_even({x}, 0) AS BIGINT) % 60 AS VARCHAR), 2, '0') END)",
    "BPMDIFF": lambda a, b: f"(CASE WHEN coalesce({a}, 0) <= 0 OR coalesce({b}, 0) <= 0 THEN CAST(999 AS DOUBLE) ELSE least(abs({a} - {b}), abs({a} - {b} / 2), abs({a} - 2 * {b})) END)",
    "BPMSCORE": lambda d: f"(CAST(CASE WHEN {d} < 0.5 THEN 1 WHEN {d} < 3 THEN 0.95 WHEN {d} < 6 THEN 0.85 WHEN {d} < 10 THEN 0.65 WHEN {d} < 15 THEN 0.4 WHEN {d} < 25 THEN 0.2 ELSE greatest(CAST(0 AS DOUBLE), CAST(0.2 AS DOUBLE) - ({d} - 25) / 100) END AS DOUBLE))",
    "KEYSCORE": lambda a, b: (
        f"(CAST(CASE WHEN try_cast({a}[:-2] AS INTEGER) IS NULL OR try_cast({b}[:-2] AS INTEGER) IS NULL THEN 0.5 WHEN try_cast({a}[:-2] AS INTEGER) = try_cast({b}[:-2] AS INTEGER) AND right({a}, 1) = right({b}, 1) THEN 1 "
        f"WHEN right({a}, 1) = right({b}, 1) AND abs(try_cast({a}[:-2] AS INTEGER) - try_cast({b}[:-2] AS INTEGER)) IN (1, 11) THEN 0.85 WHEN try_cast({a}[:-2] AS INTEGER) = try_cast({b}[:-2] AS INTEGER) THEN 0.75 "
        f"WHEN right({a}, 1) = right({b}, 1) AND abs(try_cast({a}[:-2] AS INTEGER) - try_cast({b}[:-2] AS INTEGER)) IN (2, 10) THEN 0.55 ELSE 0.25 END AS DOUBLE))"
    ),
    "ENERGY": lambda a, b: f"(CASE WHEN coalesce({a}, 0) <= 0 OR coalesce({b}, 0) <= 0 THEN CAST(0.5 AS DOUBLE) ELSE exp(-((1 - least({a}, {b}) / greatest({a}, {b})) ** 2) / (2 * CAST(0.25 AS DOUBLE) * CAST(0.25 AS DOUBLE))) END)",
    "COSINE": lambda a, b: f"(CASE WHEN {a} IS NULL OR {b} IS NULL OR len({a}) = 0 OR len({b}) = 0 THEN CAST(0.5 AS DOUBLE) WHEN DOT({a}, {a}) * DOT({b}, {b}) = 0 THEN CAST(0 AS DOUBLE) ELSE least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), DOT({a}, {b}) / (sqrt(DOT({a}, {a})) * sqrt(DOT({b}, {b}))))) END)",
    "DOT": lambda a, b: f"list_sum(list_transform(range(1, len({a}) + 1), lambda k: {a}[k] * {b}[k]))",
    "SEMI": lambda k: f"(map_from_entries([('C',0),('C#',1),('Db',1),('D',2),('D#',3),('Eb',3),('E',4),('F',5),('F#',6),('Gb',6),('G',7),('G#',8),('Ab',8),('A',9),('A#',10),('Bb',10),('B',11)])[{k}])",
}


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """The arguments after an opening bracket at ``at`` and the place past the closing one."""
    depth, parts, start, i = 0, [], at + 1, at
    while True:
        ch = text[i]
        if ch == "'":
            i = text.index("'", i + 1)
        elif ch in "([":
            depth += 1
        elif ch in ")]":
            depth -= 1
            if not depth:
                return [*parts, text[start:i].strip()], i + 1
        elif ch == "," and depth == 1:
            parts.append(text[start:i].strip())
            start = i + 1
        i += 1


def _sql(body: str, pairs: bool = False, more: str = "") -> str:
    text = f"WITH {_FIXTURES}{_PAIRS if pairs else ''}{more}\n{body}"
    for name, macro in _MACROS.items():
        while (at := text.find(f"{name}(")) >= 0:
            args, end = _arguments(text, at + len(name))
            text = text[:at] + macro(*args) + text[end:]
    return text


_SCORES = "round(score_total, 6) AS score_total, round(score_bpm, 6) AS score_bpm, round(score_key, 6) AS score_key, round(score_energy, 6) AS score_energy, round(score_timbre, 6) AS score_timbre"
_SHORT = f"SELECT combo_type, vocal_song_id, inst_song_id, vocal_title, inst_title, vocal_bpm, inst_bpm, vocal_camelot, inst_camelot, {_SCORES} FROM candidates"
_BEST = "ORDER BY score_total DESC NULLS LAST, combo_type, vocal_song_id, inst_song_id"
_NEXT = ", n AS (SELECT a.song_id, a.bpm AS b1, b.bpm AS b2, coalesce(nullif(a.loudness_rms, 0), a.energy) AS e1, coalesce(nullif(b.loudness_rms, 0), b.energy) AS e2, a.mfcc AS m1, b.mfcc AS m2 FROM features a JOIN features b ON b.song_id - 7 = a.song_id WHERE a.stem_type = 'vocals' AND b.stem_type = 'instrumental')"
_SHIFT = "(CASE WHEN ((SEMI(vocal_key) - SEMI(inst_key)) % 12 + 12) % 12 > 6 THEN ((SEMI(vocal_key) - SEMI(inst_key)) % 12 + 12) % 12 - 12 ELSE ((SEMI(vocal_key) - SEMI(inst_key)) % 12 + 12) % 12 END)"
_CODES = "('8B'),('3B'),('10B'),('5B'),('12B'),('7B'),('2B'),('9B'),('4B'),('11B'),('6B'),('1B'),('5A'),('12A'),('7A'),('2A'),('9A'),('4A'),('11A'),('6A'),('1A'),('8A'),('3A'),('10A'),(''),('?'),('8b'),('B'),('13B'),(NULL)"
_SPELLINGS = "('C'),('C#'),('Db'),('D'),('D#'),('Eb'),('E'),('F'),('F#'),('Gb'),('G'),('G#'),('Ab'),('A'),('A#'),('Bb'),('B'),('H'),(''),(NULL)"
_OPEN = str.maketrans("", "", "()")  # rows of one value as a list
_SONG_BATCH = r""",
batch AS (
  SELECT page_id AS seq, 'T' || page_id AS title, 'A' AS artist, 'g' AS genre, CASE WHEN page_id % 17 = 0 THEN '' ELSE 'https://example.invalid/t/' || (page_id * 3 % 400 * 13) END AS source_url, CAST(page_id AS DOUBLE) AS duration_secs,
    'queued' AS status, CASE WHEN page_id % 2 = 0 THEN '' ELSE '/new/' || page_id END AS raw_path, DUR(CAST(page_id AS DOUBLE)) AS duration_str FROM pages),
folded AS (
  SELECT source_url, min(seq) AS first_seq, max_by(title, seq) AS title, max_by(artist, seq) AS artist, max_by(genre, seq) AS genre, max_by(duration_secs, seq) AS duration_secs, max_by(status, seq) AS status,
    coalesce(max_by(raw_path, seq) FILTER (WHERE raw_path <> ''), '') AS raw_path, max_by(duration_str, seq) AS duration_str FROM batch GROUP BY source_url)"""
_ATTEMPTS = (
    "VALUES (0, 'ios+bestaudio', 'bestaudio/best', 'youtube:player_client=ios', false), (1, 'android_web+bestaudio', 'bestaudio/best', 'youtube:player_client=android,web', false), "
    "(2, 'android_web+ba/b', 'ba/b', 'youtube:player_client=android,web', false), (3, 'cookies+android_web+ba/b', 'ba/b', 'youtube:player_client=android,web', true)")
_STATE = "CASE {0} WHEN 'existing' THEN CASE WHEN secs > 35 THEN 'full' ELSE 'redo' END WHEN 'fresh' THEN CASE WHEN secs <= 35 THEN 'preview' ELSE 'full' END ELSE CASE WHEN secs > 35 THEN 'full' ELSE 'preview' END END"

#: Signals of embeddings in frames of 16 samples at every HOP of them (half a frame of silence before, more after), and the frames' magnitudes by direct sums.
_MAGNITUDES = """
WITH x AS (SELECT vec_id, list_concat([0, 0, 0, 0, 0, 0, 0, 0]::DOUBLE[], CAST(embedding AS DOUBLE[]), [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0]::DOUBLE[]) AS p, len(embedding) AS n FROM embeddings WHERE len(embedding) > 0),
fr AS (SELECT vec_id, i, p[HOP * i + 1 : HOP * i + 16] AS y FROM (SELECT *, unnest(range(0, n // HOP + 1)) AS i FROM x)),
s AS (SELECT vec_id, i, j, y[j + 1] * (0.5 - 0.5 * cos(2 * pi() * j / 16)) AS v FROM fr, range(0, 16) r(j)),
m AS (SELECT vec_id, i, k, sqrt(pow(sum(v * cos(2 * pi() * j * k / 16)), 2) + pow(sum(v * sin(2 * pi() * j * k / 16)), 2)) AS mag FROM s, range(0, 9) q(k) GROUP BY vec_id, i, k)"""
#: Six mel bands of those frames at 8,000 samples a second, in decibels at most 80 below the signal's greatest.
_DECIBELS = _MAGNITUDES + """,
top(mel) AS (SELECT 15 + ln(4) * 27 / ln(6.4)),
edge AS (SELECT b, CASE WHEN mel * b / 7 < 15 THEN mel * b / 7 * 200 / 3 ELSE 1000 * exp((mel * b / 7 - 15) * ln(6.4) / 27) END AS f FROM top, range(0, 8) r(b)),
weights AS (
  SELECT l.b, k, greatest(0, least((500 * k - l.f) / (c.f - l.f), (h.f - 500 * k) / (h.f - c.f))) * 2 / (h.f - l.f) AS w
  FROM edge l JOIN edge c ON c.b = l.b + 1 JOIN edge h ON h.b = l.b + 2, range(0, 9) q(k)),
power AS (SELECT vec_id, i, b, 10 * log10(greatest(sum(mag * mag * w), 1e-10)) AS db FROM m JOIN weights USING (k) GROUP BY vec_id, i, b),
db AS (SELECT vec_id, i, b, greatest(db, max(db) OVER (PARTITION BY vec_id) - 80) AS db FROM power)"""
SQL: dict[str, str] = {
    "songs_scan": _sql("SELECT * FROM songs ORDER BY id"),
    "work_queue": _sql("SELECT id, title, status FROM songs WHERE status IN ('queued', 'error')"),
    "features_for_song": _sql("SELECT song_id, stem_type, bpm, camelot, len(mfcc) AS n_mfcc, round(mfcc[1], 6) AS first_mfcc FROM features WHERE song_id = 42 AND stem_type = 'full'"),
    "features_with_titles": _sql("SELECT * EXCLUDE (mfcc) FROM named WHERE stem_type = 'vocals'"),
    "semitone_shift_matrix": _sql(f"SELECT event_id, vocal_key, inst_key, {_SHIFT} AS semitone_shift FROM (SELECT event_id, k[event_id % 20 + 1] AS vocal_key, k[event_id // 20 % 20 + 1] AS inst_key FROM events, (SELECT [{_SPELLINGS.translate(_OPEN)}] AS k))"),
    "camelot_lookup": _sql("SELECT event_id, key, mode, coalesce(w.camelot, '?') AS camelot FROM (SELECT event_id, (['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'])[event_id % 12 + 1] AS key, (['major', 'minor', 'dorian'])[event_id // 12 % 3 + 1] AS mode FROM events) LEFT JOIN wheel w USING (key, mode)"),
    "camelot_score_matrix": _sql(f"SELECT event_id, c1, c2, KEYSCORE(c1, c2) AS score FROM (SELECT event_id, k[event_id % 30 + 1] AS c1, k[event_id // 30 % 30 + 1] AS c2 FROM events, (SELECT [{_CODES.translate(_OPEN)}] AS k))"),
    "bpm_score_pairs": _sql("SELECT song_id, round(BPMDIFF(b1, b2), 6) AS min_diff, round(BPMSCORE(BPMDIFF(b1, b2)), 6) AS score FROM n", more=_NEXT),
    "energy_score_pairs": _sql("SELECT song_id, round(ENERGY(e1, e2), 6) AS score FROM n", more=_NEXT),
    "mfcc_cosine_pairs": _sql("SELECT song_id, round(COSINE(m1, m2), 6) AS score FROM n", more=_NEXT),
    "pair_filter_counts": _sql("SELECT combo_type, count(*) FILTER (WHERE d <= 10 AND score_key >= 0.55) AS scored, count(*) FILTER (WHERE NOT (d <= 10 AND score_key >= 0.55)) AS skipped FROM measured GROUP BY combo_type", True),
    "vocal_over_instrumental": _sql(f"{_SHORT} WHERE combo_type = 'vocal_over_instrumental'", True),
    "vocal_over_instrumental_banded": _sql(f"{_SHORT} WHERE combo_type = 'vocal_over_instrumental'", True),
    "vocal_over_instrumental_literal": _sql(f"{_SHORT} WHERE combo_type = 'vocal_over_instrumental'", True),
    "instrumental_over_instrumental": _sql(f"{_SHORT} WHERE combo_type = 'instrumental_over_instrumental'", True),
    "all_pairs_by_combo": _sql("SELECT combo_type, count(*) AS n_pairs, round(avg(score_total), 6) AS mean_total FROM candidates GROUP BY combo_type", True),
    "candidates_min_score": _sql(f"{_SHORT} WHERE score_total >= 0.8 {_BEST.replace('score_total', 'candidates.score_total')} LIMIT 100", True),
    "candidates_for_song_vocal": _sql(f"{_SHORT} WHERE vocal_song_id = 5 AND combo_type = 'vocal_over_instrumental'", True),
    "candidates_for_song_inst": _sql(f"{_SHORT} WHERE inst_song_id = 5", True),
    "find_matches_pruned": _sql(f"{_SHORT} WHERE vocal_song_id = 5 AND combo_type = 'vocal_over_instrumental' {_BEST.replace('score_total', 'candidates.score_total')} LIMIT 10", True),
    "score_changed_pairs": _sql(f"{_SHORT} WHERE vocal_song_id % 100 = 5 OR inst_song_id % 100 = 5", True)
        .replace("FROM named a, named b", "FROM moved a, moved b").replace("sides AS (", "moved AS (SELECT * REPLACE (CASE WHEN song_id % 100 = 5 THEN bpm + 1 ELSE bpm END AS bpm) FROM named), sides AS (", 1),
    "find_matches_topk": _sql(f"{_SHORT} WHERE vocal_song_id = 5 AND combo_type = 'vocal_over_instrumental' {_BEST.replace('score_total', 'candidates.score_total')} LIMIT 10", True),
    "seed_title": _sql("SELECT CAST(seed AS BIGINT) AS seed, CASE WHEN id IS NULL THEN 'Song #' || seed ELSE title || ' — ' || artist END AS title FROM (VALUES (5), (-1)) s(seed) LEFT JOIN songs ON id = seed"),
    "db_report_top20": _sql(f"SELECT combo_type, CAST(r AS INTEGER) AS rank, vocal_song_id, inst_song_id, score_total FROM (SELECT *, row_number() OVER (PARTITION BY combo_type {_BEST}) AS r FROM candidates) WHERE r <= 20", True),
    "db_report_features": _sql("SELECT s.id, s.title, s.artist, s.status, stem_type, bpm, key, mode, camelot, loudness_rms, energy FROM songs s LEFT JOIN features f ON f.song_id = s.id"),
    "export_rows": _sql(
        f"SELECT CAST(r AS INTEGER) AS rank, combo_type, vocal_title, vocal_artist, inst_title, inst_artist, vocal_bpm, inst_bpm, round(inst_bpm / vocal_bpm, 4) AS bpm_stretch_ratio, vocal_key, vocal_mode, inst_key, inst_mode, vocal_camelot, inst_camelot, {_SHIFT} AS semitone_shift, {_SCORES}, "
        "CASE WHEN v.file_path IS NULL THEN 'FILE_MISSING' WHEN v.song_id % 5 <> 0 THEN v.file_path ELSE 'FILE_MISSING:' || v.file_path END AS vocal_wav_path, CASE WHEN i.file_path IS NULL THEN 'FILE_MISSING' WHEN i.song_id % 5 <> 0 THEN i.file_path ELSE 'FILE_MISSING:' || i.file_path END AS inst_wav_path "
        f"FROM (SELECT *, row_number() OVER ({_BEST}) AS r FROM candidates) LEFT JOIN stems v ON v.song_id = vocal_song_id AND v.stem_type = 'vocals' LEFT JOIN stems i ON i.song_id = inst_song_id AND i.stem_type = 'instrumental' WHERE r <= 20", True),
    "session_plan": _sql(
        r"SELECT CAST(r AS INTEGER) AS rank, lpad(CAST(r AS VARCHAR), 2, '0') || '_' || FOLD1 || '_over_' || FOLD2 AS folder, vocal_song_id, inst_song_id, round(inst_bpm / vocal_bpm, 4) AS bpm_stretch_ratio, ".replace("FOLD1", r"trim(regexp_replace(regexp_replace(vocal_title, '[^\p{L}\p{N}_]', '_', 'g'), '_+', '_', 'g'), '_')[1:40]").replace("FOLD2", r"trim(regexp_replace(regexp_replace(inst_title, '[^\p{L}\p{N}_]', '_', 'g'), '_+', '_', 'g'), '_')[1:40]")
        + f"{_SHIFT} AS semitone_shift, v.file_path AS vocal_wav_path, i.file_path AS inst_wav_path FROM (SELECT *, row_number() OVER ({_BEST}) AS r FROM candidates WHERE combo_type = 'vocal_over_instrumental') LEFT JOIN stems v ON v.song_id = vocal_song_id AND v.stem_type = 'vocals' LEFT JOIN stems i ON i.song_id = inst_song_id AND i.stem_type = 'instrumental' WHERE r <= 10", True),
    "upsert_song": _sql(
        "SELECT s.id, coalesce(f.title, s.title) AS title, coalesce(f.artist, s.artist) AS artist, coalesce(f.genre, s.genre) AS genre, s.source_url, coalesce(f.duration_secs, s.duration_secs) AS duration_secs, coalesce(f.status, s.status) AS status, CASE WHEN f.raw_path <> '' THEN f.raw_path ELSE s.raw_path END AS raw_path, coalesce(f.duration_str, s.duration_str) AS duration_str FROM songs s LEFT JOIN folded f USING (source_url) "
        "UNION ALL SELECT (SELECT max(id) FROM songs) + row_number() OVER (ORDER BY first_seq), title, artist, genre, source_url, duration_secs, status, raw_path, duration_str FROM folded WHERE source_url NOT IN (SELECT source_url FROM songs)", more=_SONG_BATCH),
    "upsert_stem": _sql(
        "SELECT s.id, s.song_id, s.stem_type, coalesce(b.file_path, s.file_path) AS file_path FROM stems s LEFT JOIN b USING (song_id, stem_type) UNION ALL SELECT (SELECT max(id) FROM stems) + row_number() OVER (ORDER BY seq), song_id, stem_type, file_path FROM b WHERE (song_id, stem_type) NOT IN (SELECT (song_id, stem_type) FROM stems)",
        more=", b AS (SELECT vec_id * 5 + 1 AS song_id, 'vocals' AS stem_type, '/v2/' || vec_id AS file_path, vec_id AS seq FROM embeddings)"),
    "upsert_features": _sql(
        "SELECT f.id, f.song_id, f.stem_type, CASE WHEN b.song_id IS NULL THEN f.bpm ELSE b.bpm END AS bpm, CASE WHEN b.song_id IS NULL THEN f.camelot ELSE b.camelot END AS camelot, CASE WHEN b.song_id IS NULL THEN f.loudness_rms ELSE b.loudness_rms END AS loudness_rms, CASE WHEN b.song_id IS NULL THEN f.energy ELSE b.energy END AS energy, CASE WHEN b.song_id IS NULL THEN f.key ELSE b.key END AS key, CASE WHEN b.song_id IS NULL THEN f.mode ELSE b.mode END AS mode FROM features f LEFT JOIN b ON b.song_id = f.song_id AND b.stem_type = f.stem_type "
        "UNION ALL SELECT (SELECT max(id) FROM features) + row_number() OVER (ORDER BY seq), song_id, stem_type, bpm, camelot, loudness_rms, energy, key, mode FROM b WHERE (song_id, stem_type) NOT IN (SELECT (song_id, stem_type) FROM features)",
        more=", b AS (SELECT song_id * 2 AS song_id, stem_type, bpm + 1 AS bpm, camelot, loudness_rms, energy, key, mode, id AS seq FROM features WHERE song_id % 3 = 0)"),
    "upsert_candidate": _sql(
        f"SELECT CASE WHEN vocal_song_id % 2 = 0 THEN vocal_song_id * 10000000 + inst_song_id * 2 + CASE WHEN combo_type = 'vocal_over_instrumental' THEN 1 ELSE 0 END ELSE (SELECT max(vocal_song_id * 10000000 + inst_song_id * 2 + CASE WHEN combo_type = 'vocal_over_instrumental' THEN 1 ELSE 0 END) FROM candidates WHERE vocal_song_id % 2 = 0) + n END AS id, combo_type, vocal_song_id, inst_song_id, CASE WHEN vocal_song_id % 2 = 0 THEN 'old' ELSE vocal_title END AS vocal_title, {_SCORES} FROM "
        "(SELECT * REPLACE (CASE WHEN vocal_song_id % 4 <> 2 THEN score_total ELSE CAST(0 AS DOUBLE) END AS score_total), row_number() OVER (PARTITION BY vocal_song_id % 2 ORDER BY combo_type, vocal_song_id, inst_song_id) AS n FROM candidates)", True),
    "update_status": _sql("SELECT id, CASE WHEN id % 4 = 0 THEN 'stemmed' ELSE status END AS status, CASE WHEN id % 4 = 0 AND id % 8 <> 0 THEN '/new/' || id ELSE raw_path END AS raw_path FROM songs"),
    "update_duration": _sql("SELECT id, CASE WHEN id % 4 = 0 THEN duration_secs * 20 ELSE duration_secs END AS duration_secs, CASE WHEN id % 4 = 0 THEN DUR(duration_secs * 20) ELSE duration_str END AS duration_str FROM songs"),
    "migrate_columns": _sql("SELECT * EXCLUDE (duration_str), CAST(NULL AS VARCHAR) AS artist_id, CAST(NULL AS VARCHAR) AS track_id, CAST(NULL AS VARCHAR) AS duration_str, CAST(NULL AS VARCHAR) AS upload_date, CAST(0 AS BIGINT) AS likes, CAST(0 AS BIGINT) AS reposts, CAST(0 AS BIGINT) AS comments, CAST(0 AS BIGINT) AS plays, CAST(NULL AS VARCHAR) AS thumbnail FROM songs"),
    "stem_map": _sql("SELECT song_id, string_agg(stem_type || '=' || file_path, ';' ORDER BY stem_type) AS stems FROM stems GROUP BY song_id"),
    "existing_files": _sql("SELECT id, raw_path FROM songs WHERE raw_path <> '' AND id % 3 <> 0 AND id IN (SELECT song_id FROM stems)"),
    "normalise_tracks": _sql(
        "SELECT page_id AS line, 'T' || page_id AS title, CASE WHEN page_id % 3 = 0 THEN 'ch' ELSE 'up' END AS artist, '' AS genre, url AS source_url, page_id * CAST(1.5 AS DOUBLE) AS duration_secs, DUR(page_id * CAST(1.5 AS DOUBLE)) AS duration_str, '' AS artist_id, '' AS track_id, '' AS upload_date, '' AS thumbnail, page_id AS likes, CAST(CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS reposts, CAST(0 AS BIGINT) AS comments, CASE WHEN page_id % 2 = 0 THEN CAST(0 AS BIGINT) ELSE page_id END AS plays FROM pages WHERE page_id % 7 <> 0"),
    "duration_strings": _sql("SELECT event_id, DUR(value * 50 - 10) AS text FROM events"),
    "safe_names": r"WITH d AS (SELECT doc_id, text || ' - (é)' AS t, 'Ça va? ' || source AS a FROM documents) SELECT doc_id, regexp_replace(trim(regexp_replace(t, '[^\p{L}\p{N}_\s-]', '', 'g')), '[\s-]+', '_', 'g')[1:40] AS file_part, regexp_replace(t, '[^\p{L}\p{N}_]', '_', 'g')[1:40] || '_' || regexp_replace(a, '[^\p{L}\p{N}_]', '_', 'g')[1:30] || '_vocals.wav' AS stem_name, trim(regexp_replace(regexp_replace(t, '[^\p{L}\p{N}_]', '_', 'g'), '_+', '_', 'g'), '_')[1:40] AS folder FROM d",
    "clean_titles": r"SELECT p_partkey, trim(regexp_replace(p_name || ' (Official) [HD] ' || p_partkey, '\s*[\(\[].*?[\)\]]', '', 'g')) AS title FROM part",
    "youtube_like_urls": "SELECT page_id, (u LIKE 'ytsearch%' OR u LIKE '%youtube.com/%' OR u LIKE '%youtu.be/%') AS is_youtube FROM (SELECT page_id, lower(trim(CASE page_id % 4 WHEN 0 THEN ' HTTPS://YouTu.be/' || page_id WHEN 1 THEN 'ytsearch5:' || url ELSE url END)) AS u FROM pages)",
    "search_plan": _sql(r"SELECT id, CAST(o AS INTEGER) AS query_ord, 'ytsearch5:' || artist || ' ' || trim(regexp_replace(title, '\s*[\(\[].*?[\)\]]', '', 'g')) || q AS query, CAST(r AS INTEGER) AS result_rank FROM songs, (VALUES (0, ' official audio'), (1, ' lyrics'), (2, '')) s(o, q), range(1, 6) t(r)"),
    "attempt_ladder_first_success": _sql(f"SELECT id, CAST(ord AS INTEGER) AS ord, label, format, CASE WHEN id % 2 = 0 THEN args ELSE '' END AS extractor_args, use_cookies FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS n FROM songs, ({_ATTEMPTS}) a(ord, label, format, args, use_cookies) WHERE (id % 2 = 0 OR ord = 0) AND (id + ord) % 3 = 2) WHERE n = 1"),
    "fallback_search_first_long": _sql("SELECT id, CAST(o AS INTEGER) AS query_ord, CAST(r AS INTEGER) AS result_rank, CAST(d AS DOUBLE) AS duration_secs FROM (SELECT id, o, r, (id * 7 + o * 5 + r * 3) % 40 AS d, row_number() OVER (PARTITION BY id ORDER BY o, r) AS n FROM songs, range(0, 3) q(o), range(1, 6) t(r) WHERE (id * 7 + o * 5 + r * 3) % 40 > 35) WHERE n = 1"),
    "preview_decision": f"WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 AND value IS NOT NULL THEN value WHEN event_id * 1000 / 1024 < 560 THEN 30 END AS secs, (['existing', 'fresh', 'fallback'])[event_id % 3 + 1] AS a, (['fresh', 'fallback', 'existing'])[event_id % 3 + 1] AS b FROM events) SELECT event_id, {_STATE.format('a')} AS state, {_STATE.format('b')} AS other_state FROM e",
    "key_detection": _sql(
        "SELECT vec_id, key, mode, camelot FROM (SELECT vec_id, key, mode, w.camelot, row_number() OVER (PARTITION BY vec_id ORDER BY round(r, 12) DESC, mode, idx) AS n FROM fits JOIN names USING (idx) JOIN wheel w USING (key, mode)) WHERE n = 1",
        more=", names(idx, key) AS (VALUES (0,'C'),(1,'C#'),(2,'D'),(3,'D#'),(4,'E'),(5,'F'),(6,'F#'),(7,'G'),(8,'G#'),(9,'A'),(10,'A#'),(11,'B')), profiles(mode, p) AS (VALUES ('major', [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]::DOUBLE[]), ('minor', [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]::DOUBLE[])), "
        "fits AS (SELECT vec_id, mode, idx, corr(abs(CAST(embedding[t + 1] AS DOUBLE)), p[(t - idx + 12) % 12 + 1]) AS r FROM embeddings, profiles, names, range(0, 12) x(t) GROUP BY vec_id, mode, idx)"),
    "rms_zcr": "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings) SELECT vec_id, round(sqrt(list_dot_product(x, x) / len(x)), 6) AS rms, round(len(list_filter(range(1, len(x)), lambda i: (x[i] >= 0) <> (x[i + 1] >= 0))) / len(x), 6) AS zcr FROM e",
    "frame_rms_zcr": (
        "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), f AS (SELECT vec_id, x, unnest(range(0, len(x) // 4 + 1)) AS i FROM e), g AS (SELECT vec_id, x[greatest(1, 4 * i - 7) : least(len(x), 4 * i + 8)] AS y FROM f) "
        "SELECT vec_id, round(avg(sqrt(coalesce(list_sum(list_transform(y, lambda v: v * v)), 0) / 16)), 6) AS rms, round(avg(len(list_filter(range(1, len(y)), lambda i: (y[i] >= 0) <> (y[i + 1] >= 0))) / CAST(16 AS DOUBLE)), 6) AS zcr FROM g GROUP BY vec_id"),
    "frame_energy": _MAGNITUDES.replace("HOP", "4") + " SELECT vec_id, round(energy, 6) AS energy FROM embeddings LEFT JOIN (SELECT vec_id, avg(mag * mag) AS energy FROM m GROUP BY vec_id) USING (vec_id)",
    "spectral_shape": _MAGNITUDES.replace("HOP", "4") + (
        ", r AS (SELECT *, sum(mag) OVER (PARTITION BY vec_id, i ORDER BY k) AS running, sum(mag) OVER (PARTITION BY vec_id, i) AS total FROM m), "
        "f AS (SELECT vec_id, i, avg(mag * mag) AS energy, coalesce(sum(mag * k * 500) / nullif(sum(mag), 0), 0) AS centroid, min(k * 500) FILTER (WHERE running >= 0.85 * total) AS rolloff FROM r GROUP BY vec_id, i) "
        "SELECT vec_id, round(avg(energy), 6) AS energy, round(avg(centroid), 6) AS centroid, round(avg(rolloff), 6) AS rolloff FROM f GROUP BY vec_id"),
    "mfcc_means": _DECIBELS.replace("HOP", "4") + (
        ", means AS (SELECT vec_id, b, avg(db) AS v FROM db GROUP BY vec_id, b) "
        "SELECT vec_id, CAST(k AS INTEGER) AS k, round(sum(v * cos(pi() * k * (b + 0.5) / 6)) * sqrt((CASE k WHEN 0 THEN 1 ELSE 2 END) / 6), 4) + 0 AS value FROM means, range(0, 5) q(k) GROUP BY vec_id, k"),
    "chroma_means": (
        "WITH x AS (SELECT vec_id, list_concat(list_transform(range(0, 16), lambda z: CAST(0 AS DOUBLE)), CAST(embedding AS DOUBLE[]), list_transform(range(0, 32), lambda z: CAST(0 AS DOUBLE))) AS p, len(embedding) AS n FROM embeddings WHERE len(embedding) > 0), "
        "fr AS (SELECT vec_id, i, p[8 * i + 1 : 8 * i + 32] AS y FROM (SELECT *, unnest(range(0, n // 8 + 1)) AS i FROM x)), s AS (SELECT vec_id, i, j, y[j + 1] * (0.5 - 0.5 * cos(2 * pi() * j / 32)) / 32 AS v FROM fr, range(0, 32) r(j)), "
        "q AS (SELECT vec_id, i, t, sqrt(pow(sum(v * cos(2 * pi() * 4 * pow(2, t / CAST(12 AS DOUBLE)) * (j - 16) / 64)), 2) + pow(sum(v * sin(2 * pi() * 4 * pow(2, t / CAST(12 AS DOUBLE)) * (j - 16) / 64)), 2)) AS mag FROM s, range(0, 24) p(t) GROUP BY vec_id, i, t), "
        "c AS (SELECT vec_id, i, t % 12 AS class, sum(mag) AS v FROM q GROUP BY vec_id, i, t % 12), u AS (SELECT vec_id, class, coalesce(v / nullif(max(v) OVER (PARTITION BY vec_id, i), 0), 0) AS v FROM c) "
        "SELECT vec_id, CAST(class AS INTEGER) AS class, round(avg(v), 6) AS value FROM u GROUP BY vec_id, class"),
    "beat_periods": _DECIBELS.replace("HOP", "1") + (
        ", o AS (SELECT vec_id, i, coalesce(avg(rise), 0) AS v FROM (SELECT vec_id, i, greatest(db - lag(db) OVER (PARTITION BY vec_id, b ORDER BY i), 0) AS rise FROM db) GROUP BY vec_id, i), l AS (SELECT vec_id, i, v - avg(v) OVER (PARTITION BY vec_id) AS v FROM o), "
        "ac AS (SELECT a.vec_id, b.i - a.i AS lag, greatest(0, sum(a.v * b.v)) AS r FROM l a JOIN l b ON a.vec_id = b.vec_id AND b.i >= a.i GROUP BY a.vec_id, b.i - a.i), own AS (SELECT vec_id, list(r / r0 ORDER BY lag) AS r FROM ac JOIN (SELECT vec_id, r AS r0 FROM ac WHERE lag = 0 AND r > 0) USING (vec_id) GROUP BY vec_id), "
        "sc AS (SELECT vec_id, lag, greatest(0, r[lag + 1] - list_max(list_transform([2, 3, 4, 5], lambda m: r[lag // m + 1] + (lag % m) / CAST(m AS DOUBLE) * (r[lag // m + 2] - r[lag // m + 1])))) * exp(-0.5 * pow(log2(480 / CAST(lag AS DOUBLE) / 120), 2)) AS score FROM own, range(2, 17) p(lag) WHERE lag < len(r)) "
        "SELECT vec_id, coalesce(lag, 0) AS lag FROM (SELECT DISTINCT vec_id FROM x) LEFT JOIN (SELECT vec_id, arg_max(lag, score) AS lag FROM sc WHERE score > 0 GROUP BY vec_id) USING (vec_id)"),
    "download_outcomes": _sql(
        "SELECT id, CASE WHEN old THEN '/old/' || id WHEN fresh AND id % 3 <> 0 THEN '/new/' || id || '/0' WHEN fresh AND id % 5 <> 0 THEN '/alt/' || id || '/' || ((k - 1) // 5) || '/' || ((k - 1) % 5 + 1) ELSE '' END AS raw_path, "
        "CASE WHEN old OR (fresh AND (id % 3 <> 0 OR id % 5 <> 0)) THEN 'downloaded' ELSE 'error' END AS status, CASE WHEN NOT old AND fresh AND id % 3 = 0 AND id % 5 <> 0 THEN CAST(36 AS DOUBLE) ELSE duration_secs END AS duration_secs "
        "FROM (SELECT *, id % 7 = 0 AND id % 2 = 1 AS old, id % 2 = 0 AS fresh, 11 - id % 11 AS k FROM songs WHERE status IN ('queued', 'error'))"),
    "bpm_confidence": "SELECT user_id, round(least(b / (s / CAST(512 AS DOUBLE)), 1), 6) AS confidence FROM (SELECT user_id, CAST(count(*) AS DOUBLE) AS b, nullif(sum(floor(value * 10)), 0) AS s FROM events GROUP BY user_id)",
    "mfcc_json_roundtrip": _sql("SELECT id, CAST(coalesce(len(mfcc), -1) AS INTEGER) AS n, true AS same FROM features"),
    "status_counts": _sql("SELECT status, count(*) AS n, CAST(list_position(['queued', 'downloaded', 'stemmed', 'analysed', 'error'], status) AS BIGINT) AS step FROM songs GROUP BY status"),
}
