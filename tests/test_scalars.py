import math
import random

import pytest
from pyspark.sql import functions as F

from cadenza.functions import scalars as S


def values(spark, schema, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).coalesce(1).select(*columns).collect()]


def test_bpm_is_directional_and_its_bounds_are_exact(spark):
    rows = [(60.0, 138.0), (138.0, 60.0), (100.0, 100.5), (100.0, 103.0), (100.0, 106.0), (100.0, 110.0), (100.0, 115.0), (100.0, 125.0), (0.0, 100.0), (-1.0, 5.0), (None, 100.0)]
    found = values(spark, "a double, b double", rows, S.bpm_min_diff(F.col("a"), F.col("b")), S.bpm_score(F.col("a"), F.col("b")))
    assert [x[0] for x in found] == [9, 18, 0.5, 3, 6, 10, 15, 25, 999, 999, 999]
    assert [x[1] for x in found] == [0.65, 0.2, 0.95, 0.85, 0.65, 0.4, 0.2, 0.2, 0, 0, 0]


def test_camelot_scores(spark):
    rows = [("8B", "8B"), ("8B", "9B"), ("12B", "1B"), ("8B", "8A"), ("8B", "10B"), ("12B", "2B"), ("8B", "3A"), ("8b", "8B"), ("8B", None), ("?", "8B"), ("", ""), ("B", "8B"), ("13B", "12B")]
    found = values(spark, "a string, b string", rows, S.camelot_score(F.col("a"), F.col("b")))
    assert [x[0] for x in found] == [1, 0.85, 0.85, 0.75, 0.55, 0.55, 0.25, 0.75, 0.5, 0.5, 0.5, 0.5, 0.85]


def test_semitone_shift(spark):
    rows = [("C", "G"), ("G", "C"), ("F#", "C"), ("C", "F#"), ("Db", "C#"), ("H", "C"), ("C", ""), (None, "C")]
    assert [x[0] for x in values(spark, "a string, b string", rows, S.semitone_shift(F.col("a"), F.col("b")))] == [5, -5, 6, 6, 0, None, None, None]


def test_durations(spark):
    rows = [(None,), (0.0,), (-1.0,), (0.4,), (225.5,), (226.5,), (3599.5,), (3600.0,), (36061.0,)]
    assert [x[0] for x in values(spark, "s double", rows, S.duration_str(F.col("s")))] == ["", "", "", "0:00", "3:46", "3:46", "1:00:00", "1:00:00", "10:01:01"]


def test_cosine_and_energy(spark):
    rows = [([], [1.0]), (None, [1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([1.0, 2.0], [1.0, 2.0])]
    found = [x[0] for x in values(spark, "a array<double>, b array<double>", rows, S.mfcc_cosine(F.col("a"), F.col("b")))]
    assert found[:4] == [0.5, 0.5, 0, 0] and found[4] == pytest.approx(1)
    with pytest.raises(Exception, match="lengths"):
        values(spark, "a array<double>, b array<double>", [([1.0], [1.0, 2.0])], S.mfcc_cosine(F.col("a"), F.col("b")))
    rows = [(1.0, 1.0), (0.0, 1.0), (None, 1.0), (1.0, 2.0)]
    found = [x[0] for x in values(spark, "a double, b double", rows, S.energy_score(F.col("a"), F.col("b")))]
    assert found[:3] == [1, 0.5, 0.5] and found[3] == pytest.approx(math.exp(-2))


def test_names(spark):
    rows = [("Café été 1",), ("x" * 45,), ("?!",), (None,), ("Song (Official) [HD]",), ("a  -  b",)]
    found = values(spark, "t string", rows, S.file_name_part(F.col("t")), S.folder_name_part(F.col("t")), S.clean_title(F.col("t")))
    assert found == [("Café_été_1", "Café_été_1", "Café été 1"), ("x" * 40, "x" * 40, "x" * 45), ("", "unknown", "?!"), ("", "unknown", ""), ("Song_Official_HD", "Song_Official_HD", "Song"), ("a_b", "a_b", "a  -  b")]
    assert values(spark, "r int, v string, i string", [(3, "A b", ""), (123, None, "é!")], S.session_folder(F.col("r"), F.col("v"), F.col("i"))) == [("03_A_b_over_inst",), ("123_vocal_over_é",)]


def test_previews(spark):
    rows = [("existing", 35.0), ("existing", 36.0), ("existing", None), ("fresh", 35.0), ("fresh", 36.0), ("fresh", None), ("fallback", 35.0), ("fallback", 36.0), ("fallback", None)]
    found = [x[0] for x in values(spark, "o string, s double", rows, S.download_state(F.col("o"), F.col("s")))]
    assert found == ["redo", "full", "redo", "preview", "full", "full", "preview", "full", "preview"]


def test_key_detection_agrees_with_numpy(spark):
    import numpy as np

    from cadenza.constants import KEY_NAMES, MAJOR_PROFILE, MINOR_PROFILE
    from cadenza.operators.audio import detect_key

    rng = random.Random(1)
    rows = [([rng.random() for _ in range(12)],) for _ in range(40)] + [([0.5] * 12,), (None,)]
    found = values(spark, "c array<double>", rows, detect_key(F.col("c")))
    for (chroma,), (k,) in zip(rows[:40], found):
        best = [max((np.corrcoef(np.roll(p, i), chroma)[0, 1], -i) for i in range(12)) for p in (MAJOR_PROFILE, MINOR_PROFILE)]
        mode = "major" if best[0][0] >= best[1][0] else "minor"
        assert (k["key"], k["mode"]) == (KEY_NAMES[-best[mode == "minor"][1]], mode)
    assert tuple(found[40][0]) == ("C", "minor", "5A") and found[41][0] is None
