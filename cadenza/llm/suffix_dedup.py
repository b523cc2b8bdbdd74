"""Substring removal by a depth-limited radix sort of suffixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm._shared import leaning, small_batches
from cadenza.llm.repeats import Bytes, covered, keyed, repeated_starts, slices, spans_of

ANCHOR = 64


def radix_passes(kind: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Which suffixes are equal to another of their kind through the whole window.

    units: one row of bytes per suffix, cut at the window's length. The rows
    are ordered by most-significant-digit passes of eight bytes. After a pass,
    suffixes alone in their group are done; those left after the last pass are
    exactly the repeated windows.
    """
    n, window = units.shape
    digits = np.zeros((n, -(-window // 8) * 8), dtype=np.uint8)
    digits[:, :window] = units
    digits = digits.view(">u8").astype(np.uint64)
    alive = np.arange(n)
    group = kind.astype(np.int64)
    for at in range(-1, digits.shape[1]):
        if at < 0:
            order = np.argsort(group, kind="stable")
            new = np.diff(group[order]) != 0
        else:
            digit = digits[alive, at]
            order = np.lexsort((digit, group))
            new = (np.diff(group[order]) != 0) | (np.diff(digit[order]) != 0)
        first = np.concatenate([[True], new]) if len(order) else np.zeros(0, dtype=bool)
        label = np.cumsum(first) - 1
        many = np.bincount(label, minlength=1)[label] > 1 if len(order) else first
        alive, group = alive[order][many], label[many]
        if not len(alive):
            break
    hit = np.zeros(n, dtype=bool)
    hit[alive] = True
    return hit


def remove_repeats(docs: DataFrame, window: int = 200, anchor: int = ANCHOR, keep: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, kept binary, spans, rest): every whole text without the bytes of repeated windows.

    A byte goes if it lies in a string of ``window`` bytes that also starts
    anywhere else in the corpus, the same document included; overlaps count.
    Strings are judged on the input, and none crosses documents. spans holds
    the maximal removed runs as (start, end) byte offsets; kept the other bytes
    (a removed run may end inside a character; ``as_text`` gives kept as a
    string without the rests of cut characters). Null text: empty. A null doc_id
    is an ordinary value. Repeated rows are documents of their own, so a
    repeated text of at least ``window`` bytes is removed in every row. An
    empty table gives an empty result. Only doc_id and text are read; rest is a
    struct of the columns ``keep`` (without any: true).

    Pass one of the sort takes an anchor of ``anchor`` bytes as its digit, pass
    two the run of windows that share it (see ``repeats``); what is still mixed
    is sorted byte by byte in ``radix_passes``.
    """
    if not 0 < anchor < window:
        raise ValueError("the anchor must be shorter than the window")
    rows = keyed(docs, keep)
    starts = repeated_starts(rows, Bytes, window, anchor, radix_passes)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    names = ["doc_id", "n_bytes", "kept", "spans", "rest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sizes, kept, spans = [], [], []
            for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                units = Bytes.split(text)
                mask = covered(len(units), found, window)
                sizes.append(len(units))
                left = units[~mask].tobytes()
                kept.append(left.decode("utf-8", "ignore") if as_text else left)
                spans.append([{"start": int(s), "end": int(e)} for s, e in zip(*spans_of(mask))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(spans, span), b.column(3)], names=names)

    joined = rows.join(starts, "key", "left").select("doc_id", "text", "starts", "rest")
    return joined.mapInArrow(leaning(run), f"doc_id long, n_bytes long, kept {'string' if as_text else 'binary'}, spans array<struct<start: long, end: long>>, rest {rows.schema['rest'].dataType.simpleString()}")


def op6_suffix_array_dedup(spark, sf_dir):
    """Every document without its repeated byte strings; edge cases as in ``remove_repeats``."""
    small_batches(spark)
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), 200)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, unnest(range(0, CAST(length(h) / 2 AS BIGINT) - 199)) AS i FROM d),
k AS (SELECT r, i, md5(substring(h, 2 * i + 1, 400)) AS m FROM w JOIN d USING (r)),
s AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY m) AS n FROM k) WHERE n > 1),
g AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM s),
n AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS span FROM g),
spans AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM n GROUP BY r, span),
ends AS (
  SELECT r, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a) AS removed, count(*) AS spans FROM spans GROUP BY r)
SELECT doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN removed IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(a) + 1), lambda j:
    substring(h, 2 * (CASE WHEN j = 0 THEN 0 ELSE b[j] END) + 1, 2 * ((CASE WHEN j = len(a) THEN CAST(length(h) / 2 AS BIGINT) ELSE a[j + 1] END) - (CASE WHEN j = 0 THEN 0 ELSE b[j] END)))), '') END)) AS kept_sha256
FROM d LEFT JOIN ends USING (r)
"""
