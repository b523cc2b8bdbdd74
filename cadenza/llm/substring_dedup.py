"""Word-sequence removal by prefix-partitioned suffix trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm._shared import leaning
from cadenza.llm.repeats import Words, covered, keyed, repeated_starts, slices, spans_of

PREFIX = 8


def internal_nodes(kind: np.ndarray, leaves: np.ndarray) -> list[tuple[int, int, int]]:
    """(depth, first leaf, last leaf) of the internal nodes of the suffix trees of sorted leaves, one tree a kind.

    Neighbouring leaves part at an internal node as deep as their common
    prefix. The open nodes of the way to the last leaf lie on a stack; a node
    is closed by the first leaf that leaves it.
    """
    equal = leaves[1:] == leaves[:-1]
    depths = np.where(kind[1:] == kind[:-1], np.where(equal.all(axis=1), leaves.shape[1], equal.argmin(axis=1)), 0)
    nodes, way = [], [(0, 0)]
    for i, depth in enumerate([*depths.tolist(), 0]):
        first = i
        while way[-1][0] > depth:
            deep, first = way.pop()
            nodes.append((deep, first, i))
        if way[-1][0] < depth:
            way.append((depth, first))
    return nodes


def deep_nodes(kind: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Which suffixes hang below an internal node at least as deep as the window.

    units: one row of word hashes per suffix, cut at the window's length, so a
    node as deep as the window joins all leaves with the same window.
    """
    n, window = units.shape
    order = np.lexsort([units[:, i] for i in range(window - 1, -1, -1)] + [kind])
    hit = np.zeros(n, dtype=bool)
    for depth, first, last in internal_nodes(kind[order], units[order]) if n > 1 else ():
        if depth >= window:
            hit[order[first : last + 1]] = True
    return hit


def remove_repeats(docs: DataFrame, window: int = 35, prefix: int = PREFIX) -> DataFrame:
    """(doc_id, n_words, kept string, spans): every whole text without the words of repeated windows.

    Words are runs of bytes other than space and 0x09-0x0D, unchanged. A word
    goes if it lies in a sequence of ``window`` words that also starts anywhere
    else in the corpus, the same document included. Sequences are judged on
    the input, and none crosses documents. spans holds the maximal removed
    runs as (start, end) word positions; kept the other words, joined by one
    space. Null text: no words. A null doc_id is an ordinary value. Repeated
    rows are documents of their own. An empty table gives an empty result.
    Only doc_id and text are read.

    Suffixes are split by prefix: first by the ``prefix`` words that anchor
    them (see ``repeats``), then, where one prefix has repeats that differ, by
    the whole run around it; a prefix with still too many suffixes for one
    task's memory is lengthened to the whole window, whose groups need only be
    counted. For every other prefix a task builds its subtree.
    """
    if not 0 < prefix < window:
        raise ValueError("the prefix must be shorter than the window")
    rows = keyed(docs)
    starts = repeated_starts(rows, Words, window, prefix, deep_nodes)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("kept", pa.string()), ("spans", span)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sizes, kept, spans = [], [], []
            for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = text.encode("utf-8", "surrogatepass").split()
                first, last = spans_of(covered(len(words), found, window)) if found else ((), ())
                rest, at = [], 0
                for s, e in zip(first, last):
                    rest += words[at:s]
                    at = e
                rest += words[at:]
                sizes.append(len(words))
                kept.append(b" ".join(rest).decode("utf-8", "surrogatepass"))
                spans.append([{"start": int(s), "end": int(e)} for s, e in zip(first, last)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, span)], schema=schema)

    joined = rows.join(starts, "key", "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(leaning(run), "doc_id long, n_words long, kept string, spans array<struct<start: long, end: long>>")


def op9_substring_dedup(spark, sf_dir):
    """Every document without its repeated word sequences; edge cases as in ``remove_repeats``."""
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), 35)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM documents),
w AS (SELECT r, unnest(range(0, len(t) - 34)) AS i FROM d),
k AS (SELECT r, i, md5(array_to_string(t[i + 1 : i + 35], ' ')) AS m FROM w JOIN d USING (r)),
s AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY m) AS n FROM k) WHERE n > 1),
c AS (SELECT DISTINCT r, i + unnest(range(0, 35)) AS p FROM s),
g AS (SELECT r, count(*) AS n, list(p) AS ps FROM c GROUP BY r)
SELECT doc_id, len(t) AS n_words, coalesce(n, 0) AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN t ELSE list_filter(t, lambda x, i: NOT list_contains(ps, i - 1)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (r)
"""
