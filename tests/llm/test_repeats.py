import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from cadenza.llm import repeats, substring_dedup, suffix_dedup
from tests.llm.helpers import SF, corpus, docs


def brute(sequences, window):
    seen = Counter(tuple(s[i : i + window]) for s in sequences for i in range(len(s) - window + 1))
    out = []
    for s in sequences:
        gone = [False] * len(s)
        for i in range(len(s) - window + 1):
            if seen[tuple(s[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append(gone)
    return out


def brute_bytes(texts, window):
    data = [(t or "").encode() for t in texts]
    out = []
    for d, gone in zip(data, brute([list(x) for x in data], window)):
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(texts, window):
    data = [(t or "").encode().split() for t in texts]
    return [(len(d), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(d, gone) if not g)).hexdigest()) for d, gone in zip(data, brute(data, window))]


def found_bytes(df):
    return sorted((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in df.collect())


def found_words(df):
    return sorted((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), hashlib.sha256(r["kept"].encode()).hexdigest()) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_match_brute_force(spark, seed):
    texts = corpus(seed)
    expected = sorted((i, *x) for i, x in enumerate(brute_bytes(texts, 50)))
    assert found_bytes(suffix_dedup.remove_repeats(docs(spark, texts), 50, 16)) == expected


@pytest.mark.parametrize("seed", [3, 4])
def test_words_match_brute_force(spark, seed):
    texts = corpus(seed)
    expected = sorted((i, *x) for i, x in enumerate(brute_words(texts, 12)))
    assert found_words(substring_dedup.remove_repeats(docs(spark, texts), 12, 3)) == expected


@pytest.mark.parametrize("unit, resolver, window, anchor", [(repeats.Bytes, suffix_dedup.radix_passes, 50, 16), (repeats.Words, substring_dedup.deep_nodes, 12, 3)])
def test_hot_anchors_give_the_same(spark, unit, resolver, window, anchor):
    rows = repeats.keyed(docs(spark, corpus(5)))
    n = {r["key"]: len(unit.split(r["text"])) for r in rows.collect()}

    def masks(limit):
        found = repeats.repeated_starts(rows, unit, window, anchor, resolver, limit)
        return {r["key"]: repeats.covered(n[r["key"]], r["starts"], window).tolist() for r in found.collect()}

    assert masks(1) == masks(1500) != {}


def test_internal_nodes_match_brute_force():
    rng = random.Random(3)
    leaves = np.array(sorted([rng.randrange(2) for _ in range(6)] for _ in range(40)), dtype=np.uint64)
    kind = np.array([0] * 25 + [1] * 15)
    expected = set()
    for k in (0, 1):
        own = [(i, tuple(x)) for i, x in enumerate(leaves.tolist()) if kind[i] == k]
        for depth in range(1, 7):
            for prefix in {x[:depth] for _, x in own}:
                below = [i for i, x in own if x[:depth] == prefix]
                # a node: its leaves part right after the prefix, or end there
                if len(below) > 1 and (depth == 6 or len({tuple(leaves[i][: depth + 1]) for i in below}) > 1):
                    expected.add((depth, below[0], below[-1]))
    assert set(substring_dedup.internal_nodes(kind, leaves)) == expected
    alone = substring_dedup.deep_nodes(np.zeros(1, dtype=int), leaves[:1])
    assert alone.tolist() == [False] and substring_dedup.deep_nodes(kind[:0], leaves[:0]).tolist() == []


@pytest.mark.parametrize("rows", [1, 40])
def test_a_passage_in_half_of_all_documents(spark, rows):
    """Also with repeated rows of one id and text, null ids and ties."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = " ".join(word() for _ in range(60))
    texts = [f"{' '.join(word() for _ in range(20))} {passage if i % 2 else word()} {' '.join(word() for _ in range(20))}" for i in range(120)]
    texts += [texts[1]] * rows + [None, passage]
    ids = [*range(120), *[1] * rows, None, None]
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    expected = sorted(((i, *x) for i, x in zip(ids, brute_words(texts, 35))), key=key)
    found = substring_dedup.remove_repeats(docs(spark, texts, ids), 35).collect()
    assert sorted(((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), hashlib.sha256(r["kept"].encode()).hexdigest()) for r in found), key=key) == expected
    expected = sorted(((i, *x) for i, x in zip(ids, brute_bytes(texts, 200))), key=key)
    found = suffix_dedup.remove_repeats(docs(spark, texts, ids), 200).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in found), key=key) == expected


def test_pieces_do_not_change_the_result(spark, monkeypatch):
    values = repeats.Bytes.values(repeats.Bytes.split(corpus(6)[-1]))
    whole = {(int(s), int(g)) for lo, hi, p, seed, _ in repeats.runs(values, 50, 16) for a, b, g in zip(lo, hi, seed) for s in range(a, b + 1)}
    monkeypatch.setattr(repeats, "_PIECE", 97)
    assert whole == {(int(s), int(g)) for lo, hi, p, seed, _ in repeats.runs(values, 50, 16) for a, b, g in zip(lo, hi, seed) for s in range(a, b + 1)}


def test_edge_cases(spark):
    copy = "x y z " * 30
    texts = [copy, copy, copy, None, "", "é" * 300]
    df = docs(spark, texts, [7, 7, None, None, 3, 4])
    found = sorted((r["doc_id"] or -1, r["n_bytes"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(df, 50, 16).collect())
    assert found == [(-1, 0, b""), (-1, 180, b""), (3, 0, b""), (4, 600, b""), (7, 180, b""), (7, 180, b"")]
    assert suffix_dedup.remove_repeats(df.filter("false"), 50, 16).count() == 0
    assert substring_dedup.remove_repeats(df.filter("false"), 12, 3).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(df, 50, 50)


def test_queries_match_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    ids, texts = [r["doc_id"] for r in rows], [r["text"] for r in rows]
    expected = sorted((i, *x) for i, x in zip(ids, brute_bytes(texts, 200)))
    assert sorted(map(tuple, suffix_dedup.op6_suffix_array_dedup(spark, SF).collect())) == expected
    expected = sorted((i, *x) for i, x in zip(ids, brute_words(texts, 35)))
    assert sorted(map(tuple, substring_dedup.op9_substring_dedup(spark, SF).collect())) == expected


def test_whole_texts_go_to_python_in_small_batches(spark, tmp_path, monkeypatch):
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    passage = "".join(random.Random(9).choice("abcdef ") for _ in range(300))
    docs(spark, [f"text {i}" for i in range(9000)] + [passage, passage]).repartition(1).write.parquet(f"{tmp_path}/documents.parquet")

    def bounded(batches, part=repeats.slices):
        for b in batches:
            if b.num_rows > 1000:
                raise ValueError(f"{b.num_rows} whole texts at once")
            yield from part(iter([b]))

    monkeypatch.setattr(suffix_dedup, "slices", bounded)
    spark.conf.set(size, "10000")
    try:
        found = suffix_dedup.op6_suffix_array_dedup(spark, str(tmp_path)).filter("n_removed > 0").collect()
    finally:
        spark.conf.set(size, before)
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in found) == [(9000, 300, 300, 1), (9001, 300, 300, 1)]


def collision(n=40_000, seed=1):
    """Two different texts of 200 bytes with one anchor and one sum modulo 2^64, as found by search: a Thue-Morse sequence of two blocks and its opposite behind a common beginning."""
    a, b = "kitidxht", "rwufehfy"
    order = [bin(i).count("1") % 2 for i in range(16)]
    first, second = ("".join((a, b)[x ^ flip] for x in order) for flip in (0, 1))
    rng = random.Random(seed)
    for _ in range(n):
        yield (start := "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(72))) + first, start + second


def test_equal_sums_are_not_equal_texts(spark):
    pairs = list(collision(60))
    sums = [[repeats._Rolling(repeats.Bytes.values(repeats.Bytes.split(t))).sums[-1] for t in pair] for pair in pairs]
    assert all(x == y for x, y in sums) and all(x != y and len(x) == 200 for x, y in pairs)
    texts = [t for pair in pairs for t in pair]
    for limit in (1500, 0):
        found = repeats.repeated_starts(repeats.keyed(docs(spark, texts)), repeats.Bytes, 200, suffix_dedup.ANCHOR, suffix_dedup.radix_passes, limit)
        assert found.count() == 0
    assert {(r["n_bytes"], r["n_spans"]) for r in suffix_dedup.remove_repeats(docs(spark, [*texts, texts[0]]), 200).selectExpr("n_bytes", "size(spans) as n_spans").collect()} == {(200, 0), (200, 1)}


def test_equality_decides_by_all_units():
    points = repeats.Equality.draw()
    units = np.frombuffer(b"abcabcab" * 40, dtype=np.uint8)
    lo = np.array([0, 3, 1, 0, 0])
    one, two = repeats.Equality(units, points).ranges(lo, np.array([100, 103, 101, 99, 100]))
    assert [(x, y) == (one[0], two[0]) for x, y in zip(one, two)] == [False if i in (1, 2, 3) and bytes(units[lo[i] : lo[i] + 100 - (i == 3)]) != bytes(units[:100]) else True for i in range(5)]
    again = repeats.Equality(units[3:], points).ranges(np.array([0]), np.array([100]))
    assert (again[0][0], again[1][0]) == (one[1], two[1])
