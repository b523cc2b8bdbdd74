"""Edited copies: documents whose word shingles have a high Jaccard similarity, found by prefix filtering."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm._shared import dropped, leaning, written
from cadenza.llm.decontamination import window_hashes

#: Buckets of the sketch of shingle frequencies, bits of a document's bitmap, and leaders that a shingle's documents are compared with in one round.
SKETCH_BITS = 18
BITMAP_BITS = 11
LEADERS = 32
_ROWS = 500


def shingle_hashes(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; words are those of ``simhash.fingerprint``. Fewer words: one shingle of all; no word: none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.unique(window_hashes(np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words)), shingle))


def _shingled(docs: DataFrame, shingle: int) -> DataFrame:
    """(key, doc_id, shingles) for docs (key, doc_id, text)."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                part = b.slice(at, _ROWS)
                found = [shingle_hashes(t, shingle).view(np.int64) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, schema.types[2])], schema=schema)

    return docs.select("key", "doc_id", "text").mapInArrow(leaning(run), "key long, doc_id long, shingles array<long>")


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _bitmap(hashes: np.ndarray) -> np.ndarray:
    """2,048 bits as 32 signed integers: whether an odd number of the shingles falls on the bit.

    Two bitmaps differ in no more bits than there are shingles in one set only.
    """
    odd = np.bincount((hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64), minlength=1 << BITMAP_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _frequencies(docs: DataFrame, shingle: int) -> np.ndarray:
    """How many shingles of all documents fall into each bucket of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                np.add.at(found, _bucket(shingle_hashes(text, shingle)), 1)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["bucket", "n"])

    out = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    for r in docs.select("text").mapInArrow(leaning(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["bucket"]] = r["n"]
    return out


def _prefixes(docs: DataFrame, often: np.ndarray, shingle: int, share: float) -> DataFrame:
    """(shingle, key, n, pos, bits): every document's rarest shingles, so many that two documents of the similarity have one in common.

    n is the number of the document's shingles, pos the shingle's place by
    (frequency in the sketch, hash). This order is the same for all documents,
    which is all that the filter needs; a coarse sketch only costs time. bits,
    the bitmap of all the document's shingles, is null but for pos 0.
    """
    handle = docs.sparkSession.sparkContext.broadcast(often)
    bitmaps = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                part = b.slice(at, _ROWS)
                out: list[list] = [[], [], [], []]
                bits: list[np.ndarray | None] = []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    hashes = shingle_hashes(text, shingle)
                    n = len(hashes)
                    if n:
                        order = np.lexsort((hashes, handle.value[_bucket(hashes)]))[: n - math.ceil(share * n - 1e-9) + 1]
                        for column, x in zip(out, (hashes[order].view(np.int64), np.full(len(order), key), np.full(len(order), n, dtype=np.int32), np.arange(len(order), dtype=np.int32))):
                            column.append(x)
                        bits += [_bitmap(hashes), *[None] * (len(order) - 1)]
                if out[0]:
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c)) for c in out), pa.array(bits, bitmaps)], names=["shingle", "key", "n", "pos", "bits"])

    return docs.select("key", "text").mapInArrow(leaning(run), "shingle long, key long, n int, pos int, bits array<long>")


def edited_copies(docs: DataFrame, shingle: int = 5, share: float = 0.8) -> DataFrame:
    """(key): documents of docs (key, doc_id, text; distinct keys) that are edited copies of one with a smaller doc_id (null last, ties by key).

    Two documents are copies if the Jaccard similarity of their word shingles
    (compared by 64-bit hashes) is at least ``share``. No two of the other
    documents are, and each one listed has a copy with a smaller doc_id.
    Candidates share a shingle that is rare enough: prefix filtering, in which
    the smaller one of a pair holds it among its first (1 - share)/(1 + share)
    shingles. Only such documents (the shingle's index) are compared with the
    others, in rounds: every shingle names up to ``LEADERS`` of its index; found
    copies and the leaders leave the shingle, until no index is left. So a
    large group of copies costs rows in proportion to its size, and a common
    line none. Candidates whose bitmaps differ in more bits than two copies have
    shingles apart are no copies; the others are verified on their whole texts.
    Texts without a word aren't listed. docs is read in every round: give a written table.
    """
    least = share / (1 + share)
    prefixes = written(_prefixes(docs, _frequencies(docs, shingle), shingle, share), "prefixes")
    index = (F.col("n") - F.col("pos")) + 1e-6 >= 2 * least * F.col("n")
    live = written(prefixes.groupBy("shingle").agg(F.count("*").alias("c"), F.max(index).alias("index")).filter("c > 1 and index").select("shingle"), "live")
    rest = written(prefixes.join(live, "shingle").select("shingle", F.struct("key", "n", "pos").alias("doc"), index.alias("index")), "rest")
    bitmaps = written(prefixes.filter("pos = 0").select("key", "n", "bits"), "bitmaps")
    dropped(prefixes, live)
    ends = [bitmaps.select(F.col("key").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"b{k}")) for k in "uv"]
    apart = F.aggregate(F.zip_with("bu", "bv", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    gone = written(docs.select("key").filter("false"), "gone")
    turn = 0
    while rest.filter("index").head(1):
        salt = F.pmod(F.xxhash64("doc.key", F.lit(turn)), F.lit(LEADERS))
        leaders = written(rest.filter("index").groupBy("shingle", salt.alias("salt")).agg(F.min("doc").alias("doc")).groupBy("shingle").agg(F.collect_list("doc").alias("leaders")), "leaders")
        met = rest.join(leaders, "shingle").select("doc", F.explode("leaders").alias("other")).filter("doc.key <> other.key")
        n, m = F.col("doc.n"), F.col("other.n")
        # The first shingle that two copies have in common leaves room for the overlap they need.
        met = met.filter((F.least(n - F.col("doc.pos"), m - F.col("other.pos")) + 1e-6 >= least * (n + m)) & (F.least(n, m) + 1e-6 >= share * F.greatest(n, m)))
        met = met.select(F.least("doc.key", "other.key").alias("u"), F.greatest("doc.key", "other.key").alias("v")).distinct()
        pairs = written(met.join(ends[0], "u").join(ends[1], "v").filter(apart <= (1 - 2 * least) * (F.col("nu") + F.col("nv")) + 1e-6).select("u", "v"), "pairs")
        # Written, so that its size is known: a small one is sent to the texts, which then aren't shuffled.
        asked = written(pairs.select(F.col("u").alias("key")).union(pairs.select("v")).distinct(), "asked")
        sets = written(_shingled(docs.join(asked, "key", "left_semi"), shingle).withColumn("rank", F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key")), "sets")
        one, two = (sets.select(F.col("key").alias(k), F.col("shingles").alias(f"s{k}"), F.col("rank").alias(f"r{k}")) for k in "uv")
        both = pairs.join(one, "u").join(two, "v").select(F.greatest("ru", "rv")["key"].alias("key"), F.size("su").alias("n"), F.size("sv").alias("m"), F.size(F.array_intersect("su", "sv")).alias("common"))
        found = written(both.filter(F.col("common") / (F.col("n") + F.col("m") - F.col("common")) >= share).select("key").distinct(), "copies")
        gone = written(gone.unionByName(found).distinct(), "gone")
        led = rest.join(leaders, "shingle").filter(~F.exists("leaders", lambda x: x["key"] == F.col("doc.key"))).select("shingle", "doc", "index")
        before, rest = rest, written(led.join(found, F.col("doc.key") == found["key"], "left_anti"), "rest")
        dropped(before, leaders, pairs, asked, sets)
        turn += 1
    return gone
