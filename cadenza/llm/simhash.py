"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm._shared import leaning, written
from cadenza.llm.components import connected_components

_BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text, as a signed integer.

    A-Z become lower case; words are runs of bytes other than space and
    0x09-0x0D. A bit is 1 if it is set in over half the XXH64 values (seed 42)
    of the word shingles, repeats included. Fewer words than ``shingle``: one
    shingle of all of them. No word or null: 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    columns = [words[i:] for i in range(min(shingle, len(words)))]
    hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(w), 42) for w in zip(*columns)), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _BLOCK):
        octets = hashes[at : at + _BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, key, fp long) for every row of docs; see ``fingerprint``. key: a hash of doc_id and text."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t, shingle) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], schema=schema)

    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows = docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("key"), text.alias("text"))
    return rows.mapInArrow(leaning(run), "doc_id long, key long, fp long")


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (u, v) that connect the distinct fingerprints (column fp) within ``radius`` bits.

    Every fingerprint emits all variants within half the radius; two of them
    lie within the radius exactly if they share a variant. So all members of a
    variant's bucket are linked, a bucket never holds more fingerprints than a
    ball has points (65 for radius 2), and a star around its smallest member
    connects what all its pairs would. The radius must be even, so that a
    shared variant proves the distance; pairs are verified all the same.
    """
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be even")
    masks = [sum(1 << b for b in bits) for n in range(radius // 2 + 1) for bits in combinations(range(64), n)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    ball = F.array(*[F.lit(m).cast("long") for m in signed])
    # Copies meet before the shuffle; the few distinct fingerprints are then dealt evenly, as each makes many variants.
    dealt = fps.select("fp").distinct().repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    variants = dealt.select("fp", F.explode(F.transform(ball, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    buckets = variants.groupBy("variant").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    stars = buckets.select(F.array_min("fps").alias("v"), F.explode("fps").alias("u")).filter("u <> v")
    return stars.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id, key) for every row of docs.

    fingerprint: 16 lowercase hex digits. component_id: the smallest doc_id
    that can be reached over links of at most ``radius`` differing bits; equal
    fingerprints are always linked. A null text counts as an empty one
    (fingerprint zero); all such documents are linked. Rows with a null doc_id
    are kept and take part, but name no component unless alone (then null).
    Repeated rows are kept; key, a hash of doc_id and text, is the same in them. An empty table gives an empty result. Only doc_id
    and text are read, so other columns can't clash.
    """
    fps = written(fingerprints(docs, shingle), "fingerprints")
    least = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "least")
    component = connected_components(links(least, radius))
    member = least.join(component, least.fp == component.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    smallest = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(member.join(smallest, "root").select("fp", "component_id"), "named")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "key")


def representatives(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """docs with one row of every component of ``near_duplicates``: the smallest doc_id, null last.

    Groups whose rows all have a null doc_id are kept one row per fingerprint.
    """
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    groups = near_duplicates(docs, shingle, radius).withColumn("unnamed", F.when(F.col("component_id").isNull(), F.col("fingerprint")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key"))
    chosen = groups.groupBy("component_id", "unnamed").agg(first.alias("first")).select(F.col("first.key").alias("_key"))
    rows = docs.withColumn("_of", key).join(written(chosen, "chosen"), F.col("_of") == F.col("_key"), "left_semi")
    return rows.dropDuplicates(["_of"]).drop("_of")


def op4_simhash_near_dedup(spark, sf_dir):
    """Every document's fingerprint and component; edge cases as in ``near_duplicates``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 2).drop("key")
