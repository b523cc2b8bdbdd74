"""Songs, stems and features derived from the test tables (FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.constants import STATUSES, STEM_TYPES
from cadenza.functions.scalars import duration_str, key_of_camelot
from cadenza.operators import pairs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.get(F.array(*[F.lit(s) for s in STATUSES]), F.col("p_size") % 5)
    rows = table(spark, sf_dir, "part").select(
        (F.col("p_partkey") + 1).alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.col("p_type").alias("genre"),
        F.concat(F.lit("https://example.invalid/t/"), F.col("p_partkey")).alias("source_url"), (F.col("p_retailprice") / 4).alias("duration_secs"), status.alias("status"),
    )
    path = F.when(F.col("status").isin("queued", "error"), "").otherwise(F.concat(F.lit("/raw/"), F.col("id"), F.lit(".mp3")))
    return rows.withColumn("raw_path", path).withColumn("duration_str", duration_str(F.col("duration_secs")))


def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.explode(F.array(*[F.lit(s) for s in STEM_TYPES]))
    rows = songs(spark, sf_dir).filter("id % 11 <> 0").select(F.col("id").alias("song_id"), kinds.alias("stem_type"))
    ordinal = F.array_position(F.array(*[F.lit(s) for s in STEM_TYPES]), F.col("stem_type"))
    return rows.select(((F.col("song_id") - 1) * 3 + ordinal).alias("id"), "song_id", "stem_type", F.concat(F.lit("/stems/"), "stem_type", F.lit("/"), "song_id").alias("file_path"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.posexplode(F.array(*[F.lit(s) for s in STEM_TYPES])).alias("o", "stem_type")
    v, o = F.col("vec_id"), F.col("o")
    letter = F.when(F.col("label") % 2 == 0, "A").otherwise("B")
    code = F.when(v % 89 == 0, None).when(v % 83 == 0, "?").otherwise(F.concat((1 + (7 * v + o) % 12).cast("string"), letter))
    vector = F.transform(F.slice("embedding", 13 * o + 1, F.lit(13)), lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding", kinds).select(
        (v * 3 + o + 1).alias("id"), (v + 1).alias("song_id"), "stem_type", F.when(v % 97 != 0, 60.0 + (37 * v + 11 * o) % 1200 / F.lit(10.0)).alias("bpm"), code.alias("camelot"),
        F.when(v % 79 != 0, (1 + (13 * v + o) % 500) / F.lit(1000.0)).alias("loudness_rms"), (1 + (17 * v + o) % 300).cast("double").alias("energy"), F.when(v % 73 != 0, vector).alias("mfcc"),
    )
    key, mode = key_of_camelot(F.col("camelot"))
    return rows.withColumn("key", key).withColumn("mode", mode)


def candidates(spark: SparkSession, sf_dir: str, strategy: str = "auto", combo: str | None = None) -> DataFrame:
    return pairs.score_all(features(spark, sf_dir), songs(spark, sf_dir), None, strategy, *([(combo,)] if combo else []))
