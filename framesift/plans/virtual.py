"""Virtual frames over the plain tables, at the size where the functions' parameters are the real ones, scaled.

Embeddings of 64 values are 8 x 8 gray frames, in sequences by label; events are a sequence of values by user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..sources.images import frames_from_gray

SETTINGS = {
    "masking": {"block_size": 2, "window_size": 5, "noise_threshold": 1.0},
    "hasher": {"hash_size": 2},
    "comparator": {"ssim_threshold": 0.25, "min_changed_blocks": 14},
    "redactor": {"enabled": False},
}
SIDE, BLOCK, HASH = 8, 2, 2


def settings(**masking) -> Settings:
    return Settings.of(SETTINGS | {"masking": SETTINGS["masking"] | masking})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(embedding: Column) -> Column:
    return F.transform(embedding, lambda v: F.floor(F.least(F.greatest((v.cast("double") + 1) * 127.5, F.lit(0.0)), F.lit(255.0))).cast("int"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, seq_id, seq_pos, frame."""
    e = table(spark, sf_dir, "embeddings")
    return frames_from_gray(e, pixels(F.col("embedding")), SIDE, SIDE, "label", "vec_id").drop("embedding")


def by_label() -> Window:
    return Window.partitionBy("label").orderBy("vec_id")


def with_previous(df: DataFrame, *columns: str) -> DataFrame:
    """df with prev_<column> of the frame before, first frames left out."""
    w = by_label()
    for c in columns:
        df = df.withColumn(f"prev_{c}", F.lag(c).over(w))
    return df.where(F.col(f"prev_{columns[0]}").isNotNull())


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, ts, secs (since the epoch), event_type, value, frame_no (from 0, by user)."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    secs = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select("event_id", "user_id", "ts", secs.alias("secs"), "event_type", "value", (F.row_number().over(w) - 1).cast("long").alias("frame_no"))
