"""Sampling, backfill and numbering of keyframes, by filters, ranges and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coarse_sample(df: DataFrame, frame_no: str, fps, sample_fps: float = 1.0) -> DataFrame:
    """Every max(1, int(fps / sample_fps))-th frame."""
    every = F.greatest(F.lit(1), F.floor((fps if not isinstance(fps, (int, float)) else F.lit(float(fps))) / sample_fps)).cast("long")
    return df.where(F.col(frame_no) % every == 0)


def transitions(df: DataFrame, seq: str, pos: str, frame_no: str) -> DataFrame:
    """(seq, prev_no, frame_no) where a skipped sample is followed by a keyframe."""
    w = Window.partitionBy(seq).orderBy(pos)
    marked = df.withColumn("_kf", F.lag("is_keyframe").over(w)).withColumn("prev_no", F.lag(frame_no).over(w))
    return marked.where(F.col("is_keyframe") & ~F.col("_kf")).select(seq, "prev_no", F.col(frame_no).alias("frame_no"))


def backfill(frames: DataFrame, gaps: DataFrame, seq: str, frame_no: str, bucket: int = 256) -> DataFrame:
    """Frames strictly within the gaps; gaps of a sequence don't meet, so a frame is found once at most. A frame meets only the gaps in its
    bucket of frame numbers."""
    g = gaps.where("frame_no - prev_no > 1").select(F.col(seq).alias("_seq"), F.col("prev_no").alias("_lo"), F.col("frame_no").alias("_hi"))
    at = lambda c: F.floor(c / bucket)
    g = g.withColumn("_b", F.explode(F.sequence(at(F.col("_lo") + 1), at(F.col("_hi") - 1))))
    within = (F.col(seq) == F.col("_seq")) & (at(F.col(frame_no)) == F.col("_b")) & (F.col(frame_no) > F.col("_lo")) & (F.col(frame_no) < F.col("_hi"))
    return frames.join(g, within).select(*frames.columns)


def number_keyframes(df: DataFrame, seq: str, pos: str) -> DataFrame:
    """df with keyframe_index (1-based) and total_keyframes, null on other rows."""
    kf = F.when(F.col("is_keyframe"), 1)
    w = Window.partitionBy(seq)
    index = F.count(kf).over(w.orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    return df.withColumn("keyframe_index", F.when(F.col("is_keyframe"), index)).withColumn("total_keyframes", F.when(F.col("is_keyframe"), F.count(kf).over(w).cast("int")))


def time_since_prev(df: DataFrame, seq: str, pos: str, seconds: str) -> DataFrame:
    """df with time_since_prev_keyframe on keyframes after the first."""
    w = Window.partitionBy(seq).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("is_keyframe"), F.col(seconds)), ignorenulls=True).over(w)
    return df.withColumn("time_since_prev_keyframe", F.when(F.col("is_keyframe"), F.col(seconds) - before))


def prior(df: DataFrame, seq: str, pos: str, column: str, name: str) -> DataFrame:
    """df with the column's value of the row before; null on the first."""
    return df.withColumn(name, F.lag(column).over(Window.partitionBy(seq).orderBy(pos)))


def summary(df: DataFrame, *keys: str) -> DataFrame:
    """num_frames, num_keyframes, skip_rate and keyframe_pct by the keys; one row over all without keys."""
    kf = F.sum(F.col("is_keyframe").cast("long"))
    g = (df.groupBy(*keys) if keys else df.groupBy()).agg(F.count("*").alias("num_frames"), F.coalesce(kf, F.lit(0)).alias("num_keyframes"))
    share = F.when(F.col("num_frames") > 0, F.col("num_keyframes") / F.col("num_frames"))
    return g.withColumn("skip_rate", F.coalesce(1 - share, F.lit(0.0))).withColumn("keyframe_pct", F.coalesce(100 * share, F.lit(0.0)))


def first_groups(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """Rows of the n groups that are seen first: groups rank by their least row, and only n rows leave the ranking."""
    seen = df.groupBy(key).agg(F.min(F.struct(*order)).alias("_first")).orderBy("_first").limit(n)
    return df.join(F.broadcast(seen.select(key)), key, "left_semi")
