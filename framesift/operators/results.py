"""Documents of a run: one for each task, and a summary, with the run's own times and counts."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

FRAME_FIELDS = ("frame_id", "event_type", "is_keyframe", "perceptual_hash", "ssim_score", "change_score", "changed_pct", "changed_regions", "adaptive_mask", "asset_path", "visual_reason", "prev_keyframe_id", "action", "source_image")
TASK_FIELDS = ("website", "domain", "confirmed_task")
NULLS = {"ignoreNullFields": "false"}


def rolled_up(rows: DataFrame, task: str = "seq_id") -> DataFrame:
    """(task, is_total, num_frames, num_keyframes, skip_rate) of each task and of all, in one pass; a null task is one of its own."""
    g = rows.rollup(task).agg(F.grouping(task).cast("boolean").alias("is_total"), F.count("*").alias("num_frames"), F.count(F.when(F.col("is_keyframe"), 1)).alias("num_keyframes"))
    rate = F.when(F.col("num_frames") > 0, 1 - F.col("num_keyframes") / F.col("num_frames")).otherwise(F.lit(0.0))
    return g.withColumn("skip_rate", F.round(rate, 6))


def _given(rows: DataFrame, names: tuple[str, ...]) -> list[str]:
    return [c for c in names if c in rows.columns]


def task_documents(rows: DataFrame, task: str = "seq_id", pos: str = "seq_pos") -> DataFrame:
    """(task, document): JSON of a task's counts, what is known of it, and its frames in order. A document holds all frames of its task."""
    counts = rolled_up(rows, task).where("not is_total").drop("is_total")
    frame = F.struct(pos, F.struct(*_given(rows, FRAME_FIELDS)).alias("f"))
    known = [F.first(c, ignorenulls=True).alias(c) for c in _given(rows, TASK_FIELDS)]
    frames = rows.groupBy(task).agg(F.transform(F.array_sort(F.collect_list(frame)), lambda x: x["f"]).alias("frames"), *known)
    both = counts.join(frames.withColumnRenamed(task, "_task"), F.col(task).eqNullSafe(F.col("_task")))
    fields = [F.col(task).alias("task_id"), *_given(rows, TASK_FIELDS), "num_frames", "num_keyframes", "skip_rate", "frames"]
    return both.select(task, F.to_json(F.struct(*fields), NULLS).alias("document"))


def summary_document(rows: DataFrame, task: str = "seq_id", **times) -> DataFrame:
    """One row: JSON of the totals and of each task's counts, in the order of the tasks; times: further numbers for it."""
    known = [F.first(c, ignorenulls=True).alias(c) for c in _given(rows, TASK_FIELDS)]
    r = rolled_up(rows, task)
    if known:
        r = r.join(rows.groupBy(F.col(task).alias("_task")).agg(*known), F.col(task).eqNullSafe(F.col("_task")) & ~F.col("is_total"), "left")
    one = F.struct(F.col(task).alias("task_id"), *_given(rows, TASK_FIELDS), "num_frames", "num_keyframes", "skip_rate")
    total = lambda c: F.coalesce(F.max(F.when(F.col("is_total"), F.col(c))), F.lit(0)).alias(f"total_{c.removeprefix('num_')}")
    g = r.agg(F.array_sort(F.collect_list(F.when(~F.col("is_total"), one))).alias("tasks"), total("num_frames"), total("num_keyframes"), total("skip_rate"))
    fields = ["tasks", "total_frames", "total_keyframes", "total_skip_rate", *[F.lit(v).alias(c) for c, v in times.items()]]
    return g.select(F.to_json(F.struct(*fields), NULLS).alias("document"))


def write_results(rows: DataFrame, out: str, task: str = "seq_id", pos: str = "seq_pos") -> dict:
    """Writes rows to out/rows, and from there out/results (a line a task) and out/summary. The rows are counted while they are written, and the
    time of that is in the summary. Gives these numbers."""
    seen = Observation("run")
    began = time.perf_counter()
    observed = rows.observe(seen, F.count("*").alias("frames"), F.count(F.when(F.col("is_keyframe"), 1)).alias("keyframes"))
    observed.write.mode("overwrite").parquet(f"{out}/rows")
    ms = round((time.perf_counter() - began) * 1000, 1)
    kept = rows.sparkSession.read.schema(rows.schema).parquet(f"{out}/rows")
    task_documents(kept, task, pos).select(F.col("document").alias("value")).write.mode("overwrite").text(f"{out}/results")
    summary_document(kept, task, total_time_ms=ms).select(F.col("document").alias("value")).write.mode("overwrite").text(f"{out}/summary")
    got = seen.get
    return {"frames": got["frames"], "keyframes": got["keyframes"], "total_time_ms": ms, "frames_per_second": round(1000 * got["frames"] / ms, 2) if ms else 0.0}
