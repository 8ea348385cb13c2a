"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "frame_load", "block_means", "phash", "phash_tiled", "compare_frames", "adaptive_mask", "cascade_keyframes", "manifest", "scalar_keyframes", "coarse_sample", "backfill", "keyframe_index",
    "time_since_prev", "speech_runs", "transcript_align", "transcript_parse", "pii_counts", "pii_matches", "pii_redact_text", "task_summary",
)


def frames_per_second(spark, partitions: int, frames: int = 200) -> float:
    """Full-size frames through the cascade, a sequence for each partition: 1920 x 1080, changing every fourth frame; workers are warm."""
    from pyspark.sql import functions as F

    from framesift.config import Settings
    from framesift.operators.cascade import cascade

    cell = F.hex((F.floor(F.col("id") / 4) % 3 * 80 + 40).cast("int"))
    data = F.unhex(F.repeat(F.lpad(cell, 2, "0"), 1920 * 1080 * 3))
    f = spark.range(frames, numPartitions=partitions).select(
        (F.col("id") % partitions).cast("string").alias("seq_id"), F.col("id").alias("seq_pos"), F.struct(F.lit(1080).alias("height"), F.lit(1920).alias("width"), data.alias("data")).alias("frame")
    )
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    f = f.cache()
    f.count()
    began = time.time()
    cascade(f, Settings()).write.format("noop").mode("overwrite").save()
    took = time.time() - began
    f.unpersist()
    return frames / took


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from pyspark.sql import SparkSession

    from framesift.plans.queries import QUERIES

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    QUERIES["frame_load"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the workers
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    frames_per_second(spark, 4, 8)
    fps = {f"fps_1080p_{n}_partitions": round(frames_per_second(spark, n), 2) for n in (1, 4)}
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "frames_per_second": fps}))


if __name__ == "__main__":
    main()
