"""A manifest that grows with a stream.

Each micro-batch is written once to a folder of its own, pixels of keyframes included; what follows reads that. Rows go to `log`, bad
messages to `rejects`, by batch id: a batch that runs twice overwrites its own partitions and nothing else, and its pictures have the same
names. The number of a sequence's keyframes is known only later, so `finish` overwrites, in `manifest`, the partitions of the sequences
that were touched since it ran last. What was touched is read from the two tables, so it survives a restart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Settings
from ..operators import pii
from ..operators.cascade import to_manifest
from ..schema import KEYFRAME, SKIPPED
from ..sources import sinks
from . import messages

LATE = "Late frame — one behind it had been folded"
BUCKETS = 64


def file_name(c: str) -> Column:
    """The column's text where it can name a file; else what can, and a hash of the text, so that no two meet."""
    plain = F.regexp_replace(c, r"[^A-Za-z0-9._-]|^\.+$", "_")
    return F.when(plain == F.col(c), plain).otherwise(F.concat(plain, F.lit("-"), F.lower(F.hex(F.xxhash64(c)))))


class ManifestSink:
    """For foreachBatch, of messages.OUT rows. patterns and make_engine: redaction of keyframes, if there are patterns."""

    def __init__(self, settings: Settings, patterns: list[pii.Pattern] = (), make_engine: Callable[[], pii.Engine] = pii.easyocr_engine, buckets: int = BUCKETS):
        self.settings, self.patterns, self.make_engine, self.buckets = settings, list(patterns), make_engine, buckets
        self.out = settings.exporter.output_dir.rstrip("/")

    def _rows(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """With the columns that follow from others."""
        suffix = f".{self.settings.exporter.keyframe_format}"
        path = lambda c: F.concat(F.lit(f"{self.out}/"), file_name("seq_id"), F.lit("/"), file_name(c), F.lit(suffix))
        return batch.withColumns(
            {
                "event_type": F.when(F.col("is_keyframe"), KEYFRAME).otherwise(SKIPPED), "asset_path": F.when(F.col("is_keyframe"), path("frame_id")), "prev_keyframe_path": path("prev_keyframe_id"),
                "visual_reason": F.when(F.col("late"), LATE).otherwise(F.col("visual_reason")), "bucket": F.pmod(F.xxhash64("seq_id"), F.lit(self.buckets)).cast("int"), "batch_id": F.lit(batch_id).cast("long"),
            }
        )

    def _write(self, df: DataFrame, name: str, *by: str) -> None:
        """Overwrites the partitions that df has rows of."""
        w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", {"none": "uncompressed"}.get(c := self.settings.exporter.parquet_compression, c))
        w.partitionBy(*by).parquet(f"{self.out}/{name}")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        staged = f"{self.out}/_staged/{batch_id}"
        batch.write.mode("overwrite").parquet(staged)
        rows = self._rows(spark.read.schema(messages.OUT).parquet(staged), batch_id)
        good = rows.where("bad is null")
        if self.patterns:
            good = pii.redact_keyframes(good, self.patterns, self.make_engine, self.settings.redactor.scope)
            checked = f"{self.out}/_staged/{batch_id}-checked"
            good.write.mode("overwrite").parquet(checked)
            good = spark.read.schema(good.schema).parquet(checked)
        sinks.save_keyframes(good.select("is_keyframe", "asset_path", "frame")).count()
        self._write(to_manifest(good, "seq_id", "seq_pos", "late", "bucket", "batch_id"), "log", "bucket", "batch_id")
        self._write(rows.where("bad is not null").select("seq_id", "seq_pos", "frame_id", "bad", "batch_id"), "rejects", "batch_id")
        for path in (staged, f"{staged}-checked"):
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

    def _table(self, spark: SparkSession, name: str) -> DataFrame | None:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{self.out}/{name}")
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(p) or not any(s.isDirectory() for s in fs.listStatus(p)):
            return None
        return spark.read.parquet(f"{self.out}/{name}")

    def finish(self, spark: SparkSession) -> list[int]:
        """Brings `manifest` up to date; the buckets that were written anew."""
        log, old = self._table(spark, "log"), self._table(spark, "manifest")
        if log is None:
            return []
        newest = log.groupBy("bucket").agg(F.max("batch_id").alias("new"))
        if old is not None:
            newest = newest.join(old.groupBy("bucket").agg(F.max("batch_id").alias("old")), "bucket", "left").where("old is null or new > old")
        touched = sorted(r.bucket for r in newest.select("bucket").collect())  # as many as there are buckets, at most
        if touched:
            rows = log.where(F.col("bucket").isin(touched))
            total = F.count(F.when(F.col("is_keyframe"), 1)).over(Window.partitionBy("seq_id")).cast("int")
            rows = rows.withColumn("total_keyframes", F.when(F.col("is_keyframe"), total))
            self._write(to_manifest(rows, "seq_id", "seq_pos", "late", "batch_id", "bucket").repartition("bucket").sortWithinPartitions("bucket", "seq_id", "seq_pos"), "manifest", "bucket")
        return touched


def start(lines: DataFrame, sink: ManifestSink, checkpoint: str, **options) -> StreamingQuery:
    """Starts the stream, for what is there now; options as of messages.fold_messages. State goes to RocksDB, whatever the session's store is."""
    spark, key = lines.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, messages.ROCKSDB)
    try:
        folded = messages.fold_messages(lines, sink.settings, **options)
        return folded.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def run_stream(spark: SparkSession, path: str, settings: Settings, patterns: list[pii.Pattern] = (), make_engine: Callable[[], pii.Engine] = pii.easyocr_engine, files: int | None = None, glob: str = "*.json*") -> tuple[int, int]:
    """Folds the messages of a directory that haven't been folded yet; keyframes and frames of the manifest then."""
    sink = ManifestSink(settings, patterns, make_engine)
    start(messages.read_lines(spark, path, files, glob), sink, f"{sink.out}/_checkpoint").awaitTermination()
    sink.finish(spark)
    table = sink._table(spark, "manifest")
    if table is None:
        return 0, 0
    r = table.agg(F.count(F.when(F.col("is_keyframe"), 1)), F.count("*")).first()
    return r[0], r[1]
