"""What stands beside pictures: JSON files with metadata, and which picture files there are."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD = "_bad"
SIDECAR = T.StructType([T.StructField("timestamp", T.TimestampType())] + [T.StructField(c, T.StringType()) for c in ("app_name", "window_title", "source_format", BAD)])
ACTION = T.StructType([T.StructField("step_index", T.IntegerType())] + [T.StructField(c, T.StringType()) for c in ("action_uid", "operation", "target_action_reprs")])
TASK = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("annotation_id", "website", "domain", "subdomain", "confirmed_task")] + [T.StructField("num_steps", T.IntegerType()), T.StructField("actions", T.ArrayType(ACTION)), T.StructField(BAD, T.StringType())]
)


def plain_path(path: Column) -> Column:
    """A path without its scheme for local files, without doubled slashes or `./`, absolute."""
    p = F.regexp_replace(F.regexp_replace(path, "^file:/+", "/"), r"(?<![:/])/(?:\./|/)+", "/")
    p = F.regexp_replace(p, r"^\./", "")
    return F.when(p.rlike("^(/|[a-z][a-z0-9+.-]*://)"), p).otherwise(F.concat(F.lit(os.getcwd() + "/"), p))


def _json(spark: SparkSession, path: str, glob: str, schema: T.StructType, nested: bool) -> DataFrame:
    """A file a row, of the schema; what is no such JSON has all fields null and is in _bad."""
    r = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).option("pathGlobFilter", glob)
    return r.option("recursiveFileLookup", nested).json(path).withColumn("_file", F.col("_metadata.file_name")).withColumn("_path", F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))))


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """(frame_id, timestamp, app_name, window_title, source_format, _bad) of the JSON files in a directory; frame_id is the file's name without its suffix."""
    rows = _json(spark, path, "*.json", SIDECAR, False)
    return rows.select(F.regexp_replace(F.element_at(F.split("_path", "/"), -1), r"\.[^.]*$", "").alias("frame_id"), *SIDECAR.names)


def attach_sidecars(frames: DataFrame, beside: DataFrame) -> DataFrame:
    """frames with the metadata of the file of their name; null where there is none. Metadata that frames have already stays where the file has
    none."""
    fields = [c for c in SIDECAR.names if c != BAD]
    s = beside.where(F.col(BAD).isNull()).select(F.col("frame_id").alias("_stem"), F.struct(*fields).alias("_side"))
    joined = frames.join(s, F.col("frame_id") == F.col("_stem"), "left")
    old = lambda c: F.col(c) if c in frames.columns else F.lit(None).cast(SIDECAR[c].dataType)
    return joined.withColumns({c: F.coalesce(F.col(f"_side.{c}"), old(c)) for c in fields}).drop("_stem", "_side")


def tasks(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, fields of TASK) of the metadata.json files below a directory; task_id is the name of the file's folder."""
    rows = _json(spark, path, "metadata.json", TASK, True)
    return rows.select(F.element_at(F.split("_path", "/"), -2).alias("task_id"), *TASK.names)


def attach_tasks(rows: DataFrame, meta: DataFrame, task: str = "seq_id", pos: str = "seq_pos") -> DataFrame:
    """rows (task, pos, ..) with the task's website as app_name, its wording as window_title, its domain, and `action`: the one before the frame, by
    position; null for the first frame and where the task has no more."""
    m = meta.where(F.col(BAD).isNull()).select(F.col("task_id").alias("_task"), "website", "domain", "confirmed_task", "actions")
    place = (F.row_number().over(Window.partitionBy(task).orderBy(pos)) - 1).cast("int")
    joined = rows.withColumn("_n", place).join(m, F.col(task) == F.col("_task"), "left")
    action = F.when(F.col("_n") > 0, F.get("actions", F.col("_n") - 1))
    return joined.withColumns({"app_name": F.coalesce("website", F.lit("")), "window_title": F.coalesce("confirmed_task", F.lit("")), "action": action}).drop("_n", "_task", "actions")


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length) of the files in and below a directory; their content isn't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select(plain_path(F.col("path")).alias("path"), "length")


def with_files(rows: DataFrame, files: DataFrame, column: str = "asset_path") -> DataFrame:
    """rows with <column>_exists and <column>_bytes; null where the row names no file."""
    known = files.select(F.col("path").alias("_path"), F.col("length").alias(f"{column}_bytes")).dropDuplicates(["_path"])
    joined = rows.join(known, plain_path(F.col(column)) == F.col("_path"), "left")
    return joined.withColumn(f"{column}_exists", F.when(F.col(column).isNotNull(), F.col("_path").isNotNull())).drop("_path")


def missing_files(rows: DataFrame, files: DataFrame, column: str = "asset_path") -> DataFrame:
    """The rows whose file isn't there."""
    known = files.select(F.col("path").alias("_path"))
    return rows.where(F.col(column).isNotNull()).join(known, plain_path(F.col(column)) == F.col("_path"), "left_anti")


def unknown_files(files: DataFrame, rows: DataFrame, column: str = "asset_path") -> DataFrame:
    """The files that no row names."""
    return files.join(rows.where(F.col(column).isNotNull()).select(plain_path(F.col(column)).alias("path")).distinct(), "path", "left_anti")
