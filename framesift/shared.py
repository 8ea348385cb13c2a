"""Folders that the driver and all executors see."""

from __future__ import annotations

import os
import re
import uuid
from urllib.parse import quote

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, a session in one process has a local one; a cluster is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        root = "/tmp/checkpoints/framesift"
    if root.startswith("/"):
        root = f"file://{root}"
    return f"{root}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to a new shared folder and reads it back: the lineage ends there and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and its name there; names may hold blanks and percent signs, which are themselves."""
    if path.startswith("file:") or "://" not in path:
        return pafs.LocalFileSystem(), os.path.abspath(re.sub("^file:/+", "/", path))
    return pafs.FileSystem.from_uri(quote(path, safe="/:@?=&"))
