"""What the operators of this subpackage share: sessions settings, folders, input columns."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which the cluster shares. Where that is unset, a session in one process has a local
    folder of its own; a cluster is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        root = "/tmp/checkpoints/framesift"
        spark.sparkContext.setCheckpointDir(root)
    if "://" not in root and root.startswith("/"):
        root = f"file://{root}"
    return f"{root}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends there and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    with shuffles_deleted(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of what is run here as soon as it has ended. They are there for retries until then. The
    session's option is as before afterwards."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drop(df: DataFrame) -> None:
    """Deletes what cut() wrote, once nothing reads it any more."""
    drop_dir(df.sparkSession, df._cut_path)


def drop_dir(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def crc_mod(col, mod: int):
    """crc32(doc_id as text) mod `mod`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % mod


def text_bytes(df: DataFrame, *keep: str) -> DataFrame:
    """The columns kept and the whole text as UTF-8 bytes; a null text is empty."""
    return df.select(*keep, F.coalesce(df["text"], F.lit("")).cast("binary").alias("text"))


def sliced(it: Iterator[pa.RecordBatch], rows: int = 500, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows and about `size` bytes (one row at least), none empty. A worker's memory follows
    the slice, whatever the session's batch size is; Spark itself bounds the bytes of a batch."""
    for b in it:
        step = max(1, min(rows, b.num_rows * size // max(1, b.nbytes)))
        for lo in range(0, b.num_rows, step):
            yield b.slice(lo, step)


def batches(it: Iterator[pa.RecordBatch], rows: int = 500, size: int = 8 << 20) -> Iterator[dict[str, list]]:
    for b in sliced(it, rows, size):
        yield {n: c.to_pylist() for n, c in zip(b.schema.names, b.columns, strict=True)}


def released() -> None:
    """Gives memory that is free back to the system, where the C library can: allocators of a worker that lives on would hold it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def whole(df: DataFrame) -> F.Column:
    """All columns in one, under names that clash with none; see parts()."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc")


def parts(df: DataFrame, **new) -> list:
    """The columns of df from whole(df), those in `new` replaced, in their order; new ones last."""
    old = [new[c].alias(c) if c in new else F.col(f"doc.`{c}`").alias(c) for c in df.columns]
    return old + [v.alias(c) for c, v in new.items() if c not in df.columns]
