"""Frames from picture files, bytes, arrays and tables."""

from __future__ import annotations

from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import imaging
from ..schema import FRAME

# Modes of Spark's image source: channels, by OpenCV's numbers of 8-bit types.
CHANNELS = {0: 1, 16: 3, 24: 4}


@F.pandas_udf(FRAME)
def rgb_of_image(image: pd.DataFrame) -> pd.DataFrame:
    """FRAME of an image struct, whose channels are in the order blue, green, red."""
    out = []
    for h, w, n, data in zip(image["height"], image["width"], image["nChannels"], image["data"], strict=True):
        a = imaging.np.frombuffer(data, imaging.np.uint8).reshape(h, w, n)
        out.append(imaging.to_rgb(a[:, :, [2, 1, 0]] if n >= 3 else a).tobytes())
    return pd.DataFrame({"height": image["height"], "width": image["width"], "data": out})


def _jvm_decode(spark: SparkSession, origin: str, data: bytes) -> imaging.np.ndarray:
    """RGB of an encoded picture by the JVM's readers; alpha is dropped."""
    jvm = spark._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))
    if image is None:
        raise ValueError(f"Could not load image from {origin}")
    h, w = image.getHeight(), image.getWidth()
    buffer = jvm.java.nio.ByteBuffer.allocate(4 * h * w)
    buffer.asIntBuffer().put(image.getRGB(0, 0, w, h, None, 0, w))
    return imaging.np.frombuffer(buffer.array(), imaging.np.uint8).reshape(h, w, 4)[:, :, 1:]


def load_frame(spark: SparkSession, source) -> imaging.np.ndarray:
    """One frame on the driver, of a path, bytes, an array or anything with a convert method that makes it RGB."""
    if isinstance(source, imaging.np.ndarray):
        return imaging.to_rgb(source)
    if isinstance(source, (bytes, bytearray)):
        return _jvm_decode(spark, "bytes", bytes(source))
    if isinstance(source, (str, Path)):
        p = Path(source)
        if not p.exists():
            raise FileNotFoundError(f"no such file: {p}")
        return _jvm_decode(spark, str(p), p.read_bytes())
    if hasattr(source, "convert"):
        return imaging.to_rgb(imaging.np.asarray(source.convert("RGB")))
    raise TypeError(f"Unsupported source type: {type(source)}")


def frames_from_dir(spark: SparkSession, path: str, formats: list[str] | None = None, nested: bool = False) -> DataFrame:
    """(seq_id, seq_pos, frame_id, source_format, frame) of the pictures in a directory, not below it, in the order of their paths. nested: those
    below it, too, each folder a sequence of its own, whose id is the folder's path below the directory.

    A file that can't be decoded fails the run, as it would leave a gap in the sequence."""
    suffixes = "|".join(formats or ["png", "jpg", "jpeg", "bmp", "tiff", "webp"])
    bare = lambda c: F.regexp_replace(c, "^file:/+", "/")
    plain = bare(F.url_decode(F.replace(F.col("image.origin"), F.lit("+"), F.lit("%2B"))))  # an origin is a URI, in which a plus is itself
    name = F.element_at(F.split("_path", "/"), -1)
    kept = F.lower("_path").rlike(f"\\.({suffixes})$")
    read = lambda kind: spark.read.format(kind).option("recursiveFileLookup", nested).load(path)
    files = read("image").withColumn("_path", plain).where(kept)
    # the names alone are ranked; pictures stay in the tasks that read them as long as the names can be broadcast
    names = read("binaryFile").select(bare(F.col("path")).alias("_path")).where(kept).withColumn("_folder", F.regexp_replace("_path", "/[^/]*$", ""))
    ranked = names.select("_path", "_folder", (F.row_number().over(Window.partitionBy("_folder").orderBy("_path")) - 1).cast("long").alias("seq_pos"))
    files = files.join(ranked, "_path")
    good = F.when(F.col("image.height") > 0, F.col("image")).otherwise(F.raise_error(F.concat(F.lit("Could not load image from "), F.col("image.origin"))))
    root = bare(F.lit(path.rstrip("/")))
    return files.select(
        (F.ltrim(F.substr("_folder", F.length(root) + 1), F.lit("/")) if nested else F.lit(path)).alias("seq_id"),
        "seq_pos",
        F.regexp_replace(name, "\\.[^.]*$", "").alias("frame_id"),
        F.regexp_extract(name, "\\.([^.]*)$", 1).alias("source_format"),
        rgb_of_image(good).alias("frame"),
    )


def frames_from_gray(df: DataFrame, pixels: Column, height: int, width: int, seq: str, pos: str) -> DataFrame:
    """df as frames whose gray values come from an array column."""
    from ..functions.columns import gray_frame

    return df.select("*", F.col(seq).cast("string").alias("seq_id"), F.col(pos).cast("long").alias("seq_pos"), gray_frame(pixels, height, width).alias("frame"))
