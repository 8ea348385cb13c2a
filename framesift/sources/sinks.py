"""Manifests and keyframe pictures."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import imaging
from ..functions.jpeg import jpeg
from ..operators.cascade import to_manifest
from ..shared import file_system


def write_manifest(df: DataFrame, path: str, compression: str = "snappy", *extra: str) -> bool:
    """Overwrites path with the manifest; writes nothing and returns False where there are no rows."""
    rows = to_manifest(df, *extra)
    if rows.isEmpty():
        return False
    rows.write.mode("overwrite").option("compression", "uncompressed" if compression == "none" else compression).parquet(path)
    return True


def encoded(frame, path: str) -> bytes:
    """The picture in the format of the path's suffix, PNG or JPEG."""
    kind = path.rpartition(".")[2].lower()
    if kind == "png":
        return imaging.png(frame)
    if kind in ("jpg", "jpeg"):
        return jpeg(frame)
    raise ValueError(f"pictures are written as png or jpg, not {kind}")


def save_keyframes(df: DataFrame) -> DataFrame:
    """Writes frame to asset_path on keyframes, in its format, from the tasks; returns (asset_path, n_bytes). Paths are of a shared folder.

    A picture is written under another name and moved, so that a task that runs again leaves whole files."""

    def run(it):
        for b in it:
            done, sizes = [], []
            for path, f in zip(b.column("asset_path").to_pylist(), b.column("frame").to_pylist(), strict=True):
                data = encoded(imaging.from_bytes(f["data"], f["height"], f["width"]), path)
                fs, name = file_system(path)
                fs.create_dir(name.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(f"{name}.tmp") as out:
                    out.write(data)
                fs.move(f"{name}.tmp", name)
                done.append(path)
                sizes.append(len(data))
            yield pa.RecordBatch.from_pydict({"asset_path": done, "n_bytes": pa.array(sizes, pa.int64())})

    return df.where(F.col("is_keyframe")).select("asset_path", "frame").mapInArrow(run, "asset_path string, n_bytes long")
