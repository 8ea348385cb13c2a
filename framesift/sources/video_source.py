"""Video files as a data source: tasks by ranges of frames, and only the frames that are asked for are decoded.

`spark.read.format("framesift_video").option("sampleFps", 1).load(path)` gives (seq_id, seq_pos, fps, duration, width, height, total_frames, frame),
seq_id being the file's name. Comparisons of seq_pos and seq_id with constants are pushed down: files and ranges beside them are neither
opened nor decoded. sampleFps keeps every max(1, int(fps / sampleFps))-th frame; framesPerTask says how many frames of the file a task covers.
For ranges that come from a table, gap_frames() decodes each gap by seeking to it.

Uncompressed video (.y4m) is read here, a frame at its place in the file; other formats by PyAV where it is installed, from the key picture
before the range.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import FRAME
from ..shared import file_system

NAME = "framesift_video"
SUFFIXES = (".mp4", ".mov", ".webm", ".y4m")
SCHEMA = T.StructType(
    [T.StructField("seq_id", T.StringType()), T.StructField("seq_pos", T.LongType()), T.StructField("fps", T.DoubleType()), T.StructField("duration", T.DoubleType())]
    + [T.StructField(c, T.IntegerType()) for c in ("width", "height", "total_frames")]
    + [T.StructField("frame", FRAME)]
)
META = "path string, filename string, duration double, fps double, width int, height int, total_frames int"
END = 1 << 62


def name_of(path: str) -> str:
    return path.rstrip("/").rpartition("/")[2]


@dataclass(frozen=True)
class Meta:
    fps: float
    duration: float
    width: int
    height: int

    @property
    def total_frames(self) -> int:
        return int(round(self.fps * self.duration, 6))

    def row(self) -> dict:
        return {"fps": self.fps, "duration": self.duration, "width": self.width, "height": self.height, "total_frames": self.total_frames}


class Y4m:
    """Uncompressed video. Frames have one size in bytes, so any is read alone."""

    #: Width and height of the colour planes, as divisors, of 8 bits; None: no colour.
    PLANES = dict.fromkeys(("420", "420jpeg", "420mpeg2", "420paldv"), (2, 2)) | {"422": (2, 1), "444": (1, 1), "mono": None}

    def __init__(self, path: str):
        fs, name = file_system(path)
        try:
            self.file = fs.open_input_file(name)
            head = self.file.read_at(min(self.file.size(), 256), 0)
            line = head[: head.index(b"\n")].decode()
            magic, *tags = line.split(" ")
            given = {t[0]: t[1:] for t in tags if t}
            w, h = int(given["W"]), int(given["H"])
            fps = float(Fraction(given.get("F", "30:1").replace(":", "/")))
            cut = self.PLANES[given.get("C", "420")]
            if magic != "YUV4MPEG2" or w <= 0 or h <= 0 or fps <= 0:
                raise ValueError(line)
        except FileNotFoundError:
            raise
        except Exception as e:
            raise ValueError(f"Could not open video {path}: {e}") from e
        self.plane = (-(-h // cut[1]), -(-w // cut[0])) if cut else (0, 0)
        self.at = len(line) + 1
        self.marker = len(b"FRAME\n")
        self.size = self.marker + w * h + 2 * self.plane[0] * self.plane[1]
        self.frames = (self.file.size() - self.at) // self.size
        self.meta = Meta(fps, self.frames / fps, w, h)

    def decode(self, start: int, end: int, every: int) -> Iterator[tuple[int, np.ndarray]]:
        first = start + -start % every
        for i in range(first, min(end, self.frames), every):
            yield i, self._rgb(self.file.read_at(self.size, self.at + i * self.size))

    def _rgb(self, data: bytes) -> np.ndarray:
        """Full range from the studio range of BT.601; gray as it is."""
        if not data.startswith(b"FRAME\n"):
            raise ValueError("Could not decode video: frames with parameters aren't read")
        h, w, (ph, pw) = self.meta.height, self.meta.width, self.plane
        a = np.frombuffer(data, np.uint8, offset=self.marker)
        y = a[: h * w].reshape(h, w)
        if not ph:
            return np.repeat(y[:, :, None], 3, axis=2)
        u, v = (p.reshape(ph, pw).repeat(-(-h // ph), axis=0).repeat(-(-w // pw), axis=1)[:h, :w].astype(np.float32) - 128 for p in (a[h * w : h * w + ph * pw], a[h * w + ph * pw :]))
        y = (y.astype(np.float32) - 16) * (255 / 219)
        rgb = np.stack([y + 1.5960 * v, y - 0.3918 * u - 0.8130 * v, y + 2.0172 * u], axis=2)
        return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)

    def close(self) -> None:
        self.file.close()


class Av:
    """Compressed video by PyAV."""

    def __init__(self, path: str):
        try:
            import av
        except ImportError as e:
            raise ImportError("video files need PyAV; or give uncompressed video, or a table of decoded frames") from e
        fs, name = file_system(path)
        if fs.get_file_info(name).type == pafs.FileType.NotFound:
            raise FileNotFoundError(f"no such file: {path}")
        try:
            self.box = av.open(fs.open_input_file(name))
            self.stream = self.box.streams.video[0]
        except Exception as e:
            raise ValueError(f"Could not open video {path}: {e}") from e
        fps = float(self.stream.average_rate or 30)
        base = self.stream.duration * self.stream.time_base if self.stream.duration else (self.box.duration or 0) / 1_000_000
        self.meta = Meta(fps, float(base), self.stream.codec_context.width, self.stream.codec_context.height)

    def decode(self, start: int, end: int, every: int) -> Iterator[tuple[int, np.ndarray]]:
        fps = self.meta.fps
        if start:
            self.box.seek(int(start / fps / self.stream.time_base), stream=self.stream)
        for f in self.box.decode(self.stream):
            if f.pts is None:
                continue
            i = round(float(f.pts * self.stream.time_base) * fps)
            if i >= end:
                return
            if i >= start and i % every == 0:
                yield i, f.to_ndarray(format="rgb24")

    def close(self) -> None:
        self.box.close()


def open_video(path: str) -> Y4m | Av:
    return Y4m(path) if path.lower().endswith(".y4m") else Av(path)


def listed(path: str) -> list[str]:
    """A file, or the videos in a directory, in order."""
    fs, name = file_system(path)
    info = fs.get_file_info(name)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(f"no such path: {path}")
    if info.type == pafs.FileType.File:
        return [path]
    found = sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(name)) if f.type == pafs.FileType.File and f.base_name.lower().endswith(SUFFIXES))
    return [f"{path.rstrip('/')}/{f}" for f in found]


@dataclass
class Part(InputPartition):
    path: str
    start: int
    end: int


class VideoReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        options = {k.lower(): v for k, v in options.items()}  # Spark doesn't keep their case
        paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.paths = [f for p in paths for f in listed(p)]
        self.per_task = int(options.get("framespertask", 1800))
        self.sample_fps = float(options["samplefps"]) if "samplefps" in options else None
        self.low, self.high, self.names = 0, END, None
        if self.per_task < 1 or self.sample_fps is not None and self.sample_fps <= 0:
            raise ValueError("framesPerTask and sampleFps are above 0")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Those that are not taken over."""
        for f in filters:
            column = ".".join(f.attribute) if hasattr(f, "attribute") else None
            if column == "seq_id" and isinstance(f, EqualTo | In):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = names if self.names is None else self.names & names
            elif column == "seq_pos" and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.high = min(self.high, f.value + (not isinstance(f, LessThan)))
            elif not isinstance(f, IsNotNull):  # no column has nulls
                yield f

    def partitions(self) -> list[Part]:
        out = []
        for p in self.paths:
            if self.names is not None and name_of(p) not in self.names:
                continue
            v = open_video(p)
            v.close()
            last = min(self.high, END if isinstance(v, Av) else v.frames)
            step, first = self.per_task, self.low // self.per_task
            ends = range(first, max(first + 1, -(-min(last, v.meta.total_frames + 1) // step)))
            tasks = [Part(p, max(self.low, k * step), min(last, (k + 1) * step)) for k in ends]
            if tasks and isinstance(v, Av):
                tasks[-1].end = last  # frames beyond the number that the file states
            out += [t for t in tasks if t.start < t.end]
        return out or [Part("", 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.start >= partition.end:
            return
        v = open_video(partition.path)
        try:
            every = max(1, int(v.meta.fps / self.sample_fps)) if self.sample_fps else 1
            for i, a in v.decode(partition.start, partition.end, every):
                yield batch_of([(partition.path, v.meta, i, a)])
        finally:
            v.close()


def batch_of(rows: list[tuple[str, Meta, int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(
        [{"seq_id": name_of(p), "seq_pos": i, "frame": {"height": a.shape[0], "width": a.shape[1], "data": a.tobytes()}} | m.row() for p, m, i, a in rows], to_arrow_schema(SCHEMA)
    )


class VideoSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> VideoReader:
        return VideoReader(dict(self.options))


def read_videos(spark: SparkSession, paths: list[str], sample_fps: float | None = None, frames_per_task: int | None = None) -> DataFrame:
    """Frames of video files, or of those in directories."""
    spark.dataSource.register(VideoSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    r = spark.read.format(NAME).option("paths", json.dumps(paths))
    r = r if sample_fps is None else r.option("sampleFps", sample_fps)
    r = r if frames_per_task is None else r.option("framesPerTask", frames_per_task)
    return r.load()


def video_meta(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, filename, duration, fps, width, height, total_frames) of videos; nothing is decoded."""

    def run(it):
        for b in it:
            rows = []
            for p in b["path"].to_pylist():
                v = open_video(p)
                rows.append({"path": p, "filename": name_of(p)} | v.meta.row())
                v.close()
            yield pa.RecordBatch.from_pylist(rows, out)

    out = to_arrow_schema(T._parse_datatype_string(META))
    files = spark.createDataFrame([(f,) for p in paths for f in listed(p)], "path string")
    return files.repartition("path").mapInArrow(run, META)


def gap_frames(gaps: DataFrame, paths: list[str]) -> DataFrame:
    """The frames strictly between prev_no and frame_no of each gap (seq_id, prev_no, frame_no), in the source's columns; a gap a row, decoded
    where it lies."""
    of = {name_of(f): f for p in paths for f in listed(p)}

    def run(it):
        for b in it:
            for name, low, high in zip(*(b[c].to_pylist() for c in ("seq_id", "prev_no", "frame_no")), strict=True):
                v = open_video(of[name])
                for i, a in v.decode(low + 1, high, 1):
                    yield batch_of([(of[name], v.meta, i, a)])
                v.close()

    wide = gaps.select("seq_id", "prev_no", "frame_no").where(F.col("frame_no") - F.col("prev_no") > 1)
    return wide.repartition("seq_id", "frame_no").mapInArrow(run, SCHEMA)
