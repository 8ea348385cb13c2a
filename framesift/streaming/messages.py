"""Frames as JSON messages, folded on a stream.

A message is `{"sequence", "position", "frame_id", "timestamp", "app_name", "window_title", "source_format", "image"}`, the image in
base64. A message without an image, or without a position and a time, or whose picture can't be decoded, is passed on with what is bad
about it and changes no state. A time stands in for a missing position, in microseconds.

State is typed, keyed by sequence and kept in RocksDB: the last keyframe with its features, the place in the sequence, the last block means and
the last changes. A keyframe is written only when there is a new one. Pictures stay encoded until their turn, so a task holds one in
pixels besides the keyframe, and the micro-batch's rows of one sequence as they came.

Frames of a micro-batch are put in order. One that comes after a frame behind it has been folded is late: it is flagged, not folded, and so
is one that comes twice. A sequence that has been silent for `idle` of event time is forgotten by a timer, so state follows the sequences
that are alive; a frame that comes then begins anew. Spark itself drops frames that are behind the watermark and counts them in the
query's progress; `delay` says how far behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import Settings
from ..functions import pictures
from ..operators.cascade import DECISION, Features, Walk
from ..schema import FRAME

MESSAGE = T.StructType(
    [T.StructField("sequence", T.StringType()), T.StructField("position", T.LongType()), T.StructField("frame_id", T.StringType()), T.StructField("timestamp", T.TimestampType())]
    + [T.StructField(c, T.StringType()) for c in ("app_name", "window_title", "source_format", "image", "_bad")]
)
META = ["frame_id", "timestamp", "app_name", "window_title", "source_format"]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = T.StructType(
    [T.StructField("seq_id", T.StringType()), T.StructField("seq_pos", T.LongType()), *(MESSAGE[c] for c in META), T.StructField("frame_height", T.IntegerType()), T.StructField("frame_width", T.IntegerType())]
    + [*DECISION.fields, T.StructField("keyframe_index", T.IntegerType()), T.StructField("late", T.BooleanType()), T.StructField("bad", T.StringType()), T.StructField("frame", FRAME)]
)
NOT_JSON, NO_IMAGE, NO_PLACE = "not a message", "no image", "no position and no time"


def read_lines(spark: SparkSession, path: str, files: int | None = None, glob: str = "*.json*") -> DataFrame:
    """A stream of the lines of the files in a directory, at most so many new files in a micro-batch."""
    r = spark.readStream.option("pathGlobFilter", glob)
    return (r.option("maxFilesPerTrigger", files) if files else r).text(path)


def parse(lines: DataFrame) -> DataFrame:
    """Lines (value) as (seq_id, seq_pos, event_time, metadata, picture, bad), a row for each line."""
    m = F.from_json("value", MESSAGE, {"columnNameOfCorruptRecord": "_bad"})
    rows = lines.select(F.col("value"), m.alias("m")).select("value", "m.*")
    place = F.coalesce("position", F.unix_micros("timestamp"))
    picture = F.try_to_binary("image", F.lit("base64"))
    nothing = F.greatest(*[F.col(c).isNotNull() for c in ("sequence", "position", "frame_id", "timestamp", "app_name", "window_title", "source_format", "image")])
    bad = F.when(F.col("_bad").isNotNull() | ~F.coalesce(nothing, F.lit(False)), NOT_JSON).when(picture.isNull(), NO_IMAGE).when(place.isNull(), NO_PLACE)
    return rows.select(
        F.coalesce("sequence", F.lit("stream")).alias("seq_id"), place.alias("seq_pos"), F.coalesce("timestamp", F.current_timestamp()).alias("event_time"),
        F.coalesce("frame_id", F.format_string("frame_%06d", place)).alias("frame_id"), *META[1:], picture.alias("picture"), bad.alias("bad"), "value",
    )


class FrameFold(StatefulProcessor):
    """One sequence's walk between micro-batches."""

    def __init__(self, settings: Settings, idle_ms: int):
        self.settings, self.idle_ms = settings, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "pos long, kept string, keyframes int")
        self.keyframe = handle.getValueState("keyframe", "height int, width int, pixels binary, hashes array<string>, means array<array<double>>, tall boolean")
        self.means = handle.getValueState("means", "rows int, cols int, data binary")
        self.changes = handle.getListState("changes", "bits binary")

    def _walk(self) -> tuple[Walk, int | None, int]:
        walk, pos, count = Walk(self.settings), None, 0
        if self.place.exists():
            pos, walk.kept, count = self.place.get()
        if self.keyframe.exists():
            h, w, data, hashes, means, tall = self.keyframe.get()
            walk.fold.last = Features(np.frombuffer(data, np.uint8).reshape(h, w, 3), list(hashes), [list(m) for m in means], hashes[0], tall)
        if self.means.exists():
            rows, cols, data = self.means.get()
            walk.mask.before = np.frombuffer(data, np.float32).reshape(rows, cols, 3)
            walk.mask.changes.extend(np.unpackbits(np.frombuffer(bits, np.uint8), count=rows * cols).astype(bool).reshape(rows, cols) for (bits,) in self.changes.get())
        return walk, pos, count

    def _keep(self, walk: Walk, pos: int, count: int, new_keyframe: bool) -> None:
        self.place.update((pos, walk.kept, count))
        if new_keyframe:
            f = walk.fold.last
            self.keyframe.update((f.pixels.shape[0], f.pixels.shape[1], f.pixels.tobytes(), f.hashes, f.means, f.tall))
        if walk.mask.before is not None:
            self.means.update((*walk.mask.before.shape[:2], walk.mask.before.astype(np.float32).tobytes()))
            bits = [(np.packbits(c).tobytes(),) for c in walk.mask.changes]
            self.changes.put(bits) if bits else self.changes.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        walk, last, count = self._walk()
        batch = pd.concat(list(rows)).sort_values("seq_pos", kind="stable", na_position="first")
        began, newest = count, batch["event_time"].max()
        for r in batch.itertuples(index=False):
            meta = {c: None if pd.isna(v := getattr(r, c)) else v for c in META}
            out = dict.fromkeys(OUT.names) | meta | {"seq_id": key[0], "seq_pos": None if pd.isna(r.seq_pos) else int(r.seq_pos), "is_keyframe": False, "late": False, "bad": r.bad}
            if pd.isna(r.bad):
                out["bad"] = None
                if last is not None and r.seq_pos <= last:
                    out["late"] = True
                else:
                    try:
                        frame = pictures.decode(r.picture)
                    except pictures.BadPicture as e:
                        out["bad"] = str(e)
                    else:
                        last = int(r.seq_pos)
                        out |= walk.step(frame, meta["frame_id"]) | {"frame_height": frame.shape[0], "frame_width": frame.shape[1]}
                        if out["is_keyframe"]:
                            count += 1
                            out |= {"keyframe_index": count, "frame": {"height": frame.shape[0], "width": frame.shape[1], "data": frame.tobytes()}}
            yield pd.DataFrame({c: pd.Series([out[c]], dtype=object) for c in OUT.names})
        if last is not None:
            self._keep(walk, last, count, count > began)
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(int(newest.timestamp() * 1000) + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.place, self.keyframe, self.means, self.changes):
            state.clear()
        yield from ()

    def close(self) -> None:
        pass


def fold_messages(lines: DataFrame, settings: Settings | None = None, delay: str = "1 day", idle_s: int = 7 * 86_400) -> DataFrame:
    """OUT rows of a stream of lines: decisions, flags, and the pixels of keyframes alone. The session's state store must be RocksDB; see
    start()."""
    rows = parse(lines).drop("value").withWatermark("event_time", delay)
    return rows.groupBy("seq_id").transformWithStateInPandas(FrameFold(settings or Settings(), idle_s * 1000), OUT, "Append", "EventTime")
