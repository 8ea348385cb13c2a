"""The keyframe cascade: an ordered fold of each sequence against its last keyframe.

The fold reads the rows of a partition in order, in a stream of small Arrow batches, and holds one keyframe and the mask's state, so
memory doesn't grow with a sequence, and pixels are dealt and sorted once. A frame is kept if it is the first, has another size, or
fails the hash gate and then differs enough; the keyframe moves on keyframes only, the mask on every frame. See split_fold for
sequences that are too long for a task.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..config import Settings
from ..functions import columns as C
from ..functions import imaging
from ..schema import FRAME, KEYFRAME, MANIFEST, REGIONS, SKIPPED
from .masking import RunningMask, adaptive_mask

MEAN_GATE = 5.0
FIRST = "First frame in sequence"
SAME = "Hash match — visually identical to previous keyframe"


@dataclass
class Features:
    """What the fold needs of one masked frame."""

    pixels: np.ndarray
    hashes: list[str]
    means: list[list[float]]
    hash: str
    tall: bool

    @classmethod
    def of(cls, pixels: np.ndarray, s: Settings) -> Features:
        h, w = pixels.shape[:2]
        whole = [imaging.channel_means(pixels)]
        if h > w * s.hasher.tile_aspect_ratio:
            hashes = imaging.phash_tiles(pixels, w, s.hasher.hash_size)
            return cls(pixels, hashes, whole + [imaging.channel_means(pixels[a:b]) for a, b in imaging.tiles(h, w)], hashes[0], True)
        one = imaging.phash(pixels, s.hasher.hash_size)
        return cls(pixels, [one], whole, one, False)

    @functools.cached_property
    def gray(self) -> np.ndarray:
        return imaging.gray(self.pixels)

    def same(self, other: Features) -> bool:
        """The hash gate: equal hashes, and channel means (of tiles, if tall) that hardly differ."""
        if self.hashes != other.hashes:
            return False
        a, b = (x.means[1:] if x.tall else x.means for x in (self, other))
        return max(abs(p - q) for x, y in zip(a, b, strict=True) for p, q in zip(x, y, strict=True)) < MEAN_GATE


@dataclass
class Decision:
    keyframe: bool
    reason: str
    hash: str
    ssim: float | None = None
    change: float | None = None
    pct: float | None = None
    regions: list = field(default_factory=list)


@dataclass
class Fold:
    """One sequence's state."""

    settings: Settings
    last: Features | None = None

    def step(self, frame: np.ndarray, mask: list) -> Decision:
        s = self.settings
        now = Features.of(imaging.blank(frame, mask) if mask else frame, s)
        d = self._decide(now, s)
        if d.keyframe:
            if now.pixels.base is not None:
                now.pixels = now.pixels.copy()  # a view would keep its whole batch
            self.last = now
        return d

    def _decide(self, now: Features, s: Settings) -> Decision:
        if self.last is None:
            return Decision(True, FIRST, now.hash)
        (h, w), (ph, pw) = now.pixels.shape[:2], self.last.pixels.shape[:2]
        if (h, w) != (ph, pw):
            return Decision(True, f"Dimension change ({pw}x{ph} -> {w}x{h})", now.hash)
        if now.same(self.last):
            return Decision(False, SAME, now.hash)
        c = s.comparator
        ssim, change, pct, regions = imaging.compare(now.pixels, self.last.pixels, s.masking.block_size, (now.gray, self.last.gray))
        n = len(regions)
        if ssim <= c.ssim_threshold:
            why = f"Significant change — SSIM {ssim:.4f}, {pct:.1f}% of blocks changed"
        elif n > c.min_changed_blocks:
            why = f"Localized change — SSIM {ssim:.4f} above threshold but {n} blocks changed (>{c.min_changed_blocks})"
        else:
            why = f"Minor change — SSIM {ssim:.4f} above threshold {c.ssim_threshold}, {n} blocks changed (≤{c.min_changed_blocks})"
        return Decision(ssim <= c.ssim_threshold or n > c.min_changed_blocks, why, now.hash, ssim, change, pct, regions)


class Walk:
    """One sequence in order: its mask, its fold, and the id of its last keyframe."""

    def __init__(self, s: Settings):
        self.block = s.masking.block_size
        self.mask = RunningMask(self.block, s.masking.window_size, s.masking.noise_threshold)
        self.fold = Fold(s)
        self.kept: str | None = None

    def step(self, frame: np.ndarray, frame_id: str | None, means: np.ndarray | None = None) -> dict:
        """The frame's row of DECISION."""
        masked = self.mask.step_means(imaging.block_means(frame, self.block) if means is None else means)
        d = self.fold.step(frame, masked)
        out = {
            "adaptive_mask": named(masked), "is_keyframe": d.keyframe, "visual_reason": d.reason, "perceptual_hash": d.hash, "ssim_score": d.ssim, "change_score": d.change,
            "changed_pct": d.pct, "changed_regions": named(d.regions), "prev_keyframe_id": self.kept,
        }
        if d.keyframe:
            self.kept = frame_id
        return out


def named(regions: list) -> list[dict[str, int]] | None:
    return [dict(zip("xywh", r, strict=True)) for r in regions] or None


DECISION = T.StructType(
    [T.StructField("adaptive_mask", REGIONS), T.StructField("is_keyframe", T.BooleanType()), T.StructField("visual_reason", T.StringType()), T.StructField("perceptual_hash", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ("ssim_score", "change_score", "changed_pct")]
    + [T.StructField("changed_regions", REGIONS), T.StructField("prev_keyframe_id", T.StringType())]
)


def pixels_of(b: pa.RecordBatch, column: str = "frame") -> Iterator[np.ndarray | None]:
    """The frames of a batch, as views of it; None for null ones."""
    frames = b.column(column)
    height, width, data = (frames.field(c) for c in ("height", "width", "data"))
    for i in range(b.num_rows):
        yield imaging.from_bytes(data[i].as_buffer(), height[i].as_py(), width[i].as_py()) if frames[i].is_valid else None


def decide(frames: DataFrame, settings: Settings, keep: list[str]) -> DataFrame:
    """frames (seq_id, seq_pos, frame_id, frame, columns kept) with mask and decision; rows of a sequence meet in one task, in order."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, walk = object(), None
        for b in it:
            out = []
            for s, name, frame in zip(b.column("seq_id").to_pylist(), b.column("frame_id").to_pylist(), pixels_of(b), strict=True):
                if s != seq:
                    seq, walk = s, Walk(settings)
                out.append(walk.step(frame, name))
            yield pa.RecordBatch.from_pydict({c: b.column(c) for c in keep} | {f.name: pa.array([r[f.name] for r in out], f.type) for f in decision})

    schema = T.StructType([frames.schema[c] for c in keep] + DECISION.fields)
    decision = to_arrow_schema(DECISION)
    ordered = frames.select(*dict.fromkeys([*keep, "seq_id", "seq_pos", "frame_id", "frame"])).repartition("seq_id").sortWithinPartitions("seq_id", "seq_pos")
    return ordered.mapInArrow(run, schema)


def with_masks(frames: DataFrame, settings: Settings) -> DataFrame:
    m = settings.masking
    flat = frames.withColumn("means", C.block_means(F.col("frame"), m.block_size)).withColumn("height", F.col("frame.height")).withColumn("width", F.col("frame.width"))
    return adaptive_mask(flat, m.block_size, m.window_size, m.noise_threshold).drop("means")


def apply_masks(df: DataFrame, *keep: str) -> DataFrame:
    """(columns kept, frame) with the blocks of adaptive_mask black."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for f, m in zip(b.column("frame").to_pylist(), b.column("adaptive_mask").to_pylist(), strict=True):
                a = imaging.blank(imaging.from_bytes(f["data"], f["height"], f["width"]), [tuple(r.values()) for r in m or []])
                out.append(f | {"data": a.tobytes()})
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(out, b.schema.field("frame").type)], [*keep, "frame"])

    rows = df.select(*keep, "frame", "adaptive_mask")
    return rows.mapInArrow(run, T.StructType([rows.schema[c] for c in keep] + [T.StructField("frame", FRAME)]))


def prev_keyframes(df: DataFrame, seq: str = "seq_id", pos: str = "seq_pos") -> DataFrame:
    """df with the id and path of the last keyframe before each row."""
    w = Window.partitionBy(seq).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c: F.last(F.when(F.col("is_keyframe"), F.col(c)), ignorenulls=True).over(w)
    return df.withColumn("prev_keyframe_id", last("frame_id")).withColumn("prev_keyframe_path", last("asset_path"))


def cascade(frames: DataFrame, settings: Settings | None = None, split: int = 0) -> DataFrame:
    """Manifest rows of frames (seq_id, seq_pos, frame and, where given, frame_id, timestamp, app_name, window_title, source_format),
    with seq_id and seq_pos before the 30 columns. Pictures aren't read, written or redacted here. split: frames are dealt over
    so many tasks, however long a sequence is, with the same result."""
    s = settings or Settings()
    given = {"frame_id": F.format_string("frame_%06d", "seq_pos"), "timestamp": F.lit(None), "app_name": F.lit(None), "window_title": F.lit(None), "source_format": F.lit(None)}
    for name, default in given.items():
        frames = frames.withColumn(name, (F.col(name) if name in frames.columns else default).cast(MANIFEST[name].dataType))
    frames = frames.withColumn("frame_height", F.col("frame.height")).withColumn("frame_width", F.col("frame.width"))
    keep = ["seq_id", "seq_pos", *given, "frame_height", "frame_width"]
    if split:
        from .split_fold import decide_split

        out = decide_split(frames, s, keep, split)
    else:
        out = decide(frames, s, keep)
    path = lambda c: F.concat(F.lit(s.exporter.output_dir.rstrip("/") + "/"), F.col(c), F.lit(f".{s.exporter.keyframe_format}"))
    out = out.withColumn("event_type", F.when(F.col("is_keyframe"), KEYFRAME).otherwise(SKIPPED)).withColumn("asset_path", F.when(F.col("is_keyframe"), path("frame_id")))
    return to_manifest(out.withColumn("prev_keyframe_path", path("prev_keyframe_id")), "seq_id", "seq_pos")


def to_manifest(df: DataFrame, *extra: str) -> DataFrame:
    """The 30 columns in their order, null where df lacks one, after the extra ones."""
    return df.select(*extra, *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in MANIFEST])


def scalar_keyframes(df: DataFrame, seq: str, order: list[str], value: str, least: float) -> DataFrame:
    """df with is_keyframe and ref_value, of the fold that keeps a row whose value differs by `least` or more from the last kept one.
    Null values are never kept and compare with nothing."""
    schema = T.StructType([*df.schema.fields, T.StructField("is_keyframe", T.BooleanType()), T.StructField("ref_value", T.DoubleType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = object(), None
        for b in it:
            flags, refs = [], []
            for k, v in zip(b.column(seq).to_pylist(), b.column(value).to_pylist(), strict=True):
                if k != key:
                    key, last = k, None
                hit = v is not None and (last is None or abs(v - last) >= least)
                flags.append(hit)
                refs.append(last)
                last = v if hit else last
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(flags, pa.bool_()), pa.array(refs, pa.float64())], schema.names)

    return df.repartition(seq).sortWithinPartitions(seq, *order).mapInArrow(run, schema)
