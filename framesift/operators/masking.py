"""Adaptive noise mask: blocks that change in most of the last frames, by window functions.

A block's change is its mean difference to the frame before; a block is noisy where the share of changes over the last frames is above
a threshold and there are two changes to judge by. A new grid shape starts a new history; frames too small for a grid neither have
a mask nor count. Only raw frames are looked at, so this runs ahead of the fold and needs no state of it.
"""

from __future__ import annotations

import pickle
from collections import deque

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import imaging
from ..schema import REGIONS

BLOCK_CHANGE = 5.0


def segments(df: DataFrame, height: str = "height", width: str = "width", block: int = 32, seq: str = "seq_id", pos: str = "seq_pos") -> DataFrame:
    """df with rows_, cols_ (grid) and segment: the number of changes of the grid's shape so far; null for frames without a grid."""
    df = df.withColumn("rows_", F.floor(F.col(height) / block).cast("int")).withColumn("cols_", F.floor(F.col(width) / block).cast("int"))
    shape = F.when(F.col("rows_") * F.col("cols_") > 0, F.struct("rows_", "cols_"))
    w = Window.partitionBy(seq).orderBy(pos)
    before = F.last(shape, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(shape.isNotNull() & before.isNotNull() & (shape != before), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("segment", F.when(shape.isNotNull(), F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_new")


def block_changes(means: Column, before: Column, threshold: float = BLOCK_CHANGE) -> Column:
    """array<int>, 1 where the mean over three channels of the difference is above threshold; single precision as the means.

    means and before are plain columns, so that each block's values are looked up and nothing is built anew for each block."""
    diff = lambda i: F.abs(F.get(means, i) - F.get(before, i))
    n = F.floor(F.least(F.size(means), F.size(before)) / 3).cast("int")
    mean = lambda i: ((diff(3 * i) + diff(3 * i + 1) + diff(3 * i + 2)) / 3).cast("float")
    return F.when(before.isNotNull() & (n > 0), F.transform(F.sequence(F.lit(0), n - 1), lambda i: (mean(i) > threshold).cast("int")))


def noisy_regions(changes: Column, cols: Column, block: int, threshold: float) -> Column:
    """Regions of the blocks whose share of changes, over array<array<int>>, is above threshold; null for none."""
    count = F.size(changes)
    n = F.size(F.element_at(changes, 1))
    share = lambda i: F.aggregate(changes, F.lit(0), lambda acc, c: acc + F.get(c, i)) / count
    region = lambda i: F.struct((i % cols * block).cast("int").alias("x"), (F.floor(i / cols) * block).cast("int").alias("y"), F.lit(block).alias("w"), F.lit(block).alias("h"))
    found = F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda i: share(i) > threshold), region)
    return F.when((count >= 2) & (F.size(found) > 0), found).cast(REGIONS)


def adaptive_mask(df: DataFrame, block: int = 32, window: int = 15, threshold: float = 0.8, seq: str = "seq_id", pos: str = "seq_pos") -> DataFrame:
    """df (height, width, means: flat block means) with segment and adaptive_mask, in one shuffle by sequence."""
    df = segments(df, block=block, seq=seq, pos=pos)
    w = Window.partitionBy(seq, "segment").orderBy(pos)
    df = df.withColumn("_before", F.lag("means").over(w))
    df = df.withColumn("_changes", F.when(F.col("segment").isNotNull(), block_changes(F.col("means"), F.col("_before")))).drop("_before")
    recent = F.collect_list("_changes").over(w.rowsBetween(1 - window, 0))
    mask = F.when(F.col("segment").isNotNull(), noisy_regions(F.col("_recent"), F.col("cols_"), block, threshold))
    return df.withColumn("_recent", recent).withColumn("adaptive_mask", mask).drop("_recent", "_changes", "rows_", "cols_")


class RunningMask:
    """The same mask of one sequence, frame by frame: the last frame's block means and the last changes are its state."""

    def __init__(self, block: int, window: int, threshold: float):
        self.block, self.threshold = block, threshold
        self.before: np.ndarray | None = None
        self.changes: deque = deque(maxlen=window)

    def step(self, frame: np.ndarray) -> list[tuple[int, int, int, int]]:
        return self.step_means(imaging.block_means(frame, self.block))

    def step_means(self, means: np.ndarray) -> list[tuple[int, int, int, int]]:
        if not means.size:
            return []
        if self.before is not None and self.before.shape != means.shape:
            self.before = None
            self.changes.clear()
        if self.before is not None:
            self.changes.append(np.abs(means - self.before).mean(axis=2) > BLOCK_CHANGE)
        self.before = means
        if len(self.changes) < 2:
            return []
        return imaging.regions_of(np.mean(self.changes, axis=0) > self.threshold, self.block)

    def same(self, other: RunningMask) -> bool:
        """Both will mask all later frames alike."""
        if self.before is None or other.before is None:
            return self.before is other.before
        return len(self.changes) == len(other.changes) and np.array_equal(self.before, other.before) and all(map(np.array_equal, self.changes, other.changes))

    def dump(self) -> bytes:
        return pickle.dumps((self.before, list(self.changes)))

    def load(self, data: bytes) -> RunningMask:
        self.before, changes = pickle.loads(data)
        self.changes.extend(changes)
        return self
