"""Frame functions on columns: Arrow-batched where pixels are read, native expressions everywhere else."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import FRAME, REGIONS
from . import imaging


def _frame(r) -> imaging.np.ndarray:
    return imaging.from_bytes(r["data"], r["height"], r["width"])


def _rows(f: pd.DataFrame):
    return (imaging.from_bytes(d, h, w) for h, w, d in zip(f["height"], f["width"], f["data"], strict=True))


def phash(frame: Column, size: int = 8) -> Column:
    @F.pandas_udf(T.StringType())
    def phash_(f: pd.DataFrame) -> pd.Series:
        return pd.Series([imaging.phash(a, size) for a in _rows(f)])

    return phash_(frame)


def phash_tiles(frame: Column, tile: int | None = None, size: int = 8) -> Column:
    """tile None: as high as the frame is wide."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def phash_tiles_(f: pd.DataFrame) -> pd.Series:
        return pd.Series([imaging.phash_tiles(a, tile or a.shape[1], size) for a in _rows(f)])

    return phash_tiles_(frame)


def channel_means(frame: Column) -> Column:
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def channel_means_(f: pd.DataFrame) -> pd.Series:
        return pd.Series([imaging.channel_means(a) for a in _rows(f)])

    return channel_means_(frame)


def block_means(frame: Column, block: int) -> Column:
    """Flat array<float>, row by row, three channels each."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def block_means_(f: pd.DataFrame) -> pd.Series:
        return pd.Series([imaging.block_means(a, block).ravel() for a in _rows(f)])

    return block_means_(frame)


def block_diff(a: Column, b: Column, block: int) -> Column:
    @F.pandas_udf(REGIONS)
    def block_diff_(x: pd.DataFrame, y: pd.DataFrame) -> pd.Series:
        return pd.Series([_named(imaging.regions_of(imaging.block_diff(p, q, block), block)) for p, q in zip(_rows(x), _rows(y), strict=True)])

    return block_diff_(a, b)


def _named(regions) -> list[dict[str, int]]:
    return [dict(zip("xywh", r, strict=True)) for r in regions]


COMPARISON = T.StructType([T.StructField(c, T.DoubleType()) for c in ("ssim_score", "change_score", "changed_pct")] + [T.StructField("changed_regions", REGIONS)])


def compare(current: Column, reference: Column, block: int) -> Column:
    @F.pandas_udf(COMPARISON)
    def compare_(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        got = [imaging.compare(p, q, block) for p, q in zip(_rows(x), _rows(y), strict=True)]
        return pd.DataFrame({"ssim_score": [g[0] for g in got], "change_score": [g[1] for g in got], "changed_pct": [g[2] for g in got], "changed_regions": [_named(g[3]) for g in got]})

    return compare_(current, reference)


def ssim(a: Column, b: Column) -> Column:
    @F.pandas_udf(T.DoubleType())
    def ssim_(x: pd.DataFrame, y: pd.DataFrame) -> pd.Series:
        return pd.Series([imaging.ssim(imaging.gray(p), imaging.gray(q)) for p, q in zip(_rows(x), _rows(y), strict=True)], dtype=float)

    return ssim_(a, b)


def blank(frame: Column, regions: Column) -> Column:
    """The frame with regions black."""

    @F.pandas_udf(FRAME)
    def blank_(f: pd.DataFrame, r: pd.Series) -> pd.DataFrame:
        out = f.copy()
        out["data"] = [imaging.blank(a, [(x["x"], x["y"], x["w"], x["h"]) for x in (g if g is not None else [])]).tobytes() for a, g in zip(_rows(f), r, strict=True)]
        return out

    return blank_(frame, regions)


def png(frame: Column) -> Column:
    @F.pandas_udf(T.BinaryType())
    def png_(f: pd.DataFrame) -> pd.Series:
        return pd.Series([imaging.png(a) for a in _rows(f)])

    return png_(frame)


def gray_frame(pixels: Column, height: int, width: int) -> Column:
    """FRAME of an array of gray values 0..255, without leaving the JVM."""
    h = F.array_join(F.transform(pixels, lambda p: F.repeat(F.lpad(F.hex(p.cast("int")), 2, "0"), 3)), "")
    return F.struct(F.lit(height).alias("height"), F.lit(width).alias("width"), F.unhex(h).alias("data"))


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ in two hashes of up to 64 bits."""
    return F.bit_count(F.conv(a, 16, -10).cast("long").bitwiseXOR(F.conv(b, 16, -10).cast("long")))


def hash_match(a: Column, b: Column, tolerance: int = 0) -> Column:
    return a == b if tolerance == 0 else hamming(a, b) <= tolerance


def tiles_match(a: Column, b: Column, tolerance: int = 0) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: F.coalesce(hash_match(x, y, tolerance), F.lit(False)))
    return (F.size(a) == F.size(b)) & F.forall(pairs, lambda x: x)


def mean_diff(a: Column, b: Column) -> Column:
    """Greatest difference between channel means."""
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def is_tall(height: Column, width: Column, ratio: float = 1.5) -> Column:
    return height > width * ratio


def area(region: Column) -> Column:
    return region["w"] * region["h"]


def clamp(region: Column, height: Column, width: Column) -> Column:
    """The part of a region that lies in a frame; width or height 0 where none does."""
    x1, y1 = F.greatest(region["x"], F.lit(0)), F.greatest(region["y"], F.lit(0))
    x2, y2 = F.least(region["x"] + region["w"], width), F.least(region["y"] + region["h"], height)
    return F.struct(x1.alias("x"), y1.alias("y"), F.greatest(x2 - x1, F.lit(0)).alias("w"), F.greatest(y2 - y1, F.lit(0)).alias("h"))


def box_of_quad(quad: Column) -> Column:
    """Region around four corner points, array<array<double>>."""
    xs, ys = F.transform(quad, lambda p: p[0]), F.transform(quad, lambda p: p[1])
    x, y = F.array_min(xs).cast("int"), F.array_min(ys).cast("int")
    return F.struct(x.alias("x"), y.alias("y"), (F.array_max(xs).cast("int") - x).alias("w"), (F.array_max(ys).cast("int") - y).alias("h"))


def change_magnitude(ssim_score: Column, changed: Column) -> Column:
    n = F.coalesce(F.size(changed), F.lit(0)) if not isinstance(changed, int) else F.lit(changed)
    return magnitude_of(ssim_score, F.when(changed.isNull(), 0).otherwise(n))


def magnitude_of(ssim_score: Column, n: Column) -> Column:
    return (
        F.when(ssim_score.isNull(), "major").when((ssim_score < 0.70) | (n > 15), "major").when((ssim_score < 0.90) | (n > 5), "moderate").otherwise("minor")
    )


def is_keyframe(ssim_score: Column, n_blocks: Column, threshold: float, min_blocks: int) -> Column:
    return (ssim_score <= threshold) | (n_blocks > min_blocks)
