"""Pixel kernels in numpy. A frame is an (H, W, 3) uint8 RGB array; none of these keeps state."""

from __future__ import annotations

import functools
import struct
import zlib

import numpy as np


def to_rgb(a: np.ndarray) -> np.ndarray:
    """Any gray, 1-, 3- or 4-channel array as RGB uint8; alpha is dropped, floats in 0..1 are scaled, wider integers wrap."""
    a = np.asarray(a)
    if a.dtype != np.uint8:
        a = (a * 255).clip(0, 255).astype(np.uint8) if np.issubdtype(a.dtype, np.floating) else a.astype(np.uint8)
    if a.ndim == 2:
        return np.repeat(a[:, :, None], 3, axis=2)
    if a.ndim != 3:
        raise ValueError(f"Expected 2D or 3D array, got {a.ndim}D")
    channels = a.shape[2]
    if channels == 1:
        return np.repeat(a, 3, axis=2)
    if channels in (3, 4):
        return a[:, :, :3]
    raise ValueError(f"Expected 1, 3, or 4 channels, got {channels}")


def from_bytes(data: bytes, height: int, width: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, 3)


def grid(height: int, width: int, block: int) -> tuple[int, int]:
    return height // block, width // block


def _blocks(a: np.ndarray, block: int) -> np.ndarray:
    rows, cols = grid(*a.shape[:2], block)
    return a[: rows * block, : cols * block].reshape(rows, block, cols, block, 3)


def block_means(frame: np.ndarray, block: int) -> np.ndarray:
    """float32 (rows, cols, 3)."""
    rows, cols = grid(*frame.shape[:2], block)
    lines = frame[: rows * block, : cols * block].reshape(rows, block, cols * block * 3).sum(axis=1, dtype=np.uint32)
    return (lines.reshape(rows, cols, block, 3).sum(axis=2, dtype=np.uint64) / (block * block)).astype(np.float32)


def regions_of(flags: np.ndarray, block: int) -> list[tuple[int, int, int, int]]:
    """x, y, w, h of the set blocks, row by row."""
    return [(int(c) * block, int(r) * block, block, block) for r, c in np.argwhere(flags)]


def block_diff(a: np.ndarray, b: np.ndarray, block: int, threshold: float = 10.0) -> np.ndarray:
    """Which blocks differ by more than threshold on the mean of pixels and channels."""
    diff = _blocks(np.abs(a.astype(np.int16) - b), block)
    total = diff.sum(axis=(3, 4), dtype=np.int32).sum(axis=1, dtype=np.int64)
    return (total / (3 * block * block)).astype(np.float32) > threshold


def blank(frame: np.ndarray, regions: list[tuple[int, int, int, int]]) -> np.ndarray:
    """A copy with the regions black, as far as they lie in the frame."""
    out = frame.copy()
    h, w = frame.shape[:2]
    for x, y, rw, rh in regions:
        out[max(0, y) : max(0, min(h, y + rh)), max(0, x) : max(0, min(w, x + rw))] = 0
    return out


def crop(frame: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    return frame[max(0, y) : max(0, min(frame.shape[0], y + h)), max(0, x) : max(0, min(frame.shape[1], x + w))]


# Luma weights of the comparator, and of the hash in 16-bit fixed point.
GRAY = (0.2989, 0.5870, 0.1140)
LUMA = (19595, 38470, 7471)
RESAMPLE_BITS = 22


#: Rows of a frame that are worked on at a time, so that they stay in the processor's cache.
STRIP = 64


def gray(frame: np.ndarray) -> np.ndarray:
    out = np.empty(frame.shape[:2], np.uint8)
    for y in range(0, len(out), STRIP):
        r, g, b = (frame[y : y + STRIP, :, i] * w for i, w in enumerate(GRAY))
        out[y : y + STRIP] = r + g + b
    return out


def luma(frame: np.ndarray) -> np.ndarray:
    f = frame.astype(np.int32)
    return ((LUMA[0] * f[..., 0] + LUMA[1] * f[..., 1] + LUMA[2] * f[..., 2] + 32768) >> 16).astype(np.uint8)


@functools.lru_cache(maxsize=64)
def _lanczos(size: int, out: int) -> np.ndarray:
    """(out, size) resampling weights with three lobes, in fixed point; float64 holds the products exactly."""
    scale = size / out
    stretch = max(scale, 1.0)
    w = np.zeros((out, size))
    for i in range(out):
        center = (i + 0.5) * scale
        lo, hi = max(0, int(center - 3 * stretch + 0.5)), min(size, int(center + 3 * stretch + 0.5))
        t = (np.arange(lo, hi) - center + 0.5) / stretch
        k = np.where(np.abs(t) < 3, np.sinc(t) * np.sinc(t / 3), 0.0)
        k = k / k.sum() * (1 << RESAMPLE_BITS)
        w[i, lo:hi] = np.trunc(k + np.where(k < 0, -0.5, 0.5))
    return w


def resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """uint8 gray, columns first, rounded to uint8 between the passes."""
    for axis, size in ((1, width), (0, height)):
        if a.shape[axis] != size:
            w = _lanczos(a.shape[axis], size)
            s = a.astype(np.float64) @ w.T if axis else w @ a.astype(np.float64)
            a = np.clip(np.floor((s + (1 << (RESAMPLE_BITS - 1))) / (1 << RESAMPLE_BITS)), 0, 255).astype(np.uint8)
    return a


def _top(frame: np.ndarray, side: int, rows: int) -> np.ndarray:
    """The first rows of the frame's luma at side x side; only the part of the frame that they depend on is looked at."""
    h = frame.shape[0]
    if h == side:
        return resize(luma(frame[:rows]), rows, side)
    need = min(h, int((rows - 0.5) * h / side + 3 * max(h / side, 1.0) + 0.5))
    a = resize(luma(frame[:need]), need, side)
    s = _lanczos(h, side)[:rows, :need] @ a.astype(np.float64)
    return np.clip(np.floor((s + (1 << (RESAMPLE_BITS - 1))) / (1 << RESAMPLE_BITS)), 0, 255).astype(np.uint8)


def phash(frame: np.ndarray, size: int = 8) -> str:
    """Hex of size x size bits: row-wise cosine coefficients 1..size of the top rows, against their mean."""
    side = 4 * size
    px = _top(frame, side, size).astype(np.float64)
    k, x = np.arange(1, size + 1), np.arange(side)
    d = px @ (2 * np.cos(np.pi * k[:, None] * (x + 0.5) / side)).T
    d = np.round(d, 6) + 0.0
    bits = (d > d.mean()).ravel()
    return f"{int(''.join('01'[int(b)] for b in bits), 2):0{-(-size * size // 4)}x}"


def tiles(height: int, tile: int) -> list[tuple[int, int]]:
    return [(i * tile, min(height, (i + 1) * tile)) for i in range(max(1, -(-height // tile)))]


def phash_tiles(frame: np.ndarray, tile: int, size: int = 8) -> list[str]:
    return [phash(frame[a:b], size) for a, b in tiles(frame.shape[0], tile)]


def hamming(a: str, b: str) -> int:
    return (int(a, 16) ^ int(b, 16)).bit_count()


def channel_means(frame: np.ndarray) -> list[float]:
    h, w = frame.shape[:2]
    return [float(v) / (h * w) for v in frame.reshape(h, w * 3).sum(axis=0, dtype=np.int64).reshape(w, 3).sum(axis=0)]


def _window_sums(v: np.ndarray, window: int) -> np.ndarray:
    """Sums over all window x window squares, by doubling along each side; exact in int32 for squares of bytes."""
    for axis in (1, 0):
        v = np.moveaxis(v, axis, 0)
        total, done, power, size = None, 0, v, 1
        while True:
            if window & size:
                part = power[done : len(power) - (window - size - done)] if window - size - done else power[done:]
                total = part if total is None else total[: len(part)] + part
                done += size
            if done == window:
                break
            power, size = power[:-size] + power[size:], 2 * size
        v = np.moveaxis(total, 0, axis)
    return v


def ssim(a: np.ndarray, b: np.ndarray, window: int = 7) -> float:
    """Mean structural similarity of two uint8 gray images: uniform windows, sample covariance. Sums are whole numbers; numerator and
    denominator are both multiplied by the windows' sizes."""
    if min(a.shape) < window:
        raise ValueError(f"a side is shorter than the window of {window}")
    n = window * window
    k1, k2 = (0.01 * 255) ** 2 * n * n, (0.03 * 255) ** 2 * n * (n - 1)
    total, high = 0.0, a.shape[0] - window + 1
    for y in range(0, high, STRIP):
        p, q = (x[y : y + STRIP + window - 1].astype(np.int32) for x in (a, b))
        sp, sq = _window_sums(p, window), _window_sums(q, window)
        both, squares = sp * sq, sp * sp + sq * sq
        cov = 2 * (n * _window_sums(p * q, window) - both) + k2
        spread = n * _window_sums(p * p + q * q, window) - squares + k2
        total += float((((2 * both + k1) * cov) / ((squares + k1) * spread)).sum())
    return total / (high * (a.shape[1] - window + 1))


def compare(current: np.ndarray, reference: np.ndarray, block: int, grays: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[float, float, float, list[tuple[int, int, int, int]]]:
    """ssim, change score, percent of blocks changed, changed regions. grays: of both, where they are known."""
    now, before = grays or (gray(current), gray(reference))
    s = ssim(before, now)
    flags = block_diff(current, reference, block)
    return s, 1.0 - s, flags.sum() / max(flags.size, 1) * 100.0, regions_of(flags, block)


def png(frame: np.ndarray) -> bytes:
    h, w = frame.shape[:2]

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = np.concatenate([np.zeros((h, 1), np.uint8), frame.reshape(h, w * 3)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")
