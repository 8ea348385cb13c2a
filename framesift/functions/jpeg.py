"""JPEG pictures by numpy: baseline, colours at full resolution, Huffman tables made for the picture."""

from __future__ import annotations

import heapq
import struct

import numpy as np

# Quantisation of luminance and chrominance by the standard's annex K, row by row.
LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMINANCE = (17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99, *(99,) * 32)
# From RGB to luminance and colour differences.
YCC = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]], np.float32)

_k, _x = np.mgrid[0:8, 0:8]
DCT = (np.cos((2 * _x + 1) * _k * np.pi / 16) * np.where(_k == 0, np.sqrt(1 / 8), 0.5)).astype(np.float32)
#: Places of a block by diagonals, each the other way round than the last.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))


def quantisation(base: tuple[int, ...], quality: int) -> np.ndarray:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(base) * scale + 50) // 100, 1, 255)


def code_lengths(counts: np.ndarray) -> dict[int, int]:
    """Symbol to length, at most 16; the code of ones alone stays free."""
    heap = [(int(n), s, [s]) for s, n in enumerate(counts) if n]
    length = dict.fromkeys((s for _, s, _ in heap), 0)
    heap.append((0, 256, [256]))  # takes the code of ones
    length[256] = 0
    heapq.heapify(heap)
    while len(heap) > 1:
        (m, _, a), (n, k, b) = heapq.heappop(heap), heapq.heappop(heap)
        for s in a + b:
            length[s] += 1
        heapq.heappush(heap, (m + n, k, a + b))
    per = np.bincount(list(length.values()), minlength=64)
    for i in range(len(per) - 1, 16, -1):
        while per[i]:  # two of the longest become one of its parent's length; a shorter one gets a sibling
            j = i - 2
            while not per[j]:
                j -= 1
            per[i] -= 2
            per[i - 1] += 1
            per[j + 1] += 2
            per[j] -= 1
    order = sorted(length, key=lambda s: (length[s], s == 256, s))
    flat = [i for i, n in enumerate(per) for _ in range(n)]
    return {s: n for s, n in zip(order, flat, strict=True) if s != 256}


def codes(length: dict[int, int]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Codes and lengths by symbol, and the table's segment."""
    order = sorted(length, key=lambda s: (length[s], s))
    value, last = 0, 0
    code, size = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s in order:
        value <<= length[s] - last
        last = length[s]
        code[s], size[s] = value, last
        value += 1
    counts = bytes(sum(n == k for n in length.values()) for k in range(1, 17))
    return code, size, counts + bytes(order)


def _bits(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of bits of whole numbers, and the bits: of negative ones the complement."""
    n = np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)
    return n, np.where(v < 0, v + (1 << n) - 1, v)


def jpeg(frame: np.ndarray, quality: int = 95) -> bytes:
    h, w = frame.shape[:2]
    padded = np.pad(frame, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge").astype(np.float32)
    ycc = padded @ YCC.T
    ycc[..., 0] -= 128
    tables = [quantisation(t, quality) for t in (LUMINANCE, CHROMINANCE)]
    blocks = ycc.reshape(padded.shape[0] // 8, 8, padded.shape[1] // 8, 8, 3).transpose(0, 2, 4, 1, 3)  # rows, columns, component, 8, 8
    c = (DCT @ blocks @ DCT.T).reshape(-1, 3, 64)
    c = np.rint(c / np.stack([tables[0], tables[1], tables[1]]).astype(np.float32)).astype(np.int64)[:, :, ZIGZAG]
    first = c[:, :, 0].copy()
    c[:, :, 0] = np.diff(first, axis=0, prepend=0)
    c = c.reshape(-1, 64)
    n = len(c)
    chroma = (np.arange(n) % 3 > 0).astype(np.int64)

    b, k = np.nonzero(c[:, 1:])
    k += 1
    fresh = np.diff(b, prepend=-1) > 0
    run = k - np.where(fresh, 0, np.concatenate([[0], k[:-1]])) - 1
    size, value = _bits(c[b, k])
    long = np.repeat(np.arange(len(b)), run // 16)
    nth = np.arange(len(long)) - np.repeat(np.cumsum(run // 16) - run // 16, run // 16)
    last = np.zeros(n, np.int64)
    np.maximum.at(last, b, k)
    short = np.nonzero(last < 63)[0]
    dc_size, dc_value = _bits(c[:, 0])
    zero = lambda x: np.zeros(len(x), np.int64)
    # tokens: differences of means, runs of sixteen zeros, coefficients, ends of blocks; in the order of block and place
    at = np.concatenate([np.arange(n) * 260, (b[long] * 65 + k[long]) * 4 + nth, (b * 65 + k) * 4 + 3, (short * 65 + 64) * 4])
    table = np.concatenate([chroma, 2 + chroma[b[long]], 2 + chroma[b], 2 + chroma[short]])
    symbol = np.concatenate([dc_size, zero(long) + 0xF0, run % 16 * 16 + size, zero(short)])
    extra, extra_size = np.concatenate([dc_value, zero(long), value, zero(short)]), np.concatenate([dc_size, zero(long), size, zero(short)])
    order = np.argsort(at, kind="stable")
    table, symbol, extra, extra_size = table[order], symbol[order], extra[order], extra_size[order]

    made = [codes(code_lengths(np.bincount(symbol[table == t], minlength=256))) for t in range(4)]
    code, length = (np.stack([m[i] for m in made]) for i in (0, 1))
    total = length[table, symbol] + extra_size
    word = code[table, symbol] << extra_size | extra
    place = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
    bits = (np.repeat(word, total) >> (np.repeat(total, total) - 1 - place) & 1).astype(np.uint8)
    body = np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes().replace(b"\xff", b"\xff\x00")

    part = lambda kind, data: struct.pack(">BBH", 0xFF, kind, len(data) + 2) + data
    out = b"\xff\xd8" + part(0xE0, b"JFIF\0" + struct.pack(">HBHHBB", 0x0101, 0, 1, 1, 0, 0))
    out += b"".join(part(0xDB, bytes([i]) + bytes(t[ZIGZAG].tolist())) for i, t in enumerate(tables))
    out += part(0xC0, struct.pack(">BHHB", 8, h, w, 3) + b"".join(bytes([i + 1, 0x11, min(i, 1)]) for i in range(3)))
    out += b"".join(part(0xC4, bytes([(t // 2) << 4 | t % 2]) + made[t][2]) for t in range(4))
    return out + part(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])) + body + b"\xff\xd9"
