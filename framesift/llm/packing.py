"""Sum-of-squares packing of tokenized documents into windows.

A document's ids, with an end id, are cut into full windows and a rest. The rest goes to the fill level that makes the sum of
the squared counts of partly filled windows least; the counts are held in an array by level. At the end of a partition the fullest
of the open windows are filled up with the pieces of the emptiest, and the last ids go into windows whose lengths are powers of
two, which need no padding; all other placements stay. What flush() places so is a smaller share the more documents a task packs:
the open windows are at most a few hundred, however many documents came before.

Null text: only the end id. Null doc_id: stays null. Repeated rows are packed each. Empty table: no rows. Other columns of the
input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import batches, released, table, text_bytes
from .tokens import KEPT, encode_sliced, encoder

WINDOW = 1024
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Piece:
    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start: int, ids: memoryview | bytes, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def __len__(self) -> int:
        return len(self.ids) // 4

    def split(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[: 4 * n], self.total), Piece(self.doc, self.start + n, self.ids[4 * n :], self.total)


class SquaresPacker:
    """counts[h]: open windows filled up to h. Yields (sequence, [pieces]) as windows fill."""

    def __init__(self, window: int = WINDOW):
        self.window, self.counts, self.open, self.made = window, np.zeros(window + 1, np.int64), [[] for _ in range(window + 1)], 0
        self.moved = 0  # ids that flush() placed

    def _new(self) -> int:
        self.made += 1
        return self.made - 1

    def level(self, size: int) -> int:
        """The level, 0 for a new window, at which a piece of `size` leaves the least sum of squares."""
        top = self.window - size
        n = self.counts
        gain = 2 * n[size : size + top + 1] + 1  # the level it reaches
        gain[top] = 0  # full windows don't count
        gain[1:] += 1 - 2 * n[1 : top + 1]
        gain[1:][n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        best = int(gain.argmin())
        tied = np.flatnonzero(gain == gain[best])
        return int(tied[-1])  # the fullest of equals

    def add(self, doc, ids: bytes) -> Iterator[tuple[int, list[Piece]]]:
        total, view, w = len(ids) // 4, memoryview(ids), self.window
        full = total // w * w
        for at in range(0, full, w):
            yield self._new(), [Piece(doc, at, view[4 * at : 4 * (at + w)], total)]
        if full == total:
            return
        piece = Piece(doc, full, bytes(view[4 * full :]), total)
        h = self.level(len(piece))
        if h:
            self.counts[h] -= 1
            seq, pieces = self.open[h].pop()
        else:
            seq, pieces = self._new(), []
        pieces.append(piece)
        h += len(piece)
        if h == w:
            yield seq, pieces
        else:
            self.counts[h] += 1
            self.open[h].append((seq, pieces))

    def flush(self) -> Iterator[tuple[int, list[Piece]]]:
        """Closes the open windows. The fullest stay as they are and are filled up with pieces of the emptiest, cut where need be; what
        is left in the end goes into windows of a power of two."""
        windows = [x for h in range(self.window, 0, -1) for x in self.open[h]]
        at, end = 0, len(windows)
        spare: list[Piece] = []
        free: list[int] = []
        while at < end:
            seq, pieces = windows[at]
            at += 1
            gap = self.window - sum(map(len, pieces))
            while gap and (spare or at < end):
                if not spare:
                    end -= 1
                    spare = windows[end][1]
                    free.append(windows[end][0])
                p = spare.pop()
                if len(p) > gap:
                    p, q = p.split(gap)
                    spare.append(q)
                pieces.append(p)
                gap -= len(p)
                self.moved += len(p)
            if gap:
                free.append(seq)
                spare = pieces
            else:
                yield seq, pieces
        rest = sum(map(len, spare))
        self.moved += rest
        while rest:
            size = 1 << (rest.bit_length() - 1)
            rest -= size
            pieces = []
            while size:
                p = spare.pop()
                if len(p) > size:
                    p, q = p.split(size)
                    spare.append(q)
                pieces.append(p)
                size -= len(p)
            yield free.pop() if free else self._new(), pieces


def pack(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 0, window: int = WINDOW, kept: int = KEPT) -> DataFrame:
    """One row per piece; kept: pieces whose ids a worker keeps. Each input partition is packed alone, so nothing is shuffled and no state outgrows a partition."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(it):
        enc, packer = encoder(tokenizer_path, kept), SquaresPacker(window)
        base = TaskContext.get().partitionId() << 36
        cols: list[list] = [[] for _ in range(7)]

        def put(seq: int, pieces: list[Piece]) -> None:
            at = 0
            for p in pieces:
                for c, v in zip(cols, (p.doc, p.start, len(p), zlib.crc32(p.ids), p.total, base + seq, at), strict=True):
                    c.append(v)
                at += len(p)

        def batch() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            for c in cols:
                c.clear()
            return b

        for b in batches(it):
            for doc, ids in zip(b["doc_id"], encode_sliced(enc, b["text"]), strict=True):
                for done in packer.add(doc, ids + end):
                    put(*done)
            if len(cols[0]) > 2000:
                yield batch()
                released()
        for done in packer.flush():
            put(*done)
        yield batch()
        del packer
        released()

    return text_bytes(docs, "doc_id").mapInArrow(run, SCHEMA)


def op5_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
