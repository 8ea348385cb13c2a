"""Token ids in binary shards: independent zstandard frames, per-frame checksums and a trailing seek table.

A shard is, in this order: data frames, each decompressing alone; a skippable frame with the documents' ids and lengths; a
skippable frame with the seek table (compressed size, decompressed size and low 32 bits of XXH64 of each data frame; then the
number of frames, a descriptor byte and the seekable magic number). A reader takes the tail, then only the frames it needs.

Shards are written under the shared folder by the tasks, each to a name of its own that is moved in place when whole; a task
that runs again writes the same bytes. Null text: only the end id. Null doc_id: sorts first. Equal ids: by a hash of the text, then the text. Empty table: no
shards and no rows. Other columns of the input are not read.
"""

from __future__ import annotations

import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, cut, shared_dir, table, text_bytes
from .tokens import encode_sliced, encoder

# Fixed values of the seekable zstandard format.
SEEK_SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
CHECKSUMS = 0x80
INDEX_SKIPPABLE = 0x184D2A50
FRAME_BYTES = 1 << 18
NULL_ID = -(1 << 63)
#: Bytes of text of a shard; a table has as many shards as it needs, and the session's number of partitions at least.
SHARD_BYTES = 128 << 20


def _fs(path: str):
    return pafs.FileSystem.from_uri(path)


class ShardWriter:
    """Writes one shard to an open binary stream. Ids are held in 2 bytes where the vocabulary allows."""

    def __init__(self, out, wide: bool, frame_bytes: int = FRAME_BYTES):
        import xxhash
        import zstandard

        self.out, self.dtype, self.frame_bytes = out, "<u4" if wide else "<u2", frame_bytes
        self.compress, self.sum = zstandard.ZstdCompressor(level=3, write_checksum=True).compress, xxhash.xxh64_intdigest
        self.buffer, self.frames, self.docs, self.lengths, self.n_ids = bytearray(), [], array("q"), array("I"), 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append(NULL_ID if doc_id is None else doc_id)
        self.lengths.append(len(ids))
        self.n_ids += len(ids)
        self.buffer += ids.astype(self.dtype).tobytes()
        while len(self.buffer) >= self.frame_bytes:
            self._frame(self.frame_bytes)

    def _frame(self, n: int) -> None:
        raw = bytes(self.buffer[:n])
        del self.buffer[:n]
        packed = self.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), self.sum(raw) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.buffer:
            self._frame(len(self.buffer))
        index = self.compress(np.asarray(self.docs, "<i8").tobytes() + np.asarray(self.lengths, "<u4").tobytes())
        head = struct.pack("<BI", int(self.dtype == "<u4"), len(self.docs))
        self.out.write(struct.pack("<II", INDEX_SKIPPABLE, len(head) + len(index)) + head + index)
        seek = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SEEK_SKIPPABLE, len(seek)) + seek)


class ShardReader:
    """Reads a shard from a seekable file; decompresses only the frames that hold what is asked for."""

    def __init__(self, f, size: int):
        import xxhash
        import zstandard

        self.f, self.unpack, self.sum = f, zstandard.ZstdDecompressor().decompress, xxhash.xxh64_intdigest
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or not flags & CHECKSUMS:
            raise ValueError("not a shard: the seek table is missing")
        at = size - 9 - 12 * n
        table = np.frombuffer(self._at(at, 12 * n), "<u4").reshape(n, 3)
        self.packed, self.raw, self.sums = (table[:, i].astype(np.int64) for i in range(3))
        self.offset, self.begins = np.concatenate([[0], np.cumsum(self.packed)]), np.concatenate([[0], np.cumsum(self.raw)])
        here = int(self.offset[-1])
        magic, length = struct.unpack("<II", self._at(here, 8))
        if magic != INDEX_SKIPPABLE:
            raise ValueError("not a shard: the document index is missing")
        body = self._at(here + 8, length)
        wide, docs = struct.unpack("<BI", body[:5])
        index = self.unpack(body[5:])
        self.width = 4 if wide else 2
        self.doc_ids, self.lengths = np.frombuffer(index[: 8 * docs], "<i8"), np.frombuffer(index[8 * docs :], "<u4").astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.held: tuple[int, bytes] = (-1, b"")

    def _at(self, offset: int, n: int) -> bytes:
        self.f.seek(offset)
        return self.f.read(n)

    def frame(self, k: int) -> bytes:
        if self.held[0] != k:
            raw = self.unpack(self._at(int(self.offset[k]), int(self.packed[k])))
            if self.sum(raw) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k}: checksum differs")
            self.held = (k, raw)
        return self.held[1]

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document of the shard."""
        a, b = int(self.starts[i]) * self.width, int(self.starts[i + 1]) * self.width
        parts = []
        k = int(np.searchsorted(self.begins, a, "right")) - 1
        while a < b:
            raw, begin = self.frame(k), int(self.begins[k])
            parts.append(raw[a - begin : b - begin])
            a = begin + len(raw)
            k += 1
        return np.frombuffer(b"".join(parts), f"<u{self.width}").astype("<u4")

    def find(self, doc_id: int) -> list[int]:
        """Positions of the documents with this id; shards are in the order of the ids."""
        return list(range(int(np.searchsorted(self.doc_ids, doc_id, "left")), int(np.searchsorted(self.doc_ids, doc_id, "right"))))


def write(spark: SparkSession, docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Writes the shards; returns their manifest (shard, path, n_docs, n_ids, start), start: ids of all shards before."""

    end = np.array([end_id], "<u4").tobytes()

    def run(it):
        enc, task = encoder(tokenizer_path), TaskContext.get()
        fs, root = _fs(out_dir)
        k, writer, out = task.partitionId(), None, None
        tmp, final = f"{root}/.part-{k:06d}-{task.taskAttemptId()}", f"{root}/shard-{k:06d}.zst"
        for b in batches(it):
            if writer is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(tmp)
                writer = ShardWriter(out, enc.tokenizer.get_vocab_size() > 1 << 16)
            for doc, ids in zip(b["doc_id"], encode_sliced(enc, b["text"]), strict=True):
                writer.add(doc, np.frombuffer(ids + end, "<u4"))
        if writer is not None:
            writer.close()
            out.close()
            fs.move(tmp, final)
            yield pa.RecordBatch.from_pydict({"shard": [k], "path": [f"{out_dir}/shard-{k:06d}.zst"], "n_docs": [len(writer.docs)], "n_ids": [writer.n_ids]})

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SHARD_BYTES + 1)
    texts = text_bytes(docs, "doc_id").withColumn("tie", F.xxhash64("text"))
    ordered = texts.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    made = cut(ordered.mapInArrow(run, "shard long, path string, n_docs long, n_ids long"), "manifest")
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # a row a shard
    return made.withColumn("start", F.coalesce(before, F.lit(0)).cast("long"))


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and crc32 of the ids of every document, read from the shards."""

    def run(it):
        for b in batches(it):
            for path, start in zip(b["path"], b["start"], strict=True):
                fs, name = _fs(path)
                with fs.open_input_file(name) as f:
                    r = ShardReader(f, f.size())
                    for lo in range(0, len(r.doc_ids), 4096):
                        part = range(lo, min(lo + 4096, len(r.doc_ids)))
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([None if r.doc_ids[i] == NULL_ID else int(r.doc_ids[i]) for i in part], pa.int64()),
                                pa.array([start + int(r.starts[i]) for i in part], pa.int64()),
                                pa.array([int(r.lengths[i]) for i in part], pa.int64()),
                                pa.array([zlib.crc32(r.ids(i).tobytes()) for i in part], pa.int64()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    # a task for each shard: the manifest is too small for Spark to see the work behind it
    return manifest.repartition(max(1, manifest.count()), "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_seekable_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = shared_dir(spark, "tokens")
    return read(write(spark, table(spark, sf_dir, "documents"), out, public_tokenizers.path("word_bpe_49k.json"), end_id=1))
