"""Document fingerprints from prefix polynomial hashes.

PrefixHash holds the polynomial hashes of all prefixes of a text modulo a Mersenne prime, for two bases. Any two spans are
compared in constant time and the longest common extension of two positions is found by binary search.

A fingerprint is five fields between colons: code points; the hash of the whole text; the distance of the rungs, a power of two;
hashes of the prefixes and then of the suffixes that end and begin on a rung; and the least hashes of all spans of SPAN code
points. Likeness is the greater of two shares: code points in the longest common prefix and suffix, found by binary search on the
rungs, and spans in common, estimated from the least hashes.

Null text: empty. Empty texts are alike (1) and unlike all others (0). Documents follow each other by descending doc_id, equal ids
by their texts, null ids last; after the last comes the first. Repeated rows: a row each. Empty table: no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, sliced, table, text_bytes

P = (1 << 31) - 1
BASES = (1_000_003_243, 1_500_450_271)
SPAN = 16
RUNGS = 8
LEAST = 24


class _Powers:
    """Powers of a base and of its inverse modulo P, extended as longer texts come."""

    def __init__(self, base: int):
        self.of = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
        self.base = [base, pow(base, P - 2, P)]

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.of[0]) < n:
            for i in (0, 1):
                a = self.of[i]
                self.of[i] = np.concatenate([a, a * np.uint64(pow(self.base[i], len(a), P)) % np.uint64(P)])
        return self.of[0][:n], self.of[1][:n]


_powers = [_Powers(b) for b in BASES]


class PrefixHash:
    def __init__(self, text: str):
        cp = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
        self.n = len(cp)
        self.sums, self.inverse = [], []
        for powers in _powers:
            up, down = powers.upto(self.n + 1)
            s = np.zeros(self.n + 1, np.uint64)
            np.cumsum(cp * up[:-1] % np.uint64(P), out=s[1:])
            self.sums.append(s % np.uint64(P))
            self.inverse.append(down)

    def spans(self, lo: np.ndarray, hi: np.ndarray, k: int = 0) -> np.ndarray:
        """Hashes of the spans [lo, hi) for base k: equal spans have equal hashes wherever they lie."""
        s = self.sums[k]
        return (s[hi] + np.uint64(P) - s[lo]) % np.uint64(P) * self.inverse[k][lo] % np.uint64(P)

    def span(self, lo: int, hi: int) -> int:
        a, b = (int((int(s[hi]) - int(s[lo])) % P * int(inv[lo]) % P) for s, inv in zip(self.sums, self.inverse, strict=True))
        return a << 31 | b

    def common_extension(self, i: int, other: PrefixHash, j: int) -> int:
        """Length of the longest common run of self from i and other from j."""
        lo, hi = 0, min(self.n - i, other.n - j)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self.span(i, i + mid) == other.span(j, j + mid):
                lo = mid
            else:
                hi = mid - 1
        return lo

    def fingerprint(self) -> str:
        n, step = self.n, 1
        while n // step >= 2 * RUNGS:
            step *= 2
        at = np.arange(1, n // step + 1) * step
        rungs = [_hex(self.spans(np.zeros_like(at), at)), _hex(self.spans(n - at, np.full_like(at, n)))]
        if n:
            size = min(SPAN, n)
            s = self.sums[0]
            h = (s[size:] + np.uint64(P) - s[:-size]) % np.uint64(P) * self.inverse[0][: n + 1 - size] % np.uint64(P)
            h = h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            some = h[h < (8 * LEAST << 31) // len(h)] if len(h) > 32 * LEAST else h
            least = np.unique(some)[:LEAST]
            if len(least) < LEAST and len(some) < len(h):
                least = np.unique(h)[:LEAST]
        else:
            least = np.zeros(0, np.uint64)
        return f"{n}:{self.span(0, n):016x}:{step}:{rungs[0]}{rungs[1]}:{_hex(least)}"


def _hex(a: np.ndarray) -> str:
    return a.astype(">u4").tobytes().hex()


def fingerprint(text: str) -> str:
    return PrefixHash(text).fingerprint()


def likeness(a: str, b: str) -> float:
    """0 to 1, from two fingerprints alone."""
    if a == b:
        return 1.0
    (na, _, sa, ra, la), (nb, _, sb, rb, lb) = a.split(":"), b.split(":")
    na, nb, sa, sb = int(na), int(nb), int(sa), int(sb)
    if not na or not nb:
        return 0.0
    step, common = max(sa, sb), 0
    for side in (0, 1):
        x, y = (r[side * len(r) // 2 : (side + 1) * len(r) // 2] for r in (ra, rb))
        lo, hi = 0, min(na, nb) // step
        while lo < hi:
            mid = (lo + hi + 1) // 2
            i, j = 8 * (mid * step // sa - 1), 8 * (mid * step // sb - 1)
            lo, hi = (mid, hi) if x[i : i + 8] == y[j : j + 8] else (lo, mid - 1)
        common += lo * step
    x, y = ({r[i : i + 8] for i in range(0, len(r), 8)} for r in (la, lb))
    both = sorted(x | y)[:LEAST]
    jaccard = sum(h in x and h in y for h in both) / len(both)
    return max(min(1.0, common / max(na, nb)), 2 * jaccard / (1 + jaccard))


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as many code points from the start of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def fingerprints(spark: SparkSession, docs: DataFrame, rows_a_task: int = 4096) -> DataFrame:
    """Contract columns of every document. The texts are shuffled once, by ranges of doc_id; the first document of each range is
    also sent to the range before it, as what follows its last. There are as many ranges as the rows need."""
    texts = text_bytes(docs, "doc_id")
    n = max(2, texts.count() // rows_a_task + 1)
    ids = docs.where("doc_id is not null").select("doc_id").repartitionByRange(n, "doc_id")
    least = ids.groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("b")).collect()  # a number a range
    bounds = spark.sparkContext.broadcast(np.array(sorted(r["b"] for r in least)[1:], np.int64))

    def placed(it):
        for b in sliced(it):
            doc = b.column("doc_id")
            at = np.searchsorted(bounds.value, doc.fill_null(0).to_numpy(zero_copy_only=False), "right")
            at[doc.is_null().to_numpy(zero_copy_only=False)] = -1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], [*b.schema.names, "bucket"])

    named = docs.select("doc_id").mapInArrow(placed, "doc_id long, bucket int")
    ranges = named.groupBy("bucket").agg(F.max("doc_id").alias("top")).orderBy(F.desc("bucket")).collect()  # a row a range
    keyed = texts.mapInArrow(placed, "doc_id long, text binary, bucket int")
    if ranges:
        to = [(r["bucket"], r["top"], ranges[i - 1]["bucket"]) for i, r in enumerate(ranges)]
        heads = spark.createDataFrame(to, "b int, top long, dest int")
        first = (
            keyed.join(F.broadcast(heads), (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("top")))
            .groupBy("doc_id", "dest")
            .agg(F.min("text").alias("text"))
            .select("doc_id", "text", F.col("dest").alias("bucket"), F.lit(1).alias("extra"))
        )
        keyed = keyed.withColumn("extra", F.lit(0)).unionByName(first)
    else:
        keyed = keyed.withColumn("extra", F.lit(0))

    def run(it):
        last: tuple | None = None
        for b in batches(it):
            out: list[list] = [[] for _ in range(7)]
            for doc, raw, k, extra in zip(b["doc_id"], b["text"], b["bucket"], b["extra"], strict=True):
                text = raw.decode()
                mark = fingerprint(text)
                if last and last[2] == k:
                    d, t, _, m = last
                    e = edited(t, text)
                    f = fingerprint(e)
                    for c, v in zip(out, (d, len(t), hashlib.sha256(e.encode()).hexdigest(), m, f, likeness(m, f), likeness(m, mark)), strict=True):
                        c.append(v)
                last = None if extra else (doc, text, k, mark)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    ordered = keyed.repartition(n, "bucket").sortWithinPartitions("bucket", "extra", F.col("doc_id").desc_nulls_last(), "text")
    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op2_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark, table(spark, sf_dir, "documents"))
