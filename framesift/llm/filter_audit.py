"""How filters act together: what each removes in every order, alone, and by its Shapley share.

Five filters fail a document: A it has under 100 words; B under 80 % of its words are distinct; C over 10 % of its characters are A-Z; D it
holds one of `#$%&*|`; E its text is that of a document with a smaller id. A document's failures are a mask of five bits, and all
figures follow from the counts of masks in a part, so that orders cost nothing on documents.

E is found by refining partitions. Documents are split by their length in code points, then by the hashes of successive, growing blocks
of the text; a class of one goes at each step. What is left after the last block is compared by full texts, and the ids that aren't the
least of their text are marked. Repeated rows are counted together before any of it, counts are combined before they are shuffled, and
marks are looked up by class and id, so a text or an id that many rows share is no hot key.

Null text: empty, no words. Null lang: the part of the empty text. Null doc_id: fails no E, makes no other fail it, has no label. Rows of
one id and text: none fails E by the other, each counts. Repeated labels: good or toxic if one says so. Empty table: no rows. Other
columns are not read, so they may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, cut, drop, table, text_bytes

FILTERS = "ABCDE"
MARKS = b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Code points at which a block ends; the last block is the rest of the text.
BLOCKS = (64, 512, 4096)
HASHES = tuple(f"h{j}" for j in range(len(BLOCKS) + 1))


def failures(text: bytes, n_chars: int) -> int:
    """Bits of A to D."""
    words = text.split()
    few = len(words) < 100
    alike = 100 * len(set(words)) < 80 * len(words)
    loud = 100 * (len(text) - len(text.translate(None, CAPITALS))) > 10 * n_chars
    odd = len(text.translate(None, MARKS)) < len(text)
    return few | alike << 1 | loud << 2 | odd << 3


def block_hashes(text: str) -> list[int]:
    """64-bit hashes of the blocks; 0 for those that the text doesn't reach."""
    edges = [0, *BLOCKS, len(text)]
    return [int.from_bytes(blake2b(text[a:b].encode(), digest_size=8).digest(), "little", signed=True) if a < len(text) else 0 for a, b in zip(edges, edges[1:], strict=False)]


def traits(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, n, h0.., m): failures of A to D, length and hashes of whole texts, and how many rows have them."""
    part = F.coalesce("lang", F.lit("")).alias("part")
    names = ["doc_id", "part", "mask", "n", *HASHES]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            strings = [t.decode() for t in b["text"]]
            hashes = np.array([block_hashes(s) for s in strings], dtype=np.int64).reshape(-1, len(HASHES))
            mask = [failures(t, len(s)) for t, s in zip(b["text"], strings, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(b["doc_id"], pa.int64()), pa.array(b["part"], pa.string()), pa.array(mask, pa.int32()), pa.array([len(s) for s in strings], pa.int64()), *map(pa.array, hashes.T)], names)

    rows = text_bytes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), part, "text"), "doc_id", "part")
    schema = "doc_id long, part string, mask int, n long, " + ", ".join(f"{h} long" for h in HASHES)
    return rows.mapInArrow(run, schema).groupBy(*names).agg(F.count("*").alias("m"))


def refined(rows: DataFrame) -> DataFrame:
    """The rows of traits() that share length and all hashes with a row of another id."""
    kept, key = rows.where("doc_id is not null"), ["n"]
    for h in (*HASHES, None):
        shared = cut(kept.groupBy(*key).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select(*key), "classes")
        before, kept = kept, cut(kept.join(shared, key, "left_semi"), "refined")
        drop(shared)
        if hasattr(before, "_cut_path"):
            drop(before)
        key = [*key, h]
    return kept


def copies(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of traits() whose text is that of a smaller id."""
    key = ["n", *HASHES]
    left = refined(rows)
    ids = left.select("doc_id").distinct()
    full = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null").join(ids, "doc_id", "left_semi")
    first = full.groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    hashed = text_bytes(first, "doc_id").mapInArrow(_keys, "doc_id long, n long, " + ", ".join(f"{h} long" for h in HASHES))
    return left.join(hashed, ["doc_id", *key], "left_anti")


def _keys(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(it):
        strings = [t.decode() for t in b["text"]]
        hashes = np.array([block_hashes(s) for s in strings], dtype=np.int64).reshape(-1, len(HASHES))
        yield pa.RecordBatch.from_arrays([pa.array(b["doc_id"], pa.int64()), pa.array([len(s) for s in strings], pa.int64()), *map(pa.array, hashes.T)], ["doc_id", "n", *HASHES])


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each mask of five bits, and how many of them are labelled good, and toxic."""
    rows = cut(traits(docs), "traits")
    seen = ["doc_id", "part", "mask"]
    marked = copies(docs, rows).select(*seen, "m")
    moved = marked.select(*seen, (-F.col("m")).alias("m")).unionByName(marked.withColumn("mask", F.col("mask").bitwiseOR(16)))
    by_id = rows.select(*seen, "m").unionByName(moved).groupBy(*seen).agg(F.sum("m").alias("m")).where("m <> 0")
    flag = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("long"), F.lit(0)))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    joined = by_id.join(known, "doc_id", "left")
    total = lambda c: F.sum(F.col("m") * F.coalesce(c, F.lit(0))).alias(c)
    return joined.groupBy("part", "mask").agg(F.sum("m").alias("n"), total("good"), total("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, each order of the filters and each step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    steps = [(o, i + 1, 1 << FILTERS.index(f), sum(1 << FILTERS.index(g) for g in o[:i])) for o in map("".join, permutations(FILTERS)) for i, f in enumerate(o)]
    table_ = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("bit"), F.lit(e).alias("earlier")) for o, s, b, e in steps])
    parts = mask_counts(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))  # at most 32
    rows = parts.select("part", "counts", F.inline(table_))
    bit, earlier = F.col("bit"), F.col("earlier")
    total = lambda when, what=lambda c: c["n"]: F.aggregate(F.filter("counts", when), F.lit(0).cast("long"), lambda acc, c: acc + what(c))
    here = lambda c: (c["mask"].bitwiseAND(bit) != 0) & (c["mask"].bitwiseAND(earlier) == 0)
    return rows.select(
        "part", "filter_order", "step",
        total(lambda c: c["mask"].bitwiseAND(bit.bitwiseOR(earlier)) == 0).alias("kept"),
        total(here).alias("removed"),
        total(lambda c: (c["mask"].bitwiseAND(bit) != 0) & (c["mask"].bitwiseAND(earlier) != 0)).alias("redundant"),
        total(lambda c: c["mask"] == bit).alias("unique_fails"),
        total(here, lambda c: c["good"]).alias("good_lost"),
        total(here, lambda c: c["toxic"]).alias("toxic_lost"),
        # of the orders of k failing filters, one k-th begins with this one
        total(lambda c: c["mask"].bitwiseAND(bit) != 0, lambda c: (c["n"] * 120 / F.bit_count(c["mask"])).cast("long")).alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[ \t-\r]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS lo FROM d),
l AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::BIGINT) AS good, max((coalesce(toxic, 0) = 1)::BIGINT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
    (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * coalesce(w.doc_id > lo, false)::INT AS mask
  FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
x(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM x a, x b, x c, x d, x e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS earlier FROM o, range(1, 6) r(step)),
t AS (
  SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (bit | earlier) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0) AS removed, coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & earlier <> 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails, coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM t
"""
