"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions alone.

A source's documents, in the order of a hash, are cut into blocks. A source with weight w may start its block k at slot
floor(k/w) and must have it by ceil((k+1)/w); among what may start, the earliest deadline is placed. When a source runs out, the
others go on in the same proportion, so releases and deadlines are in units of virtual time, which passes faster with fewer
sources left. The weights are used as they are, for every slot: no source is ever a whole block ahead of its share or behind it,
however many slots there are. Every source is scheduled by itself. No document is left out or repeated.

The driver lays out the slots, a number for each block, and each block finds its slot by a join with them; documents stay where
they are. A source's place in the order of documents is counted by ranges of the hash, so that no source has to lie in one task.

Null source: a source of its own. Null doc_id: ordered by the other columns. Repeated rows: each has its place. Empty table: no rows.
Columns of the input named as those that are added are replaced.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parts, table, whole

NO_SOURCE = "\u0000none"
OTHERS = "\u0000others"
#: Blocks of a source whose slots are one row of the join.
RUN = 1024
#: Blocks of the whole mixture, about; larger mixtures have larger blocks.
MOST_BLOCKS = 1_000_000


def period(quotas: dict[str, int]) -> list[tuple[str, int]]:
    """Slots of one period: the source and the number of its block in the period; earliest deadline first among the released."""
    length = sum(quotas.values())
    release: list[list] = [[] for _ in range(length)]
    for s, q in quotas.items():
        for k in range(q):
            release[k * length // q].append((-(-(k + 1) * length // q), s, k))
    ready: list = []
    out = []
    for t in range(length):
        for x in release[t]:
            heapq.heappush(ready, x)
        deadline, s, k = heapq.heappop(ready)
        if t >= deadline:
            raise AssertionError("a deadline is missed")
        out.append((s, k))
    return out


def schedule(blocks: dict[str, int], weights: dict[str, float]) -> dict[str, list[int]]:
    """Slots of each source's blocks, for any positive weights; sources of no weight come after all others, in equal parts."""
    some = {s: n for s, n in blocks.items() if n and weights[s] > 0}
    names = sorted(some)
    w, size = [float(weights[s]) for s in names], [some[s] for s in names]
    ends = sorted((n / x, x) for n, x in zip(size, w, strict=True))
    active = [0.0] * (len(ends) + 1)  # weight of the sources that end last
    for i in range(len(ends) - 1, -1, -1):
        active[i] = active[i + 1] + ends[i][1]
    out: list[list[int]] = [[] for _ in names]
    waiting = [(0.0, i) for i in range(len(names))]
    ready: list[tuple[float, int]] = []
    ended, since, at = 0, 0.0, 0.0  # sources that have ended by the share, and slot and virtual time at which the last one did
    for t in range(sum(size)):
        while ended < len(ends) and since + (ends[ended][0] - at) * active[ended] <= t + 1:
            since, at = since + (ends[ended][0] - at) * active[ended], ends[ended][0]
            ended += 1
        now = at + (t + 1 - since) / active[ended] if ended < len(ends) else float("inf")
        while waiting and (waiting[0][0] < now * (1 - 1e-12) or not ready):
            i = heapq.heappop(waiting)[1]
            heapq.heappush(ready, ((len(out[i]) + 1) / w[i], i))
        i = heapq.heappop(ready)[1]
        out[i].append(t)
        if len(out[i]) < size[i]:
            heapq.heappush(waiting, (len(out[i]) / w[i], i))
    rest = {s: n for s, n in blocks.items() if n and s not in some}
    last = schedule(rest, dict.fromkeys(rest, 1.0)) if rest else {}
    return dict(zip(names, out, strict=True)) | {s: [sum(size) + t for t in x] for s, x in last.items()}


def phases(blocks: dict[str, int], quota: dict[str, int]) -> list[tuple[int, int, dict[str, int], dict[str, int]]]:
    """(first slot, periods, quotas, first block of each source). A last period before a source ends has what is left of it."""
    left, done, slot = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0
    out = []
    while left:
        times = min(n // quota[s] for s, n in left.items())
        now = {s: quota[s] for s in left} if times else {s: min(quota[s], n) for s, n in left.items()}
        times = max(times, 1)
        out.append((slot, times, now, {s: done[s] for s in now}))
        slot += times * sum(now.values())
        for s, q in now.items():
            done[s] += times * q
            left[s] -= times * q
        left = {s: n for s, n in left.items() if n}
    return out


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, block_docs: int | None = None, max_sources: int | None = None, group_rows: int = 4096) -> DataFrame:
    """docs with source_weight, block (of the source), slot (of the block in the mixture) and place (in the block).

    weights: by source; a source without one has that of the least. None: in proportion to documents ** temperature.
    block_docs: None: 16, and more from MOST_BLOCKS blocks of 16 on, so that the driver's list of slots is bounded.
    max_sources: if given, sources past the largest max_sources - 1 are one source together."""
    spark = docs.sparkSession
    ties = [F.col(f"`{c}`") for c in docs.columns if docs.schema[c].dataType.simpleString() in ("string", "bigint", "int")]
    h = F.when(F.col("doc_id").isNull(), F.xxhash64(*ties)).otherwise(F.xxhash64("doc_id"))
    named = docs.select(whole(docs), F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE)).alias("_s"), h.alias("_h"))
    sizes = named.groupBy("_s").count()
    largest = sizes if max_sources is None else sizes.orderBy(F.desc("count"), "_s").limit(max_sources - 1)
    top = {r["_s"]: r["count"] for r in largest.collect()}
    rest = sizes.where(~F.col("_s").isin(list(top))).agg(F.sum("count").alias("n")).first()["n"] if max_sources and len(top) == max_sources - 1 else None
    n_docs = sum(top.values()) + (rest or 0)
    if rest:
        named = named.withColumn("_s", F.when(F.col("_s").isin(list(top)), F.col("_s")).otherwise(OTHERS))
        top[OTHERS] = rest
    least = min(weights.values(), default=1.0) if weights else 1.0
    share = {s: float(weights.get(s, least)) if weights else n**temperature for s, n in top.items()}
    block_docs = block_docs or max(16, -(-n_docs // MOST_BLOCKS))
    slots_of = schedule({s: -(-n // block_docs) for s, n in top.items()}, share)

    # place of each document in its source: by ranges of the hash, then within the range
    n_groups = max(1, n_docs // group_rows)
    named = named.withColumn("_g", F.floor((F.shiftright("_h", 40) + (1 << 23)) * n_groups / (1 << 24)).cast("int"))
    before = Window.partitionBy("_s").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = named.groupBy("_s", "_g").count().select(F.col("_s").alias("_s2"), F.col("_g").alias("_g2"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_off"))
    ties = [F.col(f"doc.`{c}`") for c in docs.columns if docs.schema[c].dataType.simpleString() in ("string", "bigint", "int")]
    within = F.row_number().over(Window.partitionBy("_s", "_g").orderBy("_h", *ties))
    placed = named.withColumn("_rn", within).join(offsets, (F.col("_s") == F.col("_s2")) & (F.col("_g") == F.col("_g2")))
    at = F.col("_off") + F.col("_rn") - 1
    placed = placed.withColumn("block", F.floor(at / block_docs).cast("long")).withColumn("place", (at % block_docs).cast("int"))

    total = sum(share.values()) or 1.0
    runs = [(s, i // RUN, x[i : i + RUN], share[s] / total) for s, x in slots_of.items() for i in range(0, len(x), RUN)]
    runs_df = spark.createDataFrame(runs, "_rs string, _run long, _slots array<long>, source_weight double")
    run = F.floor(F.col("block") / RUN)
    out = placed.join(F.broadcast(runs_df), (F.col("_s") == F.col("_rs")) & (run == F.col("_run")))
    slot = F.element_at("_slots", (F.col("block") % RUN + 1).cast("int"))
    added = {"source_weight": F.col("source_weight"), "block": F.col("block"), "slot": slot.cast("long"), "place": F.col("place")}
    return out.select(*parts(docs.drop(*added)), *[v.alias(c) for c, v in added.items()])


def op4_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return mix(docs)
