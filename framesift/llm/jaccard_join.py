"""Links between documents whose sets of word n-grams have a Jaccard similarity of a threshold or more, and their components.

The n-grams have one global order: those that are frequent in the corpus last, else by their hash. Equal sets are one node. The
order is cut into fragments (vertical partitioning). The first fragment of a set is its prefix, of which any two linked sets share an
n-gram. Partial overlaps are counted a fragment at a time and summed per pair; a set that can reach no partner any more, even if all that
is left of it were shared, is dropped before the next fragment.

Neither candidates nor links are made as rows of pairs. Sets that share prefix n-grams with the same set of high rank are a cluster, by
their sizes; clusters that share too few prefix n-grams for any link between them are left apart. What remains is compared in blocks:
a task holds one block of a cluster, and the sets of its other blocks and of the clusters beside it stream past. Overlaps of two blocks
are a matrix, the sum of one product a fragment. This is done twice: with the prefixes alone, which are narrow, and then with whole texts,
of the sets alone that share enough of their prefix with some set that they met. A task gives, for each set with links, their number and one
set of the same component, so rows grow with sets and blocks, and no link is lost. Blocks and streams are cut to a fixed size, so a large
cluster is many tasks.

Hashes of words, n-grams and sets have 64 bits. Null or empty text, or one without words: empty set, linked with nothing. Fewer words
than n: the whole sequence is one n-gram. Null doc_id: such documents take part and link others; a component of none but such has a
null id. Repeated rows: equal sets. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop, parts, released, sliced, table, whole
from .graph import components

FRAGMENTS = 4
#: Columns of a fragment's matrices at most; more n-grams are cut into more fragments.
COLUMNS = 4096
#: Sets and bytes of a block, and sets that stream past it in one task.
BLOCK_SETS, BLOCK_BYTES, STREAM_SETS = 512, 4 << 20, 1024
#: Size classes of a cluster's sets for each step by the threshold.
CLASSES = 4
COUNTED = 3 << 20
#: Bits that mark the hashes of wanted texts before these are sent; a power of two.
MARKS = 1 << 25
PIECE = 1 << 20
#: Bytes of texts whose sets are made at a time.
SLICE_BYTES = 2 << 20
_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Value of a byte in the hash of a word, A-Z as a-z; blanks have none.
_VALUE = np.where(_SPACE, 0, np.arange(256) + 1 + 32 * ((np.arange(256) > 64) & (np.arange(256) < 91))).astype(np.uint64)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, _MIX[0], np.uint64)])


_POWERS = _powers(1 << 12)


def _hashed(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie end to end and begin at starts; and where the words begin."""
    word = ~_SPACE[text]
    first = word.copy()
    first[1:] &= ~word[:-1]
    starts = starts[starts < len(text)]
    first[starts] = word[starts]
    at = np.flatnonzero(first)
    if not len(at):
        return np.zeros(0, np.uint64), at
    size = np.diff(np.r_[at, len(text)])
    powers = _POWERS if size.max() <= len(_POWERS) else _powers(int(size.max()))
    place = np.arange(at[0], len(text)) - np.repeat(at, size)
    h = np.add.reduceat(_VALUE[text[at[0] :]] * powers[place], at - at[0])
    h = (h ^ (h >> np.uint64(29))) * _MIX[1]
    return h ^ (h >> np.uint64(32)), at


def word_hashes(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts that lie end to end, and the bounds of each text's words. About PIECE bytes are worked on at a time."""
    out, counts = [], np.zeros(len(offsets), np.int64)
    i, last = 0, len(offsets) - 1
    while i < last:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
        lo, hi = int(offsets[i]), int(offsets[j])
        while hi - lo > PIECE:  # one long text: cut at a blank
            blank = np.flatnonzero(_SPACE[text[lo : lo + PIECE]])
            end = lo + int(blank[-1]) + 1 if len(blank) else hi
            if not len(blank):
                more = np.flatnonzero(_SPACE[text[lo + PIECE : hi]])
                end = lo + PIECE + int(more[0]) if len(more) else hi
            h, _ = _hashed(text[lo:end], np.zeros(1, np.int64))
            out.append(h)
            counts[j] += len(h)
            lo = end
        if hi > lo:
            starts = offsets[i:j] - lo if j > i + 1 else np.zeros(1, np.int64)
            h, at = _hashed(text[lo:hi], starts)
            out.append(h)
            counts[i + 1 : j + 1] += np.diff(np.searchsorted(at, np.r_[starts, hi - lo]))
        i = j
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.cumsum(counts)


def _combined(parts: list[np.ndarray]) -> np.ndarray:
    x = np.full(len(parts[0]), len(parts), np.uint64)
    for i, h in enumerate(parts):
        v = (h ^ x) * _MIX[i % len(_MIX)]
        x = (v ^ (v >> np.uint64(29))) + (x << np.uint64(7))
    x *= _MIX[0]
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Of each text (binary, not null): the sorted distinct 64-bit hashes of its word n-grams; A-Z count as a-z."""
    a = texts.cast(pa.large_binary())
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    text = np.frombuffer(a.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    h, at = word_hashes(text, offsets - offsets[0])
    size = len(h) - n + 1
    grams = _combined([h[i : i + size] for i in range(n)]) if size > 0 else h[:0]
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if hi - lo >= n:
            s = grams[lo : hi - n + 1]
            s.sort()
            if hi - lo > n:
                s = s[np.r_[True, s[1:] != s[:-1]]]
        else:
            s = _combined([h[i : i + 1] for i in range(lo, hi)]) if hi > lo else h[:0]
        out.append(s)
    return out


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _texts(docs: DataFrame, *columns) -> DataFrame:
    return docs.select(*columns, F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def repeated(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values that h holds twice or more and their counts; h is sorted in place, and nothing as large is made."""
    h.sort()
    again = np.zeros(len(h) + 1, bool)
    np.equal(h[1:], h[:-1], out=again[1 : len(h)])
    edges = np.flatnonzero(again[1:] != again[:-1])  # where runs of repeats begin and end
    lo, hi = edges[::2], edges[1::2]
    return h[lo], hi - lo + 1


def frequent(spark: SparkSession, docs: DataFrame, n: int, share: int = 8000, least: int = 32) -> np.ndarray:
    """Hashes of n-grams that occur often: in about 1/share of the documents and `least` at least, so at most share times the mean
    set size of them, at any number of documents. An n-gram is counted where it is found twice or more among COUNTED; its rank only
    decides how much work there is."""

    def run(it):
        held, size = [], 0
        for b in sliced(it, size=SLICE_BYTES):
            got = shingle_sets(b.column(0), n)
            held += got
            size += sum(map(len, got))
            if size >= COUNTED:
                yield counted(held)
                size = 0
        if held:
            yield counted(held)
        released()

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        h = np.concatenate(held)
        held.clear()
        h, c = repeated(h)
        return pa.RecordBatch.from_pydict({"h": h.view(np.int64), "c": c})

    total = docs.count()
    rows = _texts(docs).mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= max(least, total // share))
    return np.sort(rows.select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64))


def nodes_of(spark: SparkSession, docs: DataFrame, n: int, percent: int, *keep: str) -> DataFrame:
    """Columns kept, n_shingles, node (hash of the set; null if empty), text_hash and the prefix in the global order."""
    hot = spark.sparkContext.broadcast(frequent(spark, docs, n))  # bounded: see frequent()

    def run(it):
        import xxhash

        often, low = hot.value, np.uint64((1 << 22) - 1)
        maybe = np.zeros(1 << 22, bool)
        maybe[often & low] = True
        for batch in sliced(it, size=SLICE_BYTES):
            sets = shingle_sets(batch.column("text"), n)
            h = np.concatenate(sets)
            at = np.flatnonzero(maybe[h & low])
            late = np.zeros(len(h), bool)
            if len(at):
                late[at] = often[np.minimum(np.searchsorted(often, h[at]), len(often) - 1)] == h[at]
            out, lo = [], 0
            for s in sets:
                p, its = prefix_size(len(s), percent) if len(s) else 0, late[lo : lo + len(s)]
                lo += len(s)
                out.append((np.concatenate([s[~its][:p], s[its][:p]]) if its.any() else s)[:p])
            node = [xxhash.xxh3_64_intdigest(s) - (1 << 63) if len(s) else None for s in sets]
            prefix = pa.ListArray.from_arrays(np.cumsum([0] + [len(x) for x in out]).astype(np.int32), np.concatenate(out).view(np.int64))
            cols = [batch.column(c) for c in (*keep, "text_hash")] + [pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.int64()), prefix]
            yield pa.RecordBatch.from_arrays(cols, [*keep, "text_hash", "n_shingles", "node", "prefix"])
        released()

    rows = _texts(docs, *keep, F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (*keep, "text_hash"))
    return rows.mapInArrow(run, f"{schema}, n_shingles long, node long, prefix array<long>")


def clusters(lists: DataFrame, percent: int) -> DataFrame:
    """(node, n, most, key, class) of every node in lists (token, node, n, df): the key stands for the set of highest rank with which it shares
    an n-gram, and for the class of its size. The rank is the sum of the lists' lengths; most: its n-grams in lists."""
    rank = lists.groupBy("node").agg(F.sum("df").alias("rank"))
    named = lists.join(rank, "node")
    tops = named.groupBy("token").agg(F.max(F.struct("rank", "node")).alias("top"))
    homes = lists.join(tops, "token").groupBy("node").agg(F.max("n").alias("n"), F.count("*").alias("most"), F.max("top").alias("top"))
    step = math.log(100 / percent) / CLASSES * (1 + 1e-9) if percent < 100 else 1e-9
    sized = homes.withColumn("class", F.floor(F.log("n") / step))
    return sized.select("node", "n", "most", F.xxhash64("top.node", "class").alias("key"), "class")


def _floor_shared(lo, hi, percent: int):
    """Linked sets of lo and hi n-grams or of sizes between share more prefix n-grams than this."""
    t = percent / 100
    return t / (1 + t) * (lo - t * F.least(hi, lo / t)) - 1e-6


def neighbours(lists: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(key, cnt, bytes, other, floor): pairs of clusters, and clusters of two or more sets with themselves, that may hold links. The one with
    more bytes comes first; a set with links there has more prefix n-grams in lists than floor."""
    keys = members.groupBy("key").agg(F.count("*").alias("cnt"), F.sum("n").alias("size"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    found = lists.select("token", "node").join(members.select("node", "key", "class"), "node").select("token", "key", "class").distinct()
    beside = found.select("token", F.col("key").alias("other"), F.col("class").alias("class2"))
    near = found.join(beside, "token").where((F.col("key") < F.col("other")) & (F.abs(F.col("class") - F.col("class2")) <= CLASSES))
    shared = near.groupBy("key", "other").agg(F.count("*").alias("shared"))
    right = keys.select(F.col("key").alias("other"), *[F.col(c).alias(f"{c}2") for c in ("cnt", "size", "lo", "hi")])
    both = shared.join(keys, "key").join(right, "other").withColumn("floor", _floor_shared(F.least("lo", "lo2"), F.greatest("hi", "hi2"), percent))
    both = both.where(F.col("shared") > F.col("floor"))
    first = F.col("size") >= F.col("size2")
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    pairs = both.select(pick("key", "other").alias("key"), pick("cnt", "cnt2").alias("cnt"), pick("size", "size2").alias("size"), pick("other", "key").alias("other"), "floor", pick("cnt2", "cnt").alias("load"))
    own = keys.where("cnt > 1").select("key", "cnt", "size", F.col("key").alias("other"), _floor_shared(F.col("lo"), F.col("hi"), percent).alias("floor"), F.col("cnt").alias("load"))
    return pairs.unionByName(own)


def asking(lists: DataFrame, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, key, other, held): nodes of the cluster key that may have links in the cluster other (or their own), as they have more prefix n-grams
    of that cluster, or of its other nodes, than the pair's floor. held: the pair's blocks are of key, so that other streams past."""
    mine = lists.select("token", "node").join(members.select("node", "key", "class"), "node")
    found = mine.groupBy("token", "key", "class").agg(F.count("*").alias("c"))
    own = mine.join(found.where("c > 1").select("token", "key"), ["token", "key"]).select("node", "key", F.col("key").alias("other"))
    near = mine.join(found.select("token", F.col("key").alias("other"), F.col("class").alias("class2")), "token")
    near = near.where((F.col("key") != F.col("other")) & (F.abs(F.col("class") - F.col("class2")) <= CLASSES)).select("node", "key", "other")
    shared = own.unionByName(near).groupBy("node", "key", "other").agg(F.count("*").alias("shared"))
    back = pairs.where("key <> other").select(F.col("other").alias("key"), F.col("key").alias("other"), "floor", F.lit(False).alias("held"))
    both = pairs.select("key", "other", "floor", F.lit(True).alias("held")).unionByName(back)
    return shared.join(both, ["key", "other"]).where(F.col("shared") > F.col("floor")).select("node", "key", "other", "held")


def overlaps(a: list[np.ndarray], b: list[np.ndarray] | None, percent: int, whole_sizes: list[np.ndarray] | None = None) -> np.ndarray:
    """Which sets of a and b (None: a itself) are links: partial overlaps, a matrix product a fragment, summed per pair. With the sizes of whole
    sets (of a, of b), a and b hold their prefixes, and which pairs share so much of these that they may be links is told."""
    own = b is None
    sides = [a] if own else [a, b]
    tokens = [np.concatenate(s) for s in sides]
    owners = [np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in sides]
    sizes = [np.array([len(x) for x in s]) for s in sides]
    if own:
        u, c = np.unique(tokens[0], return_counts=True)
        u = u[c > 1]
    else:
        u = np.intersect1d(np.unique(tokens[0]), np.unique(tokens[1]), assume_unique=True)
    link = np.zeros((len(a), len(a if own else b)), bool)
    if not len(u):
        return link
    columns = []
    for k, t in enumerate(tokens):
        at = np.minimum(np.searchsorted(u, t), len(u) - 1)
        hit = u[at] == t
        owners[k], at = owners[k][hit], at[hit]
        columns.append(at)
    if own:
        columns, owners, sizes = columns * 2, owners * 2, sizes * 2
    left = [np.bincount(o, minlength=len(s)).astype(np.float32) for o, s in zip(owners, sizes, strict=True)]
    whole = sizes if whole_sizes is None else whole_sizes * 2 if own else whole_sizes
    need = -(-percent * (whole[0][:, None] + whole[1]) // (100 + percent))
    if whole_sizes is not None:  # up to where the first of two prefixes ends, all but so many n-grams of its set are shared
        after = [w - prefix_size(w, percent) for w in whole]
        need = np.maximum(need - np.maximum(after[0][:, None], after[1]), 1)
    need = need.astype(np.float32)
    need[np.minimum(whole[0][:, None], whole[1]) * 100 < percent * np.maximum(whole[0][:, None], whole[1])] = np.inf
    if own:
        np.fill_diagonal(need, np.inf)
    rows = [np.arange(len(s)) for s in sizes]
    total = np.zeros(need.shape, np.float32)
    parts = max(FRAGMENTS, -(-len(u) // COLUMNS))
    for f in range(parts):
        can = total + np.minimum(left[0][rows[0]][:, None], left[1][rows[1]]) >= need
        keep = [can.any(axis=1), can.any(axis=0)]
        if not keep[0].any():
            return link
        if not (keep[0].all() and keep[1].all()):
            rows = [r[k] for r, k in zip(rows, keep, strict=True)]
            total, need = total[keep[0]][:, keep[1]], need[keep[0]][:, keep[1]]
        lo, hi = len(u) * f // parts, len(u) * (f + 1) // parts
        held = []
        for k in (0, 1):
            place = np.full(len(sizes[k]), -1)
            place[rows[k]] = np.arange(len(rows[k]))
            x = np.zeros((len(rows[k]), hi - lo), np.float32)
            at = (columns[k] >= lo) & (columns[k] < hi) & (place[owners[k]] >= 0)
            x[place[owners[k][at]], columns[k][at] - lo] = 1
            left[k][rows[k]] -= x.sum(axis=1)
            held.append(x)
        total += held[0] @ held[1].T
    link[np.ix_(*rows)] = total >= need
    return link


def rooted(link: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column with links, the label of a row in the same component of this matrix."""
    most = len(labels)
    row = np.arange(most)
    while True:
        col = np.where(link, row[:, None], most).min(axis=0, initial=most)
        least = np.minimum(row, np.where(link, col, most).min(axis=1, initial=most))
        if (least == row).all():
            break
        row = least
    return labels[row], labels[np.minimum(col, most - 1)]


def _comparisons(it, read):
    """(task, nodes, sets, other nodes, other sets) from sorted rows (key, block, part, side, node, ...): a block and what streams past it, or the
    block and None for itself. read gives the sets of a batch. Lists are the caller's until the next step."""
    task, nodes, own, others, streamed, size = None, [], [], [], [], 0
    for b in sliced(it):
        for *key, side, node, s in zip(*(b.column(i).to_pylist() for i in range(5)), read(b), strict=True):
            if key != task or len(streamed) >= BLOCK_SETS or size > BLOCK_BYTES:
                if streamed and own:
                    yield task, nodes, own, others, streamed
                others, streamed, size = [], [], 0
            if key != task:
                if task is not None and task[2] == 0 and len(own) > 1:
                    yield task, nodes, own, None, None
                task, nodes, own = key, [], []
            if not side:
                nodes.append(node)
                own.append(s)
            else:
                others.append(node)
                streamed.append(s)
                size += s[0].nbytes
    if streamed and own:
        yield task, nodes, own, others, streamed
    if task is not None and task[2] == 0 and len(own) > 1:
        yield task, nodes, own, None, None


def sieved(rows: DataFrame, percent: int) -> DataFrame:
    """(key, block, part, side, node) of the rows (the same, n, tokens), sorted, whose prefix n-grams (tokens) overlap those of a set that they meet
    in their task so far that the two may be links."""

    def read(b: pa.RecordBatch):
        tokens = b.column(6)
        values, at = tokens.values.to_numpy(), tokens.offsets.to_numpy()
        return [(np.sort(values[lo:hi]), n) for lo, hi, n in zip(at[:-1].tolist(), at[1:].tolist(), b.column(5).to_pylist(), strict=True)]

    def batch(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], ["key", "block", "part", "side", "node"])

    def run(it):
        last, held, found = None, set(), []
        for task, nodes, a, others, b in _comparisons(it, read):
            if task != last:
                found += [(*last, 0, x) for x in held] if last else []
                last, held = task, set()
                if len(found) >= 10_000:
                    yield batch(found)
                    found = []
            sides = [a] if b is None else [a, b]
            link = overlaps([s for s, _ in a], None if b is None else [s for s, _ in b], percent, [np.array([n for _, n in s]) for s in sides])
            held.update(nodes[i] for i in np.flatnonzero(link.any(axis=1)).tolist())
            if b is not None:
                found += [(*task, 1, others[i]) for i in np.flatnonzero(link.any(axis=0)).tolist()]
        found += [(*last, 0, x) for x in held] if last else []
        if found:
            yield batch(found)

    return rows.mapInArrow(run, "key long, block int, part int, side int, node long")


def compared(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """(node, root, links) from rows (key, block, part, side, node, text), sorted: side 0 is the block, the others stream past."""

    def read(b: pa.RecordBatch):
        return [(s.copy(),) for s in shingle_sets(b.column(5), n)]  # a view would hold the whole slice

    def found(nodes: list[int], a: list, others: list[int] | None, b: list | None):
        link = overlaps([s for s, in a], None if b is None else [s for s, in b], percent)
        if not link.any():
            return None
        na = np.array(nodes)
        root, root_b = rooted(link if b is not None else link | np.eye(len(a), dtype=bool), na)  # a set is the same as row and as column
        c = link.sum(axis=1)
        got = [(na[c > 0], root[c > 0], c[c > 0])]
        if b is not None:
            c = link.sum(axis=0)
            got.append((np.array(others)[c > 0], root_b[c > 0], c[c > 0]))
        return [np.concatenate(c) for c in zip(*got, strict=True)]

    def batch(out: list):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], ["node", "root", "links"])

    def run(it):
        out, size = [], 0
        for _, nodes, a, others, b in _comparisons(it, read):
            if (got := found(nodes, a, others, b)) is not None:
                out.append(got)
                size += len(got[0])
            if size >= 10_000:
                yield batch(out)
                out, size = [], 0
        if out:
            yield batch(out)

    return rows.mapInArrow(run, "node long, root long, links long")


def marked(wanted: DataFrame) -> np.ndarray:
    """MARKS bits in 64-bit words: those that the low bits of the wanted text_hash name are set. 2^19 words reach the driver at most."""
    bit = F.col("text_hash").bitwiseAND(F.lit(MARKS - 1))
    words = wanted.select(F.shiftright(bit, 6).alias("w"), bit.bitwiseAND(F.lit(63)).cast("int").alias("b"))
    rows = words.groupBy("w").agg(F.expr("bit_or(shiftleft(1L, b))").alias("v")).toArrow()
    out = np.zeros(MARKS >> 6, np.uint64)
    out[rows["w"].to_numpy()] = rows["v"].to_numpy().view(np.uint64)
    return out


def wanted_texts(spark: SparkSession, docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(text_hash, text): each text of docs whose hash is in wanted, once, and some others, whose marks are the same."""
    marks = spark.sparkContext.broadcast(marked(wanted))

    def run(it):
        has = marks.value
        for b in it:
            m = b.column(0).to_numpy().view(np.uint64) & np.uint64(MARKS - 1)
            yield b.filter(pa.array((has[m >> np.uint64(6)] >> (m & np.uint64(63)) & np.uint64(1)).astype(bool)))

    texts = _texts(docs, F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    return texts.mapInArrow(run, "text_hash long, text binary").dropDuplicates(["text_hash"])


def link(spark: SparkSession, docs: DataFrame, n: int = 5, percent: int = 80, *keep: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(columns kept with n_shingles, node and text_hash) of every document, (node, label) of every node that is linked to another, and
    (node, n_links), its number of links."""
    of_docs = cut(nodes_of(spark, docs, n, percent, *keep), "nodes")
    distinct = of_docs.where("node is not null").groupBy("node").agg(F.first("prefix").alias("prefix"), F.max("n_shingles").alias("n"))
    rows = distinct.select(F.explode("prefix").alias("token"), "node", "n")  # sent once: by a window, not joined with its own counts
    lists = cut(rows.withColumn("df", F.count("*").over(Window.partitionBy("token"))).where("df > 1").select("token", "node", "n", "df"), "lists")
    members = cut(clusters(lists, percent), "members")
    pairs = cut(neighbours(lists, members, percent), "clusters")
    asked = cut(asking(lists, members, pairs), "asking")

    block = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")
    part = F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts")).cast("int")
    held = asked.where("held").select("node", "key").distinct()
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") * 8 / BLOCK_BYTES)).cast("int")
    streams = asked.where("not held or key = other").groupBy(F.col("other").alias("key")).agg(F.ceil(F.count("*") / STREAM_SETS).cast("int").alias("parts"))
    hubs = cut(held.join(members.select("node", "n"), "node").groupBy("key").agg(blocks.alias("blocks")).join(streams, "key"), "hubs")
    own = held.join(hubs, "key").select("key", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), "node")
    beside = asked.where("not held").select(F.col("other").alias("key"), "node").join(hubs, "key")
    beside = beside.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), part.alias("part"), F.lit(1).alias("side"), "node")
    later = asked.where("key = other").select("key", "node").join(hubs.where("blocks > 1"), "key").where(block > 0)
    later = later.select("key", F.explode(F.sequence(F.lit(0), block - 1)).alias("block"), part.alias("part"), F.lit(1).alias("side"), "node")
    placed = own.unionByName(beside).unionByName(later)

    task = ["key", "block", "part"]
    prefixes = lists.groupBy("node").agg(F.max("n").alias("n"), F.collect_list("token").alias("tokens"))
    narrow = placed.join(prefixes, "node").select(*task, "side", "node", "n", "tokens")
    near = cut(sieved(narrow.repartition(*task).sortWithinPartitions(*task, "side", "node"), percent), "near")
    for x in (lists, pairs, asked, hubs, members):
        drop(x)

    # texts go to the tasks, where their sets are made: texts compress, hashes don't
    hashes = of_docs.where("node is not null").groupBy("node").agg(F.min("text_hash").alias("text_hash"))
    wanted = cut(near.join(hashes, "node"), "wanted")
    drop(near)
    tasks = wanted.join(wanted_texts(spark, docs, wanted), "text_hash").select(*task, "side", "node", "text")
    got = cut(compared(tasks.repartition(*task).sortWithinPartitions(*task, "side", "node"), n, percent), "links")
    drop(wanted)
    labels = components(got.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return of_docs.select(*keep, "n_shingles", "node", "text_hash"), labels, got.groupBy("node").agg(F.sum("links").alias("n_links"))


def linked_components(spark: SparkSession, docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links, a row for each document. n_links: of its set, with other sets."""
    of_docs, labels, counts = link(spark, docs, n, percent, "doc_id")
    named = of_docs.join(labels.join(counts, "node"), "node", "left").withColumn("label", F.coalesce("label", "node")).withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    ids = named.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    component = F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return named.join(ids, "label", "left").select("doc_id", "n_shingles", component.alias("component_id"), "n_links")


def op9_vertical_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_components(spark, table(spark, sf_dir, "documents"), n=3, percent=90)


def one_of_each(spark: SparkSession, docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs without near-duplicates: of each component the document with the least doc_id stays (a null id comes last; of equal ids the
    text with the least hash; of equal rows one). Documents without words stay. Columns of any name pass through."""
    of_docs, labels, _ = link(spark, docs, n, percent, "doc_id")
    named = of_docs.where("node is not null").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    best = named.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("w"))
    key = lambda id: (F.coalesce(id.cast("string"), F.lit("")).alias("key"), id.isNull().alias("none"))
    by = ["hash", "key", "none"]  # texts are sent once: the join and dropDuplicates are by the same columns
    best = best.select(F.col("w.text_hash").alias("hash"), *key(F.col("w.doc_id")))
    words = F.coalesce("text", F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    hashed = docs.where(words).select(whole(docs), F.xxhash64("text").alias("hash"), *key(F.col("doc_id")))
    kept = hashed.join(best, by).dropDuplicates(by)
    return kept.select(*parts(docs)).unionByName(docs.where(~words))


#: Rows of op9_vertical_jaccard by plain means: all pairs of sets with a common shingle, links by their sizes, components by reach.
ORACLE_SQL = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)])) END AS s
  FROM cut
), noded AS (
  SELECT doc_id, len(s) AS n, s, CASE WHEN len(s) > 0 THEN min(doc_id) OVER (PARTITION BY s) ELSE doc_id END AS node FROM shingled
), sets AS (
  SELECT node, n, unnest(s) AS token FROM noded WHERE doc_id = node AND n > 0
), links AS MATERIALIZED (
  SELECT a.node AS a, b.node AS b FROM sets a JOIN sets b ON a.token = b.token AND a.node <> b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach AS (
  SELECT DISTINCT a AS node, a AS other FROM links
  UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT d.doc_id, d.n AS n_shingles, coalesce(c.component_id, d.node) AS component_id, coalesce(k.n_links, 0) AS n_links
FROM noded d
LEFT JOIN (SELECT node, min(other) AS component_id FROM reach GROUP BY node) c USING (node)
LEFT JOIN (SELECT a AS node, count(*) AS n_links FROM links GROUP BY a) k USING (node)
"""
