"""Language-model scores by online logistic context mixing, and a smoothed unigram base.

A text is its words, A-Z as a-z, each ended by a blank, with an end flag before each word and after the last. A byte is a few
binary decisions along a prefix code of the corpus's bytes. Four predictors give each decision a probability from counts in hashed contexts: the
last three bytes, the last two with the last letter outside ASCII, the whole of the word so far, and that with that letter. A predictor's
slot is a one-byte state, exact for small counts. Their logits are mixed with weights that a gate selects by how well the two longest
contexts are known. These weights are trained by online gradient steps on all training documents, that is on all distinct words and their
counts, each decision's own count taken out. Within a document two more weights, on the mixed logit and on the longest context's, are
refined after every block of words by an online gradient step.

Over words there is a fifth predictor, a match model with a memory of all training documents: three words in a row, where their hash says
so, are an anchor, and what followed the same anchor in another training document is predicted for the next words. Whether the
word is the predicted one is one decision, whose probability is counted within the document; only if it isn't, the word is spelled.
So what is predicted depends on the text before alone, and probabilities of all texts sum to 1 at most.

Words are counted by chunk of documents, then merged by partitions of their hashes; tables and weights are made of the merged
words, and a chunk is answered with the counts of just its own words and the anchors that it shares with others. The tables of the
predictors have a fixed size, so they can be broadcast; counts and anchors grow with the corpus. Null text: empty, which has an end and a
score. Null doc_id: its crc32 is that of the empty text. Repeated rows: a row each, each counted. Empty table: no rows. Without training
documents the base is uniform. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, crc_mod, cut, drop, released, table
from .jaccard_join import word_hashes

BITS = 22
SLOTS = 1 << BITS
CONTEXTS = 4
PART = 1 << 15
CHUNK_BYTES = 6 << 20
CLASSES = 64
BLOCK = 32
#: Words whose decisions are laid out at a time; documents that are scored together, and their words.
SLICE = 2000
#: A part is cut once for so many of the square root of the chunks.
CUT = 6
#: Bytes of a beginning that words share.
HEAD = 8
#: Classes and words of a row of the merged words.
LISTED = 120_000
#: Words that are compared with their likes at a time.
RUN = 1 << 16
GROUP, GROUP_WORDS = 128, 60_000
GATES = 16
#: Words of an anchor, how many of them are one in so many, and words that are predicted after it.
ANCHOR, ANCHOR_EVERY, AHEAD = 3, 16, 6
LN10 = float(np.log(10.0))


class Code:
    """A prefix code for all bytes, short for frequent ones: offset and length of each byte's decisions, their nodes and bits."""

    def __init__(self, counts: np.ndarray):
        path: list[list[tuple[int, int]]] = [[] for _ in range(256)]
        heap = [(int(n) + 1, b, (b,)) for b, n in enumerate(counts)]
        heapq.heapify(heap)
        node = 256
        while len(heap) > 1:
            (na, _, a), (nb, _, b) = heapq.heappop(heap), heapq.heappop(heap)
            for side, symbols in ((0, a), (1, b)):
                for s in symbols:
                    path[s].append((node, side))
            heapq.heappush(heap, (na + nb, node, a + b))
            node += 1
        self.length = np.array([len(p) for p in path])
        self.offset = np.cumsum(self.length) - self.length
        flat = [x for p in path for x in reversed(p)]
        self.node = np.array([n * 0x9E3779B1 % (1 << 32) for n, _ in flat], np.uint32)
        self.side = np.array([b for _, b in flat], np.uint8)


def byte_counts(texts: DataFrame) -> np.ndarray:
    """How often each byte occurs in all texts, A-Z as a-z; 256 rows reach the driver."""

    def run(it):
        n = np.zeros(256, np.int64)
        for b in batches(it):
            for t in b["text"]:
                n += np.bincount(np.frombuffer(t.lower(), np.uint8), minlength=256)
        yield pa.RecordBatch.from_pydict({"b": np.arange(256), "n": n})

    out = np.zeros(256, np.int64)
    for r in texts.select("text").mapInArrow(run, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():
        out[r["b"]] = r["n"]
    return out


# States: (n0, n1) for n0 + n1 <= 8, then levels of the logit for more.
_SMALL = [(a, n - a) for n in range(9) for a in range(n + 1)]
_LEVELS = 256 - len(_SMALL)
_TOP = 9.0
STRETCH = np.array([np.log((b + 0.4) / (a + 0.4)) if a + b else 0.0 for a, b in _SMALL] + [(2 * i / (_LEVELS - 1) - 1) * _TOP for i in range(_LEVELS)], np.float32)
KNOWN = np.array([0 if not a + b else 1 if a + b < 3 else 2 for a, b in _SMALL] + [3] * _LEVELS, np.int64)
_INDEX = {s: i for i, s in enumerate(_SMALL)}
#: The state without one count of the bit.
LESS = np.array([[_INDEX.get((a - (bit == 0), b - (bit == 1)), _INDEX[a, b]) for a, b in _SMALL] + list(range(len(_SMALL), 256)) for bit in (0, 1)], np.uint8)
START = np.array([[0.15, 0.15, 0.25, 0.5, 0.0] if g else [0.5, 0.5, 0.0, 0.0, 0.0] for g in range(GATES)])


def states(n: np.ndarray) -> np.ndarray:
    """uint8 states of counts (slots x 2)."""
    total = n.sum(axis=1)
    small = np.zeros((9, 9), np.uint8)
    for (a, b), i in _INDEX.items():
        small[a, b] = i
    out = small[np.minimum(n[:, 0], 8), np.minimum(n[:, 1], 8)]
    big = total > 8
    logit = np.log((n[big, 1] + 0.4) / (n[big, 0] + 0.4))
    out[big] = len(_SMALL) + np.clip(np.rint((logit / _TOP + 1) / 2 * (_LEVELS - 1)), 0, _LEVELS - 1).astype(np.uint8)
    return out


class Spelled:
    """Decisions of (class, word) keys, in the order of class and word. What words of a class have in common at their beginning, up to
    HEAD bytes, is there once: a node is a byte after a beginning. A word is a run of `nodes`."""

    def __init__(self, code: Code, keys: list[tuple[int, bytes]]):
        text = np.frombuffer(b" ".join([w for _, w in keys]) + b" ", np.uint8)
        size = np.fromiter(map(len, map(itemgetter(1), keys)), np.int64, len(keys)) + 1
        cls = np.frombuffer(bytes(map(itemgetter(0), keys)), np.uint8)
        start = np.cumsum(size) - size
        head = np.zeros(len(keys), np.uint64)
        for j in range(HEAD):
            head = head << np.uint64(8) | np.where(j < size, text[np.minimum(start + j, len(text) - 1)], 0).astype(np.uint64)
        self.order = np.lexsort((head, cls))
        head, size, cls = head[self.order], size[self.order], cls[self.order]
        differs = head[1:] ^ head[:-1]
        common = np.zeros(len(keys), np.int64)
        for j in range(1, HEAD + 1):
            common[1:] += differs >> np.uint64(8 * (HEAD - j)) == 0
        common[1:] = np.where(cls[1:] == cls[:-1], np.minimum(common[1:], np.minimum(size[1:], size[:-1])), 0)
        self.code, self.cls, self.size, self.common = code, cls, size, common
        self.start = np.cumsum(size) - size
        self.text = text[np.repeat(start[self.order] - self.start, size) + np.arange(len(text))]
        own = np.cumsum(size - common) - size  # number of a word's node at 0, if it were its own
        self.nodes = (np.repeat(own - self.start, size) + np.arange(len(text))).astype(np.int32)
        for j in range(int(common.max())):
            first = np.maximum.accumulate(np.where(common <= j, np.arange(len(keys)), 0))
            has = np.flatnonzero(common > j)
            self.nodes[self.start[has] + j] = own[first[has]] + j
        fresh = np.arange(len(text)) - np.repeat(self.start + common, size) >= 0
        n = code.length[self.text[fresh]]
        number = np.int32 if n.sum() < 1 << 30 else np.int64
        self.n, self.first = n.astype(number), (np.cumsum(n) - n).astype(number)  # decisions of a node, and the first of them
        self.place = np.empty(len(keys), np.int64)
        self.place[self.order] = np.arange(len(keys))

    def times(self, times: np.ndarray) -> np.ndarray:
        """How often each node is met, from how often each key is."""
        return np.bincount(self.nodes, np.repeat(times[self.order], self.size), len(self.n))

    def slices(self):
        """For SLICE words at a time: the nodes' slice, the decisions' slice, their bits and their slots in each table."""
        power = np.full(int(self.size.max()), 0x9E3779B97F4A7C15, np.uint64)
        power[0] = 1
        np.cumprod(power, out=power)
        node = decision = 0
        for lo in range(0, len(self.size), SLICE):
            size, common = self.size[lo : lo + SLICE], self.common[lo : lo + SLICE]
            starts = self.start[lo : lo + SLICE] - self.start[lo]
            text = self.text[self.start[lo] : self.start[lo] + starts[-1] + size[-1]]
            at = np.arange(len(text)) - np.repeat(starts, size)
            value = (text.astype(np.uint64) + np.uint64(1)) * power[at]
            before = np.cumsum(value) - value
            fresh = np.flatnonzero(at >= np.repeat(common, size))
            of = np.repeat(np.arange(len(size)), size - common)
            whole = (before - np.repeat(before[starts], size))[fresh]
            at = at[fresh]
            back = np.zeros(len(at), np.uint64)
            for i in range(1, 4):
                prev = np.where(at < i, 1 if i == 1 else 0, text[np.maximum(fresh - i, 0)]).astype(np.uint64)
                back |= prev << np.uint64(8 * i)
            cls = self.cls[lo : lo + SLICE].astype(np.uint64)[of]
            near = (back & np.uint64(0xFFFF00)) * np.uint64(0x165667B19E3779F9) + (cls + np.uint64(3)) * np.uint64(0x8EBC6AF09C88C6E3)
            contexts = (back, near, whole * np.uint64(0xD6E8FEB86659FD93) + np.uint64(7), whole * np.uint64(0xA0761D6478BD642F) + (cls + np.uint64(11)) * np.uint64(0xE7037ED1A0B428DB))
            text = text[fresh]
            n = self.n[node : node + len(text)]
            which = np.repeat(self.code.offset[text] - np.cumsum(n) + n, n)
            which += np.arange(len(which))
            salt, bit = self.code.node[which], self.code.side[which]
            slots = []
            for c in contexts:
                c = (c ^ (c >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                h = np.repeat((c >> np.uint64(32)).astype(np.uint32), n)
                h ^= salt
                h ^= h >> np.uint32(15)
                h *= np.uint32(0x85EBCA6B)
                h >>= np.uint32(32 - BITS)
                slots.append(h.astype(np.int64))
            yield slice(node, node + len(text)), slice(decision, decision + len(bit)), bit, slots
            node += len(text)
            decision += len(bit)


class Numbers(dict):
    """Numbers of words of one class, given as they come; keys lists (class, word) by number."""

    def __init__(self, cls: int, keys: list[tuple[int, bytes]]):
        super().__init__()
        self.cls, self.keys_ = cls, keys

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self.keys_)
        self.keys_.append((self.cls, word))
        return k


def by_class(words: list[bytes], ascii_only: bool, tables: list[dict]):
    """tables[class][word] of each word; the class is that of the last letter outside ASCII before it, 0: none yet."""
    if ascii_only:
        return map(tables[0].__getitem__, words)
    out, start, now, get = [], 0, 0, tables[0].__getitem__
    for i, w in enumerate(words):
        if not w.isascii():
            c = _classes.get(w) or _class_of(w)
            if c != now:
                out.extend(map(get, words[start : i + 1]))
                start, now, get = i + 1, c, tables[c].__getitem__
    out.extend(map(get, words[start:]))
    return out


_classes: dict[bytes, int] = {}


def _class_of(word: bytes) -> int:
    """The class of the last letter outside ASCII in a word; a bounded number of words is remembered."""
    last = next(c for c in reversed(word.decode()) if c > "\x7f")
    c = 1 + ord(last) % (CLASSES - 1)
    if len(_classes) < 200_000:
        _classes[word] = c
    return c


def _edges() -> np.ndarray:
    """First number of words in each bucket."""
    return np.array([0, 1, 2, 3] + sorted({int(np.ceil(2 ** ((b + 4) / 4) - 1e-9)) for b in range(4, 160)}))


EDGES = _edges()


def exposures(n_words: np.ndarray) -> np.ndarray:
    """For texts of these lengths: end flags seen in each range of EDGES."""
    hi = np.append(EDGES[1:], 1 << 62)
    return np.clip(n_words[:, None] + 1 - EDGES, 0, hi - EDGES)


class Words:
    """The words of texts, end to end: their hashes, the class before each, and its number in `plain`, the distinct words by hash; and the
    bounds of the texts. Equal hashes of different words are told apart."""

    def __init__(self, texts: list[bytes]):
        text = b" ".join(texts).lower() + b" " * 8  # so eight bytes can be read at each place
        flat = np.frombuffer(text, np.uint8)
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.hash, self.at = word_hashes(flat, offsets)
        blank = np.append(np.uint8(32), flat)
        blank = (blank == 32) | (blank - np.uint8(9) < 5)
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        start, end = edges[::2], edges[1::2]
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.at))
        order = np.argsort(self.hash)
        by = self.hash[order]
        new = np.append(True, by[1:] != by[:-1])[: len(by)]
        self.number = np.empty(len(by), np.int64)
        self.number[order] = np.cumsum(new) - 1
        some = order[new]
        size = end - start
        runs = (slice(lo, lo + RUN) for lo in range(0, len(size), RUN))
        if all(_alike(flat, start[k], size[k], start[some[self.number[k]]], size[some[self.number[k]]]) for k in runs):
            self.plain = [text[i:j] for i, j in zip(start[some].tolist(), end[some].tolist(), strict=True)]
            self.plain_hash = by[new]
        else:
            words = list(zip(self.hash.tolist(), text.split(), strict=True))
            distinct = sorted(set(words))
            place = {w: i for i, w in enumerate(distinct)}
            self.number = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
            self.plain, self.plain_hash = [w for _, w in distinct], np.array([h for h, _ in distinct], np.uint64)
        self.cls = _classes_before(flat, start, offsets[self.text])

    def types(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct 64 * number + class, and which of them each word is."""
        key = self.number << 6 | self.cls
        if len(key) >= 1 << 26:
            return np.unique(key, return_inverse=True)
        packed = np.sort(key << 26 | np.arange(len(key)))  # faster than an order
        key, at = packed >> 26, packed & ((1 << 26) - 1)
        new = np.append(True, key[1:] != key[:-1])[: len(key)]
        which = np.empty(len(key), np.int64)
        which[at] = np.cumsum(new) - 1
        return key[new], which

    def bounds(self, parts: int) -> np.ndarray:
        """Of the parts of the hashes, in `plain`."""
        return np.searchsorted(_part(self.plain_hash, parts), np.arange(parts + 1, dtype=np.uint64))


def _alike(flat: np.ndarray, a: np.ndarray, size: np.ndarray, b: np.ndarray, size_b: np.ndarray) -> bool:
    """Whether the words that begin at a and at b are equal, all of them."""
    if not np.array_equal(size, size_b):
        return False
    at = np.flatnonzero(a != b)
    a, b, size = a[at], b[at], size[at]
    eight = np.ndarray((len(flat) - 7,), "<u8", flat, strides=(1,))
    for j in range(0, 64, 8):  # a word's last bytes alone count
        if not len(a):
            return True
        differ = eight[a + j] ^ eight[b + j]
        differ <<= (8 * np.maximum(j + 8 - size, 0)).astype(np.uint64)
        if differ.any():
            return False
        more = size > j + 8
        a, b, size = a[more], b[more], size[more]
    return all(np.array_equal(flat[i : i + n], flat[j : j + n]) for i, j, n in zip(a.tolist(), b.tolist(), size.tolist(), strict=True))


def _classes_before(flat: np.ndarray, start: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The class of words at these places: of the last letter outside ASCII before them in their text, which begins there; 0: none."""
    lead = np.flatnonzero(flat >= 0xC0)
    if not len(lead):
        return np.zeros(len(start), np.int64)
    b = [flat[np.minimum(lead + k, len(flat) - 1)].astype(np.int64) & 0x3F for k in range(4)]
    two, three = (b[0] & 0x1F) << 6 | b[1], (b[0] & 0x0F) << 12 | b[1] << 6 | b[2]
    letter = np.where(flat[lead] < 0xE0, two, np.where(flat[lead] < 0xF0, three, (b[0] & 7) << 18 | b[1] << 12 | b[2] << 6 | b[3]))
    last = np.searchsorted(lead, start) - 1
    return np.where((last >= 0) & (lead[last] >= begin), 1 + letter[last] % (CLASSES - 1), 0)


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return (h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)


def _by_part(h: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the hashes by (part, hash), and the bounds of the parts."""
    part = _part(h, parts)
    order = np.lexsort((h, part))
    return order, np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))


def _chunks(it):
    """(chunk, rows) of sorted batches; rows are lists of columns of one chunk."""
    return ((k, rows) for (k,), rows in _keyed(it, 1))


def _keyed(it, width: int):
    """(key, rows) of batches sorted by the key, the first columns; rows are lists of columns."""
    key, held = None, None
    for b in batches(it):
        names = list(b)
        for row in zip(*b.values(), strict=True):
            k = row[:width]
            if k != key:
                if held:
                    yield key, held
                key, held = k, {n: [] for n in names}
            for n, v in zip(names, row, strict=True):
                held[n].append(v)
    if held:
        yield key, held


def anchors(words: Words, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts, in the order of (part, anchor): the anchor's hash, its text, and the place of the word after it; the bounds of the parts; and the low
    32 bits of the hashes of all words, AHEAD zeros after each text."""
    h, of = words.hash, words.text
    low = np.zeros(len(h) + AHEAD * (len(words.at) - 1), np.uint32)
    place = np.arange(len(h)) + AHEAD * of
    low[place] = h | np.uint64(1)
    last = len(h) - ANCHOR
    if last <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(parts + 1, np.int64), low
    x = h[:last] * np.uint64(0x9E3779B97F4A7C15) + h[1 : last + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2 : last + 2] * np.uint64(0x165667B19E3779F9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    hit = np.flatnonzero((x & np.uint64(ANCHOR_EVERY - 1) == 0) & (of[:last] == of[ANCHOR:]))
    order, bounds = _by_part(x[hit], parts)
    hit = hit[order]
    return x[hit], of[hit], place[hit + ANCHOR], bounds, low


def count(rows: DataFrame, parts: int, cuts: int) -> DataFrame:
    """(kind, part, chunk, blob): kind 0: the words of a chunk in a part of their hashes, with classes and training counts; kind 1: its anchors in a
    part; kind 2: numbers of training texts by length. A part is cut in `cuts` finer ones, whose blobs lie in a row."""

    def run(it):
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        ends, seen = np.zeros(len(EDGES), np.int64), np.zeros(len(EDGES), np.int64)
        for chunk, rows in _chunks(it):
            words = Words(rows["text"])
            train = ~np.array(rows["held_out"], bool)
            if train.any():
                n = np.diff(words.at)[train]
                ends += np.bincount(np.searchsorted(EDGES, n, "right") - 1, minlength=len(EDGES))
                seen += exposures(n).sum(axis=0)
            types, which = words.types()
            n = np.bincount(which[train[words.text]], minlength=len(types))
            types, n = types[n > 0], n[n > 0].astype(np.uint32)
            at, cls = types >> 6, (types & 63).astype(np.uint8)
            plain, bounds = words.plain, words.bounds(parts * cuts)
            first = np.searchsorted(at, bounds)

            def spelled(q: int) -> bytes:
                k = slice(first[q], first[q + 1])
                head = np.array([bounds[q + 1] - bounds[q], first[q + 1] - first[q]], np.int64)
                return pack(head.tobytes() + (at[k] - bounds[q]).astype(np.uint32).tobytes() + n[k].tobytes() + cls[k].tobytes() + b" ".join(plain[bounds[q] : bounds[q + 1]]))

            yield from _rows(0, chunk, bounds, cuts, spelled)
            x, of, place, bounds, low = anchors(words, parts * cuts)

            def met(q: int) -> bytes:
                k = slice(bounds[q], bounds[q + 1])
                return pack(x[k].tobytes() + of[k].astype(np.uint32).tobytes() + low[place[k][:, None] + np.arange(AHEAD)].tobytes() + train[of[k]].tobytes())

            yield from _rows(1, chunk, bounds, cuts, met)
            del words, which, types, n, at, cls, plain, x, of, place, low
            released()
        if seen.any():
            yield _row(2, 0, TaskContext.get().partitionId(), np.stack([ends, seen]).tobytes())

    return rows.mapInArrow(run, "kind int, part int, chunk long, blob binary")


def _row(kind: int, part: int, chunk: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([chunk], pa.int64()), pa.array([blob], pa.binary())], ["kind", "part", "chunk", "blob"])


def _rows(kind: int, chunk: int, bounds: np.ndarray, cuts: int, blob):
    """A row for each part that has anything: the lengths of its finer parts' blobs, and these."""
    for p in range((len(bounds) - 1) // cuts):
        own = range(p * cuts, (p + 1) * cuts)
        if bounds[own[-1] + 1] > bounds[own[0]]:
            blobs = [blob(q) if bounds[q + 1] > bounds[q] else b"" for q in own]
            yield _row(kind, p, chunk, np.array([len(b) for b in blobs], np.int64).tobytes() + b"".join(blobs))


def _finer(blob: bytes, cuts: int, k: int) -> bytes:
    """The k-th of the blobs that _rows() put in one."""
    ends = np.cumsum(np.frombuffer(blob, np.int64, cuts)) + 8 * cuts
    return blob[ends[k - 1] if k else 8 * cuts : ends[k]]


def _listing(keys: list[tuple[int, bytes]], times: np.ndarray) -> bytes:
    return np.int64(len(keys)).tobytes() + times.tobytes() + bytes(c for c, _ in keys) + b" ".join([w for _, w in keys])


def _listed(blob: bytes) -> tuple[list[tuple[int, bytes]], np.ndarray]:
    """(class, word) and counts that _listing() put down; words hold no blanks."""
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    return list(zip(blob[8 + 8 * n : 8 + 9 * n], blob[8 + 9 * n :].split(b" "), strict=True)), np.frombuffer(blob, np.int64, n, 8)


class Tables:
    """Counts of decisions in all contexts, in 32 bits. They are handed on before a sum could be more than these hold, and begin anew."""

    ROOM = (1 << 32) - 1

    def __init__(self) -> None:
        self.counts, self.sum = [np.zeros(2 * SLOTS, np.uint32) for _ in range(CONTEXTS)], 0

    def add(self, slots: list[np.ndarray], bit: np.ndarray, weight: np.ndarray):
        """weight: whole numbers of any size. Yields rows where the tables are full."""
        while (total := int(weight.sum())) > 0:
            now = weight if total <= self.ROOM else np.minimum(weight, self.ROOM // len(weight))
            more = int(now.sum())
            if self.sum + more > self.ROOM:
                yield from self.rows()
            self.sum += more
            w = now.astype(np.uint32)
            for t, s in zip(self.counts, slots, strict=True):
                np.add.at(t, 2 * s + bit, w)
            if more == total:
                return
            weight = weight - now

    def rows(self):
        import zstandard

        pack, task = zstandard.ZstdCompressor(level=1).compress, TaskContext.get()
        for k, t in enumerate(self.counts):
            for p in range(SLOTS // PART):
                x = t[2 * p * PART : 2 * (p + 1) * PART]
                if x.any():
                    yield _row(4, k * (SLOTS // PART) + p, task.partitionId() if task else 0, pack(x.tobytes()))
            t[:] = 0
        self.sum = 0


def recalled(x: np.ndarray, doc: np.ndarray, train: np.ndarray) -> np.ndarray:
    """For each anchor the row whose following words are predicted, -1: none. That is the first in training with the same hash in another document."""
    order = np.lexsort((doc, ~train, x))
    xs, ds, ts = x[order], doc[order], train[order]
    starts = np.flatnonzero(np.r_[True, xs[1:] != xs[:-1]])
    group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(xs)]))
    first = starts[group]
    other = np.where(ts & (ds != ds[first]), np.arange(len(xs)), len(xs))
    second = np.minimum.reduceat(other, starts)[group]
    got = np.where(~ts[first], len(xs), np.where(ds != ds[first], first, second))
    out = np.full(len(x), -1)
    has = got < len(xs)
    out[order[has]] = order[got[has]]
    return out


def merged(code: Code, counted: DataFrame, tasks: int, cuts: int) -> DataFrame:
    """(kind, part, chunk, blob): kind 0: counts over all chunks of a chunk's words in this finer part, in their order; kind 1: the chunk's anchors
    that are recalled, and the words after them; kind 2: the part's totals; kind 3: all classes, words and counts of the part; kind 4: counts of
    them in a part of a predictor's table. Only one finer part is unpacked at a time."""

    def run(it):
        import zstandard

        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        tables = None
        for (part, kind), rows in _keyed(it, 2):
            for k in range(cuts):
                fine = part * cuts + k
                held = [(c, _finer(b, cuts, k)) for c, b in zip(rows["chunk"], rows["blob"], strict=True)]
                chunks, got = [c for c, b in held if b], [unpack(b) for _, b in held if b]
                del held
                if not got:
                    continue
                if kind == 1:
                    yield from _recall(fine, chunks, got, pack)
                    continue
                types, n, plain, answers = _sums(chunks, got)
                del got
                for chunk, total in answers:
                    yield _row(0, fine, chunk, pack(total.tobytes()))
                total = np.bincount(types >> 6, n, len(plain)).astype(np.int64)
                yield _row(2, fine, -1, np.array([total.sum(), (total > 0).sum()]).tobytes())
                del answers, total
                released()
                for lo in range(0, len(types), LISTED):
                    keys = [(int(t) & 63, plain[int(t) >> 6]) for t in types[lo : lo + LISTED]]
                    yield _row(3, fine, lo, pack(_listing(keys, n[lo : lo + LISTED])))
                    tables = tables or Tables()
                    words = Spelled(code, keys)
                    met = words.times(n[lo : lo + LISTED]).astype(np.int64)
                    for nodes, _, bit, slots in words.slices():
                        yield from tables.add(slots, bit, np.repeat(met[nodes], words.n[nodes]))
        if tables:
            yield from tables.rows()

    rows = counted.where("kind < 2").select("part", "kind", "chunk", "blob").repartitionById(tasks, (F.col("part") % tasks).cast("int")).sortWithinPartitions("part", "kind", "chunk")
    return cut(rows.mapInArrow(run, "kind int, part int, chunk long, blob binary"), "merged")


def _recall(part: int, chunks: list[int], got: list[bytes], pack):
    """Kind 1 of merged(), of a finer part's anchors."""
    size = np.array([len(g) // (13 + 4 * AHEAD) for g in got])
    x = np.concatenate([np.frombuffer(g, np.uint64, n) for g, n in zip(got, size, strict=True)])
    doc = np.concatenate([np.frombuffer(g, np.uint32, n, 8 * n) + (np.uint64(c) << np.uint64(32)) for g, n, c in zip(got, size, chunks, strict=True)])
    ahead = np.concatenate([np.frombuffer(g, np.uint32, AHEAD * n, 12 * n) for g, n in zip(got, size, strict=True)]).reshape(-1, AHEAD)
    train = np.concatenate([np.frombuffer(g, bool, n, (12 + 4 * AHEAD) * n) for g, n in zip(got, size, strict=True)])
    source = recalled(x, doc, train)
    lo = 0
    for chunk, n in zip(chunks, size.tolist(), strict=True):
        at = np.flatnonzero(source[lo : lo + n] >= 0)
        if len(at):
            yield _row(1, part, chunk, pack(at.astype(np.uint32).tobytes() + ahead[source[lo + at]].tobytes()))
        lo += n


def _sums(chunks: list[int], got: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes], list[tuple[int, np.ndarray]]]:
    """(class, word) types of a finer part, their counts over all chunks, the words; and for each chunk the counts of its own words, in their order."""
    heads = [np.frombuffer(g, np.int64, 2) for g in got]
    number: dict[bytes, int] = {}
    at, types, n = [], [], []
    for g, (size, k) in zip(got, heads, strict=True):
        mine = np.fromiter((number.setdefault(w, len(number)) for w in g[16 + 9 * int(k) :].split(b" ")), np.int64, int(size))
        at.append(mine)
        types.append((mine[np.frombuffer(g, np.uint32, k, 16)] << 6) + np.frombuffer(g, np.uint8, k, 16 + 8 * k))
        n.append(np.frombuffer(g, np.uint32, k, 16 + 4 * k))
    types, back = np.unique(np.concatenate(types), return_inverse=True)
    n = np.bincount(back, np.concatenate(n), len(types)).astype(np.int64)
    total = np.bincount(types >> 6, n, len(number)).astype(np.int64)
    return types, n, list(number), [(c, total[mine]) for c, mine in zip(chunks, at, strict=True)]


def merged_tables(told: DataFrame) -> np.ndarray:
    """uint8 states, contexts x slots: the parts of all tasks added up in a stream; a fixed 2^BITS bytes a context."""

    def run(it):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        part, total = None, None
        for b in batches(it, 64):
            for p, blob in zip(b["part"], b["blob"], strict=True):
                if p != part:
                    if total is not None:
                        yield _row(1, part, 0, states(total.reshape(-1, 2)).tobytes())
                    part, total = p, np.zeros(2 * PART, np.int64)
                total += np.frombuffer(unpack(blob), np.uint32)
        if total is not None:
            yield _row(1, part, 0, states(total.reshape(-1, 2)).tobytes())

    rows = told.where("kind = 4").select("part", "blob").repartition("part").sortWithinPartitions("part")
    out = np.zeros((CONTEXTS, SLOTS), np.uint8)
    flat = out.reshape(-1, PART)
    for r in rows.mapInArrow(run, "kind int, part int, chunk long, blob binary").select("part", "blob").toLocalIterator():
        flat[r["part"]] = np.frombuffer(r["blob"], np.uint8)
    return out


def known(state: list[np.ndarray]) -> np.ndarray:
    """The gate: how well the two longest contexts are known."""
    return 4 * KNOWN[state[-2]] + KNOWN[state[-1]]


class Logits:
    """Signed mixed logits and signed longest-context logits, in pairs, of the decisions of all keys."""

    def __init__(self, code: Code, tables: np.ndarray, weights: np.ndarray, keys: list[tuple[int, bytes]]):
        self.words = words = Spelled(code, keys)
        product = [np.concatenate([w * STRETCH for w in weights[:, k].astype(np.float32)]) for k in range(CONTEXTS)]
        both = np.repeat(np.arange(256), 256), np.tile(np.arange(256), 256)
        gate = known(both)
        last_two = weights[:, CONTEXTS].astype(np.float32)[gate] + product[-2][(gate << 8) + both[0]] + product[-1][(gate << 8) + both[1]]
        gate = (gate << 8).astype(np.int32)
        flat = np.empty((int(words.n.sum()), 2), np.float32)
        for _, at, bit, slots in words.slices():
            state = [t[s] for t, s in zip(tables, slots, strict=True)]
            two = state[-2].astype(np.int64)
            two <<= 8
            two |= state[-1]
            z, g = last_two[two], gate[two]
            for p, st in zip(product[:-2], state[:-2], strict=True):
                z += p[g + st]
            sign = SIGN[bit]
            np.multiply(z, sign, out=flat[at, 0])
            np.multiply(STRETCH[state[-1]], sign, out=flat[at, 1])
        self.pairs = flat.reshape(-1).view(np.complex64)

    def of(self, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of these keys: decisions a word, and the two logits of each decision."""
        words = self.words
        used = words.place[used]
        size = words.size[used]
        ends = np.cumsum(size)
        nodes = words.nodes[np.repeat(words.start[used] - ends + size, size) + np.arange(ends[-1])]
        n = words.n[nodes]
        number = n.dtype if n.sum() < 1 << 30 else np.int64
        at = np.repeat(words.first[nodes] - np.cumsum(n, dtype=number) + n, n)
        at += np.arange(len(at), dtype=number)
        got = self.pairs.take(at, mode="clip")
        return np.add.reduceat(n, ends - size), got.real, got.imag


def mixed(code: Code, tables: np.ndarray, weights: np.ndarray, keys: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words: decisions a word, and the signed mixed logit and signed longest-context logit of each decision."""
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.float32)
    return Logits(code, tables, weights, keys).of(np.arange(len(keys)))


SIGN = np.array([-1, 1], np.float32)


def train_gates(code: Code, told: DataFrame, tables) -> np.ndarray:
    """Weights (gates x contexts and a bias): online steps in each task from the same start, averaged by the decisions of each gate.
    A step has words from all of its part, frequent and rare ones."""

    def run(it):
        import zstandard

        w, used = START.copy(), np.zeros(GATES)
        for blob in (x for b in batches(it) for x in b["blob"]):
            keys, count_of = _listed(zstandard.ZstdDecompressor().decompress(blob))
            order = np.random.default_rng(0).permutation(len(keys))
            keys, count_of = [keys[i] for i in order.tolist()], count_of[order]
            for lo in range(0, len(keys), 1000):
                words = Spelled(code, keys[lo : lo + 1000])
                ((_, _, bit, slots),) = words.slices()
                state = [LESS[bit, t[s]] for t, s in zip(tables.value, slots, strict=True)]  # without the decision's own count
                gate, sign = known(state), SIGN[bit]
                times = np.repeat(words.times(count_of[lo : lo + 1000]).astype(np.float32), words.n)
                x = [STRETCH[st] for st in state]
                now = w.astype(np.float32)
                z = now[gate, CONTEXTS]
                for k, v in enumerate(x):
                    z += now[gate, k] * v
                miss = times * sign / (1 + np.exp(np.clip(sign * z, -30, 30)))
                weight = np.bincount(gate, times, GATES)
                step = np.stack([*(np.bincount(gate, miss * v, GATES) for v in x), np.bincount(gate, miss, GATES)], axis=1)
                w += 0.05 * step / np.maximum(weight, 200.0)[:, None]
                used += weight
        yield pa.RecordBatch.from_pydict({"gate": np.repeat(np.arange(GATES), CONTEXTS + 1), "k": np.tile(np.arange(CONTEXTS + 1), GATES), "w": (w * used[:, None]).ravel(), "n": np.repeat(used, CONTEXTS + 1)})

    out = START.copy()
    rows = told.where("kind = 3").select("part", "chunk", "blob").repartition("part", "chunk").sortWithinPartitions("part", "chunk").select("blob")
    for r in rows.mapInArrow(run, "gate long, k long, w double, n double").groupBy("gate", "k").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).collect():
        if r["n"]:
            out[r["gate"], r["k"]] = r["w"] / r["n"]
    return out


def refine(z: np.ndarray, x: np.ndarray, first: np.ndarray, n: np.ndarray, docs: list[np.ndarray], rate: float = 0.02) -> np.ndarray:
    """ln probabilities of documents, lists of word numbers, from the words' signed mixed logits z and signed longest-context logits x.
    All documents go through their blocks in step, each with weights of its own."""
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    sizes = np.array([len(docs[i]) for i in order], np.int64)
    delta, out = np.zeros((len(docs), 2), np.float32), np.zeros(len(docs))
    if not sizes.any():
        return out
    both = np.empty((len(z), 2), np.float32)
    both[:, 0], both[:, 1] = z, x
    large = 1.5 * max(z.max(), -z.min()) + 0.5 * max(x.max(), -x.min()) > 60
    pairs = both.reshape(-1).view(np.complex64)  # a pair is looked up at once
    number = np.int32 if len(z) < 1 << 30 else np.int64
    first, n = first.astype(number), n.astype(number)
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    block = place // BLOCK * len(docs) + np.repeat(np.arange(len(docs)), sizes)
    by = np.argsort(block, kind="stable")
    words, block = np.concatenate([docs[i] for i in order])[by], block[by]
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])  # of blocks: a step's follow each other, by document
    step = block[starts] // len(docs)
    first, size = first[words], n[words]
    bits = np.add.reduceat(size, starts)
    bounds, lanes = np.append(starts, len(words)), np.cumsum(np.bincount(step))
    line = np.zeros(0, number)
    lo = 0
    for hi in lanes.tolist():
        k, m = slice(bounds[lo], bounds[hi]), hi - lo
        here = bits[lo:hi]
        lo = hi
        ends = np.cumsum(size[k], dtype=number)
        total = int(ends[-1])
        if total > len(line):
            line = np.arange(total + total // 4, dtype=number)
            room, got_room = np.empty((4, len(line)), np.float32), np.empty(len(line), np.complex64)
        at = np.repeat(first[k] - ends + size[k], size[k])
        at += line[:total]
        got = pairs.take(at, out=got_room[:total], mode="clip")
        zz, xx, e, more = room[:, :total]
        zz[:], xx[:] = got.real, got.imag
        d = delta[:m]
        np.multiply(np.repeat(-1 - d[:, 0], here), zz, out=e)
        np.multiply(np.repeat(d[:, 1], here), xx, out=more)
        e -= more
        if large:
            np.minimum(e, 60, out=e)
        np.exp(e, out=e)
        np.add(e, 1, out=more)
        e /= more  # the probability missed
        begin = np.cumsum(here) - here
        out[:m] -= np.add.reduceat(np.log(more, out=more), begin)
        zz *= e
        xx *= e
        grad = np.stack([np.add.reduceat(zz, begin), np.add.reduceat(xx, begin)], axis=1)
        delta[:m] = np.clip(d + rate * grad / here[:, None] ** 0.5, -0.5, 0.5)
    back = np.empty(len(docs))
    back[order] = out
    return back


def groups(sizes: list[int]):
    """Bounds of runs of at most GROUP documents and about GROUP_WORDS words (one document at least)."""
    lo = words = 0
    for k, n in enumerate(sizes):
        if k > lo and (k - lo == GROUP or words + n > GROUP_WORDS):
            yield lo, k
            lo, words = k, 0
        words += n
    if sizes:
        yield lo, len(sizes)


def refined(code: Code, tables: np.ndarray, weights: np.ndarray, keys: list[tuple[int, bytes]], docs: list[np.ndarray]) -> np.ndarray:
    """refine() of documents, numbers of keys. The logits of the words that are in them are made once; documents of about the same
    length are scored together, with just their words laid out."""
    out = np.zeros(len(docs))
    used, docs = _numbered(docs, len(keys))
    if len(used):
        logits = Logits(code, tables, weights, [keys[i] for i in used.tolist()])
        sizes = np.array([len(d) for d in docs])
        order = np.argsort(sizes, kind="stable")
        for lo, hi in groups(sizes[order].tolist()):
            some, local = _numbered([docs[i] for i in order[lo:hi]], len(used))
            if len(some):
                n, z, x = logits.of(some)
                out[order[lo:hi]] = refine(z, x, np.cumsum(n) - n, n, local)
    return out


def _numbered(docs: list[np.ndarray], n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which of n numbers are in the documents, and the documents with the numbers of these."""
    words = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    has = np.zeros(n, bool)
    has[words] = True
    return np.flatnonzero(has), np.split((np.cumsum(has) - 1)[words], np.cumsum([len(d) for d in docs])[:-1]) if docs else []


def foretold(words: Words, matches: list[tuple[int, bytes]], parts: int) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """By text with any: which of its words the match model foretells; and the ln probability of all decisions whether it does. A later anchor
    counts before an earlier one."""
    ln = np.zeros(len(words.at) - 1)
    if not matches:
        return {}, ln
    _, of, place, bounds, low = anchors(words, parts)
    at, ahead = [], []
    for p, blob in matches:
        n = len(blob) // (4 + 4 * AHEAD)
        at.append(bounds[p] + np.frombuffer(blob, np.uint32, n))
        ahead.append(np.frombuffer(blob, np.uint32, AHEAD * n, 4 * n).reshape(-1, AHEAD))
    at, ahead = np.concatenate(at), np.concatenate(ahead)
    by = np.argsort(place[at])
    at, ahead = at[by], ahead[by]
    want = np.zeros(len(low), np.uint32)
    for k in range(AHEAD):  # nearer anchors are written last, word by word
        want[place[at] + AHEAD - 1 - k] = ahead[:, AHEAD - 1 - k]
    sizes = np.diff(words.at)
    begin = np.cumsum(sizes + AHEAD) - sizes - AHEAD
    hits = {}
    for k in np.unique(of[at]).tolist():
        mine = slice(begin[k], begin[k] + sizes[k])
        asked = want[mine] != 0
        hit = asked & (want[mine] == low[mine])
        h = hit[asked]
        before = np.cumsum(h) - h
        p = (before + 0.4) / (np.arange(len(h)) + 0.8)
        ln[k] = np.log(np.where(h, p, 1 - p)).sum()
        hits[k] = hit
    return hits, ln


def score(spark: SparkSession, docs: DataFrame, held_out) -> DataFrame:
    """Contract columns and bits_per_byte of every document; held_out: a condition on docs that leaves a document out of training."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), held_out.alias("held_out"))
    by_byte = byte_counts(texts)
    size = int(by_byte.sum())
    by_byte[32] += by_byte[9:14].sum()
    by_byte[9:14] = 0
    code = Code(by_byte)
    n_chunks = max(size // CHUNK_BYTES, min(8, size // (3 << 20))) + 1
    parts = 2 * math.isqrt(n_chunks) + 1  # so the blobs of (chunk, part) grow more slowly than the square of the corpus
    cuts = math.isqrt(n_chunks) // CUT + 1  # and what is unpacked at a time doesn't grow
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks))
    rows = texts.withColumn("chunk", chunk)
    counted = cut(count(rows.select("chunk", "text", "held_out").repartition(n_chunks, "chunk").sortWithinPartitions("chunk"), parts, cuts), "counted")
    lengths = [np.frombuffer(r["blob"], np.int64).reshape(2, -1) for r in counted.where("kind = 2").select("blob").collect()]  # a row a task
    told = merged(code, counted, max(1, parts // 2), cuts)
    drop(counted)
    totals = [np.frombuffer(r["blob"], np.int64) for r in told.where("kind = 2").select("blob").collect()]  # two numbers a part
    ends, seen = sum(lengths, np.zeros((2, len(EDGES)), np.int64))
    n_end = int(ends.sum())
    n_train = int(sum(t[0] for t in totals)) + n_end
    n_types = int(sum(t[1] for t in totals)) + (n_end > 0)
    hazard = (ends + 0.05) / (seen + 0.1)
    tables = spark.sparkContext.broadcast(merged_tables(told))
    weights = train_gates(code, told, tables)
    log_stay, log_end = np.log1p(-hazard), np.log(hazard)
    floor = np.log10(n_train + 0.1 * (n_types + 1)) if n_train else 0.0

    def run(it):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for chunk, rows in _chunks(it):
            blobs = [(p, unpack(b)) for p, b, k in zip(rows["part"], rows["blob"], rows["kind"], strict=True) if k == 0]
            matches = [(p, unpack(b)) for p, b, k in zip(rows["part"], rows["blob"], rows["kind"], strict=True) if k == 1]
            held = [i for i, k in enumerate(rows["kind"]) if k is None]
            words = Words([rows["text"][i] for i in held])
            types, which = words.types()
            ids = np.split(which, words.at[1:-1])
            keys = [(c, words.plain[w]) for c, w in zip((types & 63).tolist(), (types >> 6).tolist(), strict=True)]
            times = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(b, np.int64) for _, b in sorted(blobs, key=lambda x: x[0]))])[types >> 6]
            width = np.fromiter(map(len, map(itemgetter(1), keys)), np.int64, len(keys)) + 1
            log_c, is_known = np.log10(times + 0.1), (times > 0).astype(np.int64)
            hits, ln_of = foretold(words, matches, parts * cuts)
            del words, which, types, times, blobs, matches
            released()
            ln_of += refined(code, tables.value, weights, keys, [w if k not in hits else w[~hits[k]] for k, w in enumerate(ids)])
            del keys
            released()
            for lo, hi in groups([len(w) for w in ids]):
                part, of = held[lo:hi], ids[lo:hi]
                ln = ln_of[lo:hi]
                m = np.array([len(w) for w in of])
                flags = exposures(m)
                last = np.searchsorted(EDGES, m, "right") - 1
                stay = flags.copy()
                stay[np.arange(len(m)), last] -= 1
                ln += stay @ log_stay + log_end[last]
                base = [float(log_c[w].sum()) + float(np.log10(n_end + 0.1)) - (len(w) + 1) * floor for w in of]
                n_known = [int(is_known[w].sum()) + (n_end > 0) for w in of]
                size = np.array([max(1, int(width[w].sum())) for w in of])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([rows["doc_id"][i] for i in part], pa.int64()),
                        pa.array([rows["held_out"][i] for i in part], pa.bool_()),
                        pa.array(m + 1, pa.int64()),
                        pa.array(n_known, pa.int64()),
                        pa.array([n_train] * len(part), pa.int64()),
                        pa.array(base, pa.float64()),
                        pa.array(ln / LN10, pa.float64()),
                        pa.array(-ln / np.log(2) / size, pa.float64()),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"],
                )

    none = F.lit(None)
    ask = told.where("kind < 2").select("chunk", "kind", "part", "blob", none.cast("long").alias("doc_id"), none.cast("binary").alias("text"), none.cast("boolean").alias("held_out"))
    asked = rows.select("chunk", none.cast("int").alias("kind"), none.cast("int").alias("part"), none.cast("binary").alias("blob"), "doc_id", "text", "held_out").unionByName(ask)
    ordered = asked.repartition(n_chunks, "chunk").sortWithinPartitions("chunk")
    return ordered.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")


def op1_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(spark, docs, crc_mod(docs["doc_id"], 10) == 0)
