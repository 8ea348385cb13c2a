"""Quality verdicts: gradient-boosted trees over document statistics, scored as flat numpy node arrays.

The trees are fitted on the driver to the `quality` labels of at most `max_rows` labelled documents, those with the least
hashes of their ids; everything else is computed for every whole text. Chosen features are constrained: the score never rises
with the share of symbols, of repeated lines or of repeated words.

Null text: no words, base_failed. Null doc_id: scored, never a training row. Repeated rows: a row each. No labels, or labels of
one kind: the verdict is the base rule alone. Empty table: no rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, table, text_bytes

SPACES = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "upper", "digits", "marks", "bare", "line_words", "top_word", "raised")
#: Direction in which the score may move with a feature; 0: either.
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeats": -1, "raised": -1}
EDGE = b".,;:!?\"'()"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    total, end = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def statistics(b: bytes, raised: frozenset[bytes] = frozenset()) -> tuple[list[int], list[float]]:
    """The base counts and the features of one text."""
    words = b.split()
    n = len(words)
    bare = b.translate(None, SPACES)
    chars = len(bare.decode())
    symbols = len(b) - len(b.translate(None, SYMBOLS))
    lines = [x for x in b.split(b"\n") if x.strip(SPACES)]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    base = [n, chars, symbols, dup, repeat]
    if not n:
        return base, [0.0] * len(FEATURES)
    size = len(bare)
    counts = Counter(words)
    no_letters = sum(c for w, c in counts.items() if not any(map(_letter, w)))
    return base, [
        float(np.log1p(n)), chars / n, symbols / n, dup / len(lines), repeat / n, len(counts) / n,
        (size - len(bare.translate(None, UPPER))) / size, (size - len(bare.translate(None, DIGITS))) / size, (size - len(bare.translate(None, MARKS))) / n,
        no_letters / n, n / len(lines), max(counts.values()) / n, sum(c for w, c in counts.items() if w.lower().strip(EDGE) in raised) / n if raised else 0.0,
    ]


UPPER, DIGITS, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?"
_letter = [(c >= 128) or chr(c).isalpha() for c in range(256)].__getitem__


@dataclass
class Trees:
    """All trees' nodes in flat arrays; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, least: int = 10, l2: float = 1.0) -> Trees | None:
    """Boosted trees on the logistic loss, from histograms. Splits that would break a constraint are not made, and the children's
    values are held on either side of their middle, so that constraints hold across levels."""
    if len(y) < 2 * least or y.min() == y.max():
        return None
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    sign = [MONOTONE.get(f, 0) for f in FEATURES]
    base = float(np.log(y.mean() / (1 - y.mean())))
    raw = np.full(len(y), base)
    nodes: list[list] = []
    roots = []

    def grow(rows: np.ndarray, level: int, lo: float, hi: float, g: np.ndarray, h: np.ndarray) -> int:
        G, H = g[rows].sum(), h[rows].sum()
        here = len(nodes)
        nodes.append([0, np.inf, here, here, float(np.clip(rate * G / (H + l2), lo, hi))])
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * least:
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, j]
                gl, hl, nl = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g[rows], h[rows], None))
                vl, vr = (np.clip(rate * a / (c + l2), lo, hi) for a, c in ((gl, hl), (G - gl, H - hl)))
                gain = gl**2 / (hl + l2) + (G - gl) ** 2 / (H - hl + l2) - G**2 / (H + l2)
                gain[(nl < least) | (len(rows) - nl < least) | (sign[j] * (vr - vl) < 0)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), (j, k, float(vl[k]), float(vr[k])))
        if best[1]:
            j, k, vl, vr = best[1]
            mid, left = (vl + vr) / 2, binned[rows, j] <= k
            bounds = {0: (lo, hi, lo, hi), 1: (lo, mid, mid, hi), -1: (mid, hi, lo, mid)}[sign[j]]
            nodes[here][0], nodes[here][1] = j, float(edges[j][k])
            nodes[here][2] = grow(rows[left], level + 1, bounds[0], bounds[1], g, h)
            nodes[here][3] = grow(rows[~left], level + 1, bounds[2], bounds[3], g, h)
        return here

    def packed() -> Trees:
        f, t, left, right, v = (np.array(c) for c in zip(*nodes, strict=True))
        return Trees(f, t, left, right, v, np.array(roots), base, depth)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        first = len(nodes)
        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf, y - p, p * (1 - p)))
        last = packed()
        last.roots = np.array([first])
        last.base = 0.0
        s = last.score(x)
        raw += np.log(s / (1 - s))
    return packed()


def sample_of(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(doc_id, text, good, toxic) of at most max_rows labelled ids, by a hash of the id. good: quality is 1 and toxic is not."""
    toxic = F.max(F.coalesce(F.col("toxic").cast("int"), F.lit(0))) if "toxic" in labels.columns else F.lit(0)
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"), toxic.alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = text_bytes(docs, "doc_id").join(F.broadcast(sample), "doc_id")  # at most max_rows ids
    return rows.select("doc_id", "text", ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("good"), (F.col("toxic") > 0).cast("int").alias("toxic"))


def raised_words(sample: DataFrame, share: float = 0.08, times: float = 8.0, least: int = 5) -> frozenset[bytes]:
    """Words that mark toxic texts: in `share` of the sample's toxic texts and in `least` of them at least, and `times` as often as in the others.
    A-Z count as a-z, marks around a word are left out. No more than texts / share words can be so."""

    def run(it):
        for b in batches(it):
            seen = {k: Counter() for k in (0, 1)}
            for t, k in zip(b["text"], b["toxic"], strict=True):
                seen[k].update({w.strip(EDGE) for w in t.lower().split()})
            words = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_pydict({"w": pa.array(words, pa.binary()), "bad": pa.array([seen[1][w] for w in words], pa.int64()), "fine": pa.array([seen[0][w] for w in words], pa.int64())})

    n = sample.agg(F.sum("toxic").alias("bad"), F.count("*").alias("all")).first()
    if not n["bad"]:
        return frozenset()
    found = sample.mapInArrow(run, "w binary, bad long, fine long").groupBy("w").agg(F.sum("bad").alias("bad"), F.sum("fine").alias("fine"))
    found = found.where((F.length("w") > 0) & (F.col("bad") >= max(least, share * n["bad"])) & (F.col("bad") * (n["all"] - n["bad"]) >= times * n["bad"] * F.greatest("fine", F.lit(0.5))))
    return frozenset(bytes(r["w"]) for r in found.select("w").collect())


def training_rows(sample: DataFrame, raised: frozenset[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the sample, in the order of the ids."""

    def run(it):
        for b in batches(it):
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "y": pa.array(b["good"], pa.int32()), "x": [statistics(t, raised)[1] for t in b["text"]]})

    got = sample.mapInArrow(run, "doc_id long, y int, x array<double>").toPandas()
    got = got.sort_values("doc_id", kind="stable")
    return np.array(got.x.tolist(), dtype=float).reshape(-1, len(FEATURES)), got.y.to_numpy(dtype=float)


def verdicts(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, least_score: float = 0.5) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the trees' score, a row for each document. The trees tell texts whose label is good and
    not toxic from the others."""
    sample = sample_of(docs, labels, max_rows)
    raised = raised_words(sample)
    trees = fit(*training_rows(sample, raised))

    def run(it):
        for b in batches(it):
            got = [statistics(t, raised) for t in b["text"]]
            base, x = (np.array(c, dtype=t) for c, t in zip(zip(*got, strict=True), (np.int64, float), strict=True))
            failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
            score = trees.score(x) if trees else np.ones(len(x))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": pa.array(b["doc_id"], pa.int64())} | {c: base[:, i] for i, c in enumerate(BASE)} | {"base_failed": failed, "kept": ~failed & (score >= least_score), "score": score}
            )

    columns = ", ".join(f"{c} long" for c in ("doc_id", *BASE))
    return text_bytes(docs, "doc_id").mapInArrow(run, f"{columns}, base_failed boolean, kept boolean, score double")


def op8_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
