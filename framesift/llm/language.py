"""Language of documents as a mixture: expectation-maximisation over n-gram likelihoods, and a penalised choice of the languages.

Letter trigrams are hashed to a fixed number of cells; each language's cell probabilities are counted over all training documents.
For a document, EM estimates the proportions of all languages; then the set of its likeliest languages grows by one as long as the likelihood
less a penalty a language grows too, to all languages at most, and the language with the greatest share in it is predicted.

Null text, or one without letters: `und`, score 0. Null lang: not learned from. Null doc_id: its crc32 is that of the empty text.
No training rows: `und`. Repeated rows: a row each. Empty table: no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, crc_mod, released, sliced, table, text_bytes

CELL_BITS = 16
#: Bytes of text that are worked on at a time: trigrams take some 200 times as much.
SLICE_BYTES = 1 << 19
NOT_LETTERS = re.compile(r"[\W\d_]+")
UND = "und"


def letters(b: bytes) -> str:
    """Lower-case words between single blanks; empty without letters."""
    s = NOT_LETTERS.sub(" ", b.decode().lower()).strip()
    return f" {s} " if s and any(map(str.isalpha, s)) else ""


def cells(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of all trigrams: the text's position and the cell."""
    sizes = np.array([len(t) for t in texts])
    cp = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    if len(cp) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = cp[:-2] * np.uint32(0x9E3779B1) + cp[1:-1] * np.uint32(0x85EBCA77) + cp[2:] * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> 15)) * np.uint32(0x27D4EB2F) >> np.uint32(32 - CELL_BITS)
    of = np.repeat(np.arange(len(texts)), sizes)
    whole = of[:-2] == of[2:]
    return of[:-2][whole], h[whole].astype(np.int64)


def learn(spark: SparkSession, docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their cell probabilities (cells x languages), from every row of docs with a lang."""

    def run(it):
        seen: dict[str, np.ndarray] = {}
        for b in batches(it, size=SLICE_BYTES):
            names = sorted(set(b["lang"]))
            of, h = cells([letters(t) for t in b["text"]])
            lang = np.searchsorted(names, b["lang"])
            n = np.bincount((lang[of] << CELL_BITS) + h, minlength=len(names) << CELL_BITS).reshape(-1, 1 << CELL_BITS)
            for name, row in zip(names, n, strict=True):
                seen[name] = seen[name] + row if name in seen else row
        for name, row in seen.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_pydict({"lang": [name] * len(at), "cell": at, "n": row[at]})

    counts = text_bytes(docs.where("lang is not null"), "lang").mapInArrow(run, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(counts.lang.unique())
    n = np.zeros((1 << CELL_BITS, len(names)))
    n[counts.cell, np.searchsorted(names, counts.lang)] = counts.n
    return names, (n + 0.5) / (n.sum(axis=0) + 0.5 * len(n)) if names else n


def infer(texts: list[bytes], p: np.ndarray, penalty: float, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (texts x languages) in the chosen set, and the score."""
    n_lang, n_text = p.shape[1], len(texts)
    of, h = cells([letters(t) for t in texts])
    share, score = np.zeros((n_text, n_lang)), np.zeros(n_text)
    if not len(of):
        return share, score
    key, count = np.unique((of << CELL_BITS) + h, return_counts=True)
    of, like, count = key >> CELL_BITS, p[key & ((1 << CELL_BITS) - 1)], count.astype(float)
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    has = of[starts]  # texts with trigrams
    row = np.repeat(np.arange(len(has)), np.diff(np.r_[starts, len(of)]))
    total = np.add.reduceat(count, starts)

    def em(pi: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(rounds):
            joint = pi[row] * like
            pi = np.add.reduceat(joint * (count / joint.sum(axis=1))[:, None], starts) / total[:, None]
        return pi, np.add.reduceat(count * np.log((pi[row] * like).sum(axis=1)), starts)

    alone = np.add.reduceat(count[:, None] * np.log(like), starts)  # one language each
    full, fit = em(np.full((len(has), n_lang), 1 / n_lang), rounds)
    order = np.argsort(-full, axis=1, kind="stable")
    first = alone.argmax(axis=1)
    best_pi = np.zeros_like(full)
    best_pi[np.arange(len(has)), first] = 1
    best = alone.max(axis=1)
    going = np.ones(len(has), bool)  # texts whose set still grew at the last step
    for m in range(2, n_lang + 1):
        pi = np.maximum(full, 1e-12) * (np.argsort(order, axis=1) < m)
        pi, fit = em(pi / pi.sum(axis=1, keepdims=True), 4)
        fit = fit - penalty * (m - 1) * np.log(total + 1)
        going &= fit > best
        best_pi[going] = pi[going]
        best = np.where(going, fit, best)
        if not going.any():
            break
    sure = 1 / np.exp(np.maximum(alone - alone.max(axis=1, keepdims=True), -700)).sum(axis=1)
    share[has] = best_pi
    one = (best_pi > 0).sum(axis=1) == 1
    score[has] = best_pi.max(axis=1) * np.where(one, sure, 1)
    return share, np.clip(score, 0, 1)


def predict(spark: SparkSession, docs: DataFrame, names: list[str], p: np.ndarray, *keep: str, penalty: float = 3.0) -> DataFrame:
    """The columns kept, lang_pred, score and the proportions (language to share) of each document."""
    model = spark.sparkContext.broadcast((names, p))  # 2^16 cells a language

    def run(it):
        names, p = model.value
        for batch in sliced(it, size=SLICE_BYTES):
            texts = batch.column("text").to_pylist()
            share, score = infer(texts, p, penalty) if names else (np.zeros((len(texts), 1)), np.zeros(len(texts)))
            top, none = share.argmax(axis=1), share.sum(axis=1) == 0
            pred = [UND if e else names[t] for t, e in zip(top, none, strict=True)]
            shares = [[(names[i], float(s[i])) for i in np.flatnonzero(s)] for s in share]
            kept = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(pred), pa.array(score), pa.array(shares, pa.map_(pa.string(), pa.float64()))], [*keep, "lang_pred", "score", "shares"])
        released()

    schema = text_bytes(docs, *keep).drop("text").schema.add("lang_pred", "string").add("score", "double").add("shares", T.MapType(T.StringType(), T.DoubleType()))
    return text_bytes(docs, *keep).mapInArrow(run, schema)


def held_out(docs: DataFrame):
    return crc_mod(docs["doc_id"], 4) == 2


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(spark, docs.where(~held_out(docs)))
    marked = docs.withColumn("held_out", held_out(docs))
    return predict(spark, marked, *model, "doc_id", "held_out").select("doc_id", "held_out", "lang_pred", "score", "shares")
