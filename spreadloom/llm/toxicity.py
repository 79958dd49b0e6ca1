"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashed unigrams, bigrams and skip-grams (two words with one between) of a text's lower-cased
words, stripped of marks at both ends; each counts once, whatever the text's length. FTRL-proximal keeps a sum of
gradients and of squared gradients for each coordinate, so rare features learn at their own rate, and its L1 term leaves
most weights at exactly zero: the model is the short list of the others, at most ``2 ** BITS`` of them (a proven bound
for handing them to all tasks).

Training reads every labelled row. Their ids are dealt by hash to shares of about ``SAMPLE``; each share is learned in
``EPOCHS`` passes of one task, and the model is the mean of the shares' models, whose scores are as good as linear in the
weights. Of an id that comes with several texts the one with the smallest hash is learned from, so a task holds one share
whatever the size of the table. Rows whose crc32(doc_id as text) mod 3 is 1 are never learned
from. Scoring sees the text alone and needs no exchange.

Defined cases: a null or empty text has the bias alone; a row without label is scored like any other; labels are joined
by doc_id, and a doc_id with several labels is toxic if one says so; without a usable label every score is 0; repeated
rows get equal answers; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadloom.llm.common import documents, materialise, released
from spreadloom.llm.tokens import LONGEST, small_batches

BITS = 20
SAMPLE = 6_000
EPOCHS = 10
ALPHA, BETA, L1, L2 = 2.0, 1.0, 16.0, 0.1
#: Weight of a toxic row.
POSITIVE = 4.0
#: What a clean row above the threshold costs when it is calibrated, in toxic rows found.
FALSE_COST = 3
THRESHOLD = 0.7
WORDS = 250_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """word -> 64-bit hash of the word without marks around it."""

    def __missing__(self, word: bytes) -> int:
        plain = word.strip(b".,;:!?\"'()[]#*$%&|<>")
        value = zlib.crc32(plain) << 32 | zlib.crc32(plain[::-1], 7)
        if len(word) <= LONGEST:
            if len(self) >= WORDS:
                self.clear()
            self[word] = value
        return value


def mixed(a: np.ndarray, bits: int) -> np.ndarray:
    a = (a ^ (a >> np.uint64(31))) * _MIX
    return (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)


def features(text: bytes | None, words: Hashes, bits: int = BITS) -> np.ndarray:
    """Places of the features of a text, sorted, each once."""
    found = text.lower().split() if text else []
    if not found:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    one, two, three = np.uint64(1), np.uint64(3), np.uint64(5)
    grams = [h * one, h[:-1] * two + (h[1:] ^ _MIX), h[:-2] * three + (h[2:] ^ (_MIX >> one))]
    return np.unique(mixed(np.concatenate(grams), bits)).astype(np.int64)


def fit(rows: list[tuple[np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> dict[int, float]:
    """Non-zero weights by place; the bias is at -1. Rows are learned from in the order given."""
    n = (1 << bits) + 1  # the bias comes last and has no L1 term
    z, squares = np.zeros(n), np.zeros(n)
    cut = np.full(n, L1)
    cut[-1] = 0
    for _ in range(epochs):
        for at, label in rows:
            at = np.append(at, n - 1)
            zi, si = z[at], squares[at]
            root = np.sqrt(si)
            w = np.where(np.abs(zi) <= cut[at], 0.0, (np.sign(zi) * cut[at] - zi) / ((BETA + root) / ALPHA + L2))
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w.sum()))))) - label
            g *= POSITIVE if label else 1.0
            z[at] += g - (np.sqrt(si + g * g) - root) / ALPHA * w
            squares[at] += g * g
    w = np.where(np.abs(z) <= cut, 0.0, (np.sign(z) * cut - z) / ((BETA + np.sqrt(squares)) / ALPHA + L2))
    out = {int(k): float(w[k]) for k in np.flatnonzero(w[:-1])}
    return out | {-1: float(w[-1])}


def logits(rows: list[tuple[np.ndarray, int]], weights: dict[int, float], bits: int = BITS) -> np.ndarray:
    dense = np.zeros(1 << bits)
    dense[[k for k in weights if k >= 0]] = [v for k, v in weights.items() if k >= 0]
    return np.array([float(dense[at].sum()) + weights[-1] for at, _ in rows])


def calibrated(rows: list[tuple[np.ndarray, int]], threshold: float = THRESHOLD) -> dict[int, float]:
    """``fit`` on all rows, its bias moved so that the threshold divides rows that a fit has not seen.

    A fit on two thirds of the rows scores the other third; of all cuts the one with the most toxic rows found, less
    ``FALSE_COST`` for each other row above it, is taken, in the middle of its range.
    """
    weights = fit(rows)
    seen, unseen = [r for k, r in enumerate(rows) if k % 3], rows[::3]
    if len({label for _, label in seen}) < 2 or not any(label for _, label in unseen):
        return weights
    scores, labels = logits(unseen, fit(seen)), np.array([label for _, label in unseen])
    order = np.argsort(-scores, kind="stable")
    gains = np.concatenate([[0], np.cumsum(np.where(labels[order] == 1, 1, -FALSE_COST))])
    best = int(np.flatnonzero(gains == gains.max())[0])
    ranked = scores[order]
    above, below = (ranked[best - 1] if best else ranked[0] + 1), (ranked[best] if best < len(ranked) else ranked[-1] - 1)
    return weights | {-1: weights[-1] + math.log(threshold / (1 - threshold)) - (above + below) / 2}


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(3))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict[int, float]:
    """Weights learned from all labelled rows of ``docs``, in shares of about ``sample`` ids; the mean of the shares' weights."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = known.where((remainder(F.col("doc_id")) != 1) & F.col("toxic").isin(0, 1))
    texts = docs.select("doc_id", "text").join(usable, "doc_id")
    texts = texts.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    texts = materialise(texts, "labelled")
    shares = max(1, -(-texts.count() // sample))

    @released
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Hashes()
        read = (row for batch in batches for row in zip(batch.column("share").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("toxic").to_pylist(), strict=True))
        for share, rows in groupby(read, key=itemgetter(0)):
            weights = calibrated([(features(text, words), label) for _, text, label in rows])
            yield pa.RecordBatch.from_arrays([pa.array([share] * len(weights), pa.int64()), pa.array(list(weights), pa.int32()), pa.array(list(weights.values()), pa.float64())], ["share", "place", "weight"])

    dealt = texts.select(F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(shares)).alias("share"), F.xxhash64("doc_id", F.lit(5)).alias("_order"), "doc_id", "text", "toxic")
    # by range, since a hash of so few numbers puts several in one task
    ordered = dealt.repartitionByRange(shares, "share").sortWithinPartitions("share", "_order", "doc_id", "text")
    made = materialise(ordered.select("share", "text", "toxic").mapInArrow(learn, "share long, place int, weight double"), "weights")
    # summed in the order of the shares, so that equal rows give equal weights
    own = F.transform(F.sort_array(F.collect_list(F.struct("share", "weight"))), lambda e: e["weight"])
    learned = max(1, made.select("share").distinct().count())
    found = made.groupBy("place").agg(F.aggregate(own, F.lit(0.0), lambda a, x: a + x).alias("weight")).collect()
    return {r["place"]: r["weight"] / learned for r in found}


def score(docs: DataFrame, weights: dict[int, float], keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """(columns of ``keep``, score, predicted) of every row."""
    places, values = np.array(sorted(k for k in weights if k >= 0), np.int64), np.array([weights[k] for k in sorted(weights) if k >= 0], np.float32)
    bias = weights.get(-1)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, words = np.zeros(1 << BITS, np.float32), Hashes()
        dense[places] = values
        for batch in small_batches(batches, "_body"):
            sums = [float(dense[features(x, words)].sum(dtype=np.float64)) for x in batch.column("_body").to_pylist()]
            scores = np.zeros(len(sums)) if bias is None else 1 / (1 + np.exp(-np.clip(np.array(sums) + bias, -35, 35)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores), pa.array(scores >= threshold).cast(pa.int32())], [*keep, "score", "predicted"])

    rows = docs.select(*keep, F.col("text").cast("binary").alias("_body"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    return rows.mapInArrow(run, f"{schema}, score double, predicted int")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score(docs, train(docs, documents(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
