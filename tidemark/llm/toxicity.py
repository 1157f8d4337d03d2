"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its words (also cut to crude stems of 4 and 6 bytes, as endings vary),
word pairs and pairs with one word between, hashed into 2^22 slots, each taken once per text. FTRL-proximal keeps a learning rate per coordinate
and L1 sets most weights to exactly zero; the few left are the whole model, small enough
to travel with the scoring function whatever the corpus.

The learner is online: one task passes over a bounded sample (``per_class`` documents a
class at most) in a seeded order and returns the non-zero weights. Scoring is a plain map.

Defined cases: null or empty text has no feature and gets the bias's score. Rows without
a label, and labels other than 0 and 1, are not learned from. Repeated rows are scored one
by one. No labelled rows: every score is 0.5. Extra columns pass through, but one named
score or predicted is replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import P, as_bytes, ascii_lower, by_value, chunks, fold, hash_spans, joined, mix64, small_batches, spans, word_bytes
from tidemark.llm.quality import training_rows

by_value(__name__)

#: The most documents of a class that the weights are learned from.
PER_CLASS = 4000
SEED = 4
BITS = 22
STEMS = (4, 6)
EPOCHS = 6
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.1
THRESHOLD = 0.7
FOLDS, HELD = 3, 1


def features(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, slot) of every word, stem, pair and skip pair of the texts, repeats included."""
    data, offsets = joined(blobs)
    lowered = ascii_lower()[data]
    start, end = spans(word_bytes()[data])
    doc = np.searchsorted(offsets, start, side="right") - 1
    h = hash_spans(lowered, start, end)
    slots, docs = [h], [doc]
    for cut in STEMS:
        longer = end - start > cut
        slots.append(mix64(hash_spans(lowered, start[longer], start[longer] + cut) + np.uint64(cut)))
        docs.append(doc[longer])
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xD6E8FEB86659FD93)):
        same = doc[gap:] == doc[:-gap]
        slots.append(mix64(h[:-gap] * np.uint64(salt) + h[gap:])[same])
        docs.append(doc[gap:][same])
    return np.concatenate(docs), (np.concatenate(slots) >> np.uint64(64 - BITS)).astype(np.int64)


def ftrl(examples: list[tuple[np.ndarray, int]], seed: int = SEED) -> tuple[np.ndarray, np.ndarray, float]:
    """Non-zero slots, their weights, and the bias (kept free of L1 in the last slot)."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        lam = np.where(i == bias, 0.0, L1)
        w = -(zi - np.sign(zi) * lam) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(zi) <= lam, 0.0, w)

    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(examples)):
            slot, y = examples[k]
            i = np.append(slot, bias)
            w = weights(i)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - y
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    touched = np.flatnonzero(n)
    w = weights(touched)
    keep = (w != 0) & (touched != bias)
    b = weights(np.array([bias]))[0]
    return touched[keep], w[keep], float(b)


def train(docs: DataFrame, labels: DataFrame, seen, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", per_class: int = PER_CLASS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, float]:
    small_batches(docs.sparkSession)
    picked = training_rows(docs, labels, id_col, label_col, seen, per_class, seed)
    texts = docs.select(F.col(id_col).alias(P + "id"), F.col(text_col).alias("text")).join(F.broadcast(picked), P + "id")

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for t in as_bytes(b.column(1)):
                found.append(np.unique(features([t])[1]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32())), b.column(2)],
                                             names=["id", "slots", "y"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            for i, s, y in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                rows.append((i, s.values.to_numpy(zero_copy_only=False), y))
        rows.sort(key=lambda r: (r[0], r[2], len(r[1])))
        slot, w, bias = ftrl([(s, y) for _, s, y in rows], seed) if rows else (np.zeros(0, int), np.zeros(0), 0.0)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(slot, -1)), pa.array(np.append(w, bias))], names=["slot", "w"])

    # bounded: 2 x per_class documents' slots meet in the one learning task
    got = (texts.select(F.col(P + "id").cast("string").alias("id"), "text", F.col(P + "y").alias("y"))
           .mapInArrow(slots, "id string, slots array<int>, y int").repartition(1)
           .mapInArrow(learn, "slot long, w double").toArrow())
    slot, w = got.column("slot").to_numpy(), got.column("w").to_numpy()
    own = slot >= 0
    return slot[own], w[own], float(w[~own].sum())


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text_col: str = "text",
          out: str = "score") -> DataFrame:
    docs = docs.drop(out)
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    slot, weight, bias = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << BITS, dtype=np.float32)
        dense[slot] = weight
        for b in batches:
            blobs = as_bytes(b.column(at))
            margin = np.full(len(blobs), bias)
            for lo, hi in chunks(blobs):
                doc, s = features(blobs[lo:hi])
                use = dense[s] != 0
                once = np.unique((doc[use] << BITS) | s[use])
                margin[lo:hi] += np.bincount(once >> BITS, dense[once & ((1 << BITS) - 1)], hi - lo)
            p = 1.0 / (1.0 + np.exp(-np.clip(margin, -35, 35)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], names=[*b.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def not_held():
    return lambda doc_id: fold(doc_id, FOLDS) != HELD


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score and predicted, learned from the rows not held out."""
    model = train(docs, labels, not_held(), id_col, text_col)
    return score(docs, model, text_col).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
