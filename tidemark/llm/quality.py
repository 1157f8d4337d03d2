"""Quality classifier: histogram gradient-boosted trees over document statistics.

One pass computes the statistics of the sampled training documents in the tasks; the
trees are fitted on that bounded table of numbers (``per_class`` documents a class at
most) and, a few kilobytes of arrays, travel with the scoring function.

Defined cases: null or empty text has all statistics zero and is scored like any other.
Rows without a label, and labels other than 0 and 1, are not learned from. Repeated rows
are scored one by one. A document labelled twice counts with each label. No labelled rows:
every score is 0.5. Extra columns pass through, but one named score or predicted is
replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import boosting
from tidemark.llm.common import (P, as_bytes, ascii_lower, by_value, chunks, fold, hash_spans, joined, sample_ids,
                                 small_batches, spans)

by_value(__name__)

#: The most documents of a class that the trees are fitted on.
PER_CLASS = 6000
SEED = 9
THRESHOLD = 0.3
FOLDS, HELD = 5, 0
STATISTICS = 18


def statistics(blobs: list[bytes]) -> np.ndarray:
    """One row of statistics per text, computed over whole texts, many texts at a time."""
    return np.concatenate([_statistics(blobs[lo:hi]) for lo, hi in chunks(blobs)]) if blobs else np.zeros((0, STATISTICS))


def _statistics(blobs: list[bytes]) -> np.ndarray:
    data, offsets = joined(blobs)
    n = len(blobs)
    size = np.maximum(np.diff(offsets) - 1, 1).astype(float)
    doc_of = np.repeat(np.arange(n), np.diff(offsets))

    def share(flags: np.ndarray) -> np.ndarray:
        return np.bincount(doc_of[flags], minlength=n)

    space = (data == 32) | ((data >= 9) & (data <= 13))
    upper = (data >= 65) & (data <= 90)
    lower = (data >= 97) & (data <= 122)
    digit = (data >= 48) & (data <= 57)
    high = data >= 128
    symbol = ~(space | upper | lower | digit | high)
    start, end = spans(~space)
    word_doc = doc_of[start]
    words = np.bincount(word_doc, minlength=n)
    w = np.maximum(words, 1).astype(float)
    lowered = ascii_lower()[data]
    h = hash_spans(lowered, start, end)

    def distinct(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
        mixed = key ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, first = np.unique(mixed, return_index=True)
        return np.bincount(doc[first], minlength=n)

    pair = word_doc[1:] == word_doc[:-1]
    bigram = (h[:-1] * np.uint64(31) + h[1:])[pair]
    bigrams = np.bincount(word_doc[1:][pair], minlength=n)
    line_start, line_end = spans(data != 10)
    line_doc = doc_of[line_start]
    lines = np.bincount(line_doc, minlength=n)
    tail = end - 1
    tail_symbol = symbol[tail]
    tail2 = tail_symbol & (end - start > 1) & symbol[np.maximum(tail - 1, 0)]
    stop = np.isin(data[tail], np.frombuffer(b".!?", np.uint8))
    word_len = (end - start).astype(float)
    caps = upper[start] & (end - start > 1) & upper[np.minimum(start + 1, len(data) - 1)]
    longest = np.zeros(n)
    np.maximum.at(longest, word_doc, word_len)
    by_word = lambda v: np.bincount(word_doc, v, n) / w
    return np.stack([
        np.log1p(np.diff(offsets) - 1), np.log1p(words), by_word(word_len), np.log1p(longest),
        share(upper) / size, share(digit) / size, share(symbol) / size, share(high) / size, share(space) / size,
        share((data == 33) | (data == 63)) / size, share((data == 124) | (data == 60) | (data == 62)) / size,
        distinct(word_doc, h) / w, distinct(word_doc[1:][pair], bigram) / np.maximum(bigrams, 1),
        np.log1p(lines), distinct(line_doc, hash_spans(lowered, line_start, line_end)) / np.maximum(lines, 1),
        by_word(tail2.astype(float)), by_word(stop.astype(float)), by_word(caps.astype(float)),
    ], axis=1)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, seen, per_class: int,
                  seed: int) -> DataFrame:
    """(id, label) of the bounded sample: labelled 0 or 1 and in ``seen`` (a condition on the id)."""
    known = (labels.select(F.col(id_col).alias(P + "id"), F.col(label_col).cast("int").alias(P + "y"))
             .where(F.col(P + "id").isNotNull() & F.col(P + "y").isin(0, 1) & seen(F.col(P + "id"))).distinct())
    present = docs.select(F.col(id_col).alias(P + "id")).distinct()
    return sample_ids(known.join(present, P + "id", "left_semi"), P + "id", [P + "y"], per_class, seed)


def train(docs: DataFrame, labels: DataFrame, seen, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", per_class: int = PER_CLASS, seed: int = SEED) -> boosting.Trees:
    spark = docs.sparkSession
    small_batches(spark)
    picked = training_rows(docs, labels, id_col, label_col, seen, per_class, seed)
    # bounded by 2 x per_class rows of two numbers, so a broadcast is safe at any input size
    texts = docs.select(F.col(id_col).alias(P + "id"), F.col(text_col).alias("text")).join(F.broadcast(picked), P + "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(as_bytes(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64())), b.column(2)],
                                             names=["id", "x", "y"])

    got = (texts.select(F.col(P + "id").cast("string").alias("id"), "text", F.col(P + "y").alias("y"))
           .mapInArrow(run, "id string, x array<double>, y int").toArrow().sort_by("id"))
    x = np.array(got.column("x").to_pylist(), dtype=float).reshape(got.num_rows, STATISTICS)
    y = np.array(got.column("y").to_pylist(), dtype=float)
    order = np.lexsort((*x.T, y))  # the same model however the rows arrive
    return boosting.fit(x[order], y[order])


def score(docs: DataFrame, model: boosting.Trees, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score column (0 to 1)."""
    docs = docs.drop(out)
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.probability(statistics(as_bytes(b.column(at))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], names=[*b.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def not_held(folds: int = FOLDS, held: int = HELD):
    return lambda doc_id: fold(doc_id, folds) != held


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score and predicted, learned from the rows not held out."""
    model = train(docs, labels, not_held(), id_col, text_col)
    return score(docs, model, text_col).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
