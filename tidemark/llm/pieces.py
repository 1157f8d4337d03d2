"""SentencePiece encoding and decoding through a table of distinct marked words.

A text is encoded as the sentencepiece library encodes it: a marker is put before it, every
blank becomes a marker, and pieces are merged by score. Where no piece of the vocabulary has
a marker after another character, no merge crosses the start of a run of markers, so a text
falls into marked words that are segmented apart from each other; likewise around a control
character that is part of no longer piece and is written as its bytes. Both are read off
the model (`Cuts`); a model without that property is encoded text by text.

The words of all documents are counted (map-side first, so a word in a third of all places
is one row a task). The most frequent words, as many as ``TABLE_BYTES`` hold, are segmented
once each in Spark tasks and form the table that every task looks words up in; a document's
ids are its words' ids joined by position. A word beyond the table is segmented where it
stands, once for each group of documents that a task takes together: there it costs less
than a shuffle of its places. Words over ``LONG`` characters, which all but never repeat,
are not counted. Neither bound changes a result.

Decoding is the library's, document by document.

Defined cases: a null text is encoded like an empty one (the end id alone, or no id); null
ids are decoded to a null text. Texts of any length are cut at word starts and take memory
in proportion to one text. Repeated rows are encoded one by one. Extra columns pass through,
but one named like the added column is replaced; an empty table gives no rows. There are no
ties: ids follow from the model alone.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import by_value, small_batches
from tidemark.session import materialize

by_value(__name__)

MARK = "▁"
#: Memory that the table of words may take in a Python worker, and what one entry takes beside its characters.
TABLE_BYTES, ENTRY_BYTES = 48 << 20, 220
LONG = 64
#: Distinct words that a task counts before it hands them on; characters that are segmented together.
COUNTED, STEP = 1 << 18, 1 << 20
#: Kinds of pieces that a text can be cut into (fixed values of the model format): normal, user defined, unused.
NORMAL, USER_DEFINED, UNUSED = 1, 4, 5
BPE = 2
CONTROLS = "\n\t\r\v\f"


@dataclass(frozen=True)
class Cuts:
    """How texts fall into words under a model. ``apart``: whether they do; ``alone``: control
    characters that no longer piece holds; ``words``: the model that puts no marker first."""
    model: bytes
    words: bytes
    apart: bool
    prefix: bool
    alone: str

    @staticmethod
    def of(model: bytes) -> Cuts:
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(model)
        n, t = m.normalizer_spec, m.trainer_spec
        pieces = [p.piece for p in m.pieces if p.type in (NORMAL, USER_DEFINED, UNUSED)]
        plain = not n.precompiled_charsmap and not n.remove_extra_whitespaces and n.escape_whitespaces
        apart = (plain and t.model_type == BPE and not t.treat_whitespace_as_suffix and MARK in pieces
                 and not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces))
        held = set("".join(p for p in pieces if len(p) > 1))
        alone = "".join(c for c in CONTROLS if c not in held) if t.byte_fallback else ""
        prefix = n.add_dummy_prefix
        n.add_dummy_prefix = False
        return Cuts(model, m.SerializeToString() if apart else model, apart, prefix and apart, alone)

    def cutter(self) -> Callable[[str], Iterator[list[str]]]:
        """Lists of a text's words, in order; together they are the marked text."""
        if not self.apart:
            return lambda text: iter([[text]] if text else [])
        word = re.compile(f" *[^ {self.alone}]+| +|[{self.alone}]+" if self.alone else " *[^ ]+| +")
        start = re.compile("(?<=[^ ]) ")
        first = " " if self.prefix else ""

        def cut(text: str) -> Iterator[list[str]]:
            if text:
                text = first + text.replace(MARK, " ")
            lo = 0
            while lo < len(text):
                at = start.search(text, lo + STEP) if lo + STEP < len(text) else None
                hi = at.start() if at else len(text)
                yield word.findall(text, lo, hi)
                lo = hi

        return cut


def load(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def segment(processor, words: list[str]) -> list[bytes]:
    """Each word's ids as 32-bit integers."""
    return [array("i", ids).tobytes() for ids in processor.encode(words, num_threads=1)]


def count_words(docs: DataFrame, cuts: Cuts, text_col: str = "text") -> DataFrame:
    """(word, n): how often each distinct marked word of at most LONG characters occurs."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, seen = cuts.cutter(), Counter()

        def out() -> pa.RecordBatch:
            got = [(w, n) for w, n in seen.items() if len(w) <= LONG]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in got], pa.string()), pa.array([n for _, n in got], pa.int64())],
                                              names=["word", "n"])

        for b in batches:
            for text in b.column(0):
                for words in cut(text.as_py() or ""):
                    seen.update(words)
                    if len(seen) >= COUNTED:
                        yield out()
        yield out()

    return docs.select(F.col(text_col)).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counted: DataFrame, table_bytes: int) -> DataFrame:
    """The most frequent words that fit: whole classes of about equal counts, from the top.
    A word that occurs once gains nothing from a table."""
    cost = F.length("word") * 2 + ENTRY_BYTES
    kind = F.floor(F.log2("n") * 16)
    held, least = 0, None
    for r in sorted(counted.where("n > 1").groupBy(kind.alias("k")).agg(F.sum(cost).alias("b")).collect(), reverse=True):  # 1,024 rows at most
        held += r["b"]
        if held > table_bytes:
            break
        least = r["k"]
    return counted.where((F.col("n") > 1) & (kind >= least)).select("word") if least is not None else counted.where("false").select("word")


def word_table(docs: DataFrame, cuts: Cuts, text_col: str = "text", table_bytes: int = TABLE_BYTES) -> dict[str, bytes]:
    """Word to ids, of bounded size: each word is segmented once, in Spark tasks."""
    if not cuts.apart or table_bytes <= 0:
        return {}
    counted = materialize(count_words(docs, cuts, text_col), "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = load(cuts.words)
        for b in batches:
            ids = segment(processor, b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["word", "ids"])

    got = frequent(counted, table_bytes).mapInArrow(run, "word string, ids binary").toArrow()
    return dict(zip(got.column("word").to_pylist(), got.column("ids").to_pylist()))


def encode(docs: DataFrame, model: bytes, text_col: str = "text", ids_col: str = "ids", end: bool = True,
           table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``docs`` with ``ids_col``, the ids (array of int) of the whole text."""
    spark = docs.sparkSession
    small_batches(spark)
    cuts = Cuts.of(model)
    shared = spark.sparkContext.broadcast(word_table(docs, cuts, text_col, table_bytes))
    docs = docs.drop(ids_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cut, processor = dict(shared.value), cuts.cutter(), load(cuts.words)
        tail = np.array([processor.eos_id()] if end and processor.eos_id() >= 0 else [], dtype=np.int32).tobytes()
        for b in batches:
            texts, lo, size = b.column(at).to_pylist(), 0, 0
            for hi in range(1, len(texts) + 1):
                size += len(texts[hi - 1] or "")
                if size < STEP and hi < len(texts):
                    continue
                words = [[w for part in cut(t or "") for w in part] for t in texts[lo:hi]]
                new = list(set().union(*words) - known.keys())
                known.update(zip(new, segment(processor, new)))
                found = [b"".join(map(known.__getitem__, doc)) + tail for doc in words]
                for w in new:
                    del known[w]
                offsets = np.concatenate(([0], np.cumsum([len(f) // 4 for f in found]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns, ids], names=[*b.schema.names, ids_col])
                lo, size = hi, 0

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, model: bytes, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with ``text_col``, the text that the library decodes the ids to."""
    small_batches(rows.sparkSession)
    rows = rows.drop(text_col)
    at = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = load(model)
        for b in batches:
            ids = b.column(at)
            values, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_pylist()
            texts = processor.decode([values[i:j].tolist() for i, j in zip(ends, ends[1:])], num_threads=1) if len(ids) else []
            texts = [t if there else None for t, there in zip(texts, ids.is_valid().to_pylist())] if ids.null_count else texts
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, text_col])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(text_col, T.StringType())]))
