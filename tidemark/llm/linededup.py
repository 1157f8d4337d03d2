"""Line dedup: lines found in many documents go from every document.

Lines are exploded, normalised (ASCII whitespace stripped at both ends, A-Z lower-cased)
and keyed by two 64-bit hashes; documents are counted per key; lines whose key is found in
at least ``min_docs`` documents are dropped; the rest is joined again in order.

The count takes each key once per document before the shuffle and is combined map-side,
so a line that a third of all documents share costs a row per task. The table of frequent
keys is broadcast only when its counted size is below the session's threshold; otherwise
the lines are joined by shuffle, where adaptive execution splits a frequent key's rows.

Defined cases: a null or empty text is one empty line. Keys shorter than ``min_chars``
code points are never dropped. Repeated rows: each row is a document of its own in the
output; rows that share an id count as one document. Null ids count as one document and
keep their rows apart. Extra columns pass through, but one named n_lines or
n_dropped is replaced; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import P
from tidemark.session import materialize

MIN_DOCS = 10
MIN_CHARS = 1
#: Bytes a frequent key takes in a broadcast hash table (two longs, row and table overhead).
KEY_BYTES = 64


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias(P + "h1"), F.xxhash64(F.lit("line"), key).alias(P + "h2")]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def frequent_keys(docs: DataFrame, id_col: str, text_col: str, min_docs: int, min_chars: int) -> DataFrame:
    """Keys (h1, h2) of the lines found in at least ``min_docs`` documents."""
    keys = (docs.select(F.col(id_col).alias(P + "id"),
                        F.explode(F.array_distinct(F.transform(_lines(F.col(text_col)), line_key))).alias(P + "k"))
            .where(F.length(P + "k") >= min_chars))
    # rows that share an id are one document: the few such ids are counted apart from the rest
    ids = docs.groupBy(F.col(id_col).alias(P + "id")).agg(F.count("*").alias("n")).where(F.col("n") > 1).select(P + "id")
    hashed = keys.select(P + "id", *_hashes(F.col(P + "k")))
    repeated = materialize(ids, "line_ids")
    if repeated.isEmpty():
        counts = hashed.groupBy(P + "h1", P + "h2").agg(F.count("*").alias("n"))
    else:
        counts = (hashed.distinct().groupBy(P + "h1", P + "h2").agg(F.count("*").alias("n")))
    return counts.where(F.col("n") >= min_docs).select(P + "h1", P + "h2")


def drop_frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS,
                        min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with ``text_col`` cleaned, plus n_lines (before) and n_dropped."""
    spark = docs.sparkSession
    frequent = materialize(frequent_keys(docs, id_col, text_col, min_docs, min_chars), "line_keys")
    limit = _bytes(spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760"))
    small = frequent.count() * KEY_BYTES <= limit
    docs = docs.drop("n_lines", "n_dropped")
    others = [c for c in docs.columns if c != text_col]
    hashed = [F.col(f.name) for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    numbered = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(*hashed).alias("h")).alias(P + "row"),
                           F.struct(*[F.col(c) for c in others]).alias(P + "rest"),
                           F.posexplode(_lines(F.col(text_col))).alias(P + "pos", P + "line"))
    lines = numbered.select(P + "row", P + "pos", P + "line", F.when(F.col(P + "pos") == 0, F.col(P + "rest")).alias(P + "rest"),
                            *_hashes(line_key(F.col(P + "line"))))
    flagged = lines.join(F.broadcast(frequent.withColumn(P + "hit", F.lit(True))) if small
                         else frequent.withColumn(P + "hit", F.lit(True)), [P + "h1", P + "h2"], "left")
    gone = F.col(P + "hit") & (F.length(line_key(F.col(P + "line"))) >= min_chars)
    kept = flagged.select(P + "row", P + "rest", F.struct(
        F.col(P + "pos").alias("pos"), F.when(F.coalesce(gone, F.lit(False)), F.lit(None)).otherwise(F.col(P + "line")).alias("line")
    ).alias(P + "item"))
    # rows alike in all columns meet here: their lines count once, and they are dealt out again below
    whole = kept.groupBy(P + "row").agg(F.first(P + "rest", ignorenulls=True).alias(P + "rest"),
                                        F.count_if(F.col(P + "item.pos") == 0).alias(P + "copies"),
                                        F.sort_array(F.collect_set(P + "item")).alias(P + "items"))
    items = F.col(P + "items")
    stay = F.filter(items, lambda x: x["line"].isNotNull())
    cols = [F.array_join(F.transform(stay, lambda x: x["line"]), "\n").alias(c) if c == text_col
            else F.col(f"{P}rest.`{c}`").alias(c) for c in docs.columns]
    out = whole.select(P + "copies", *cols, F.size(items).cast("long").alias("n_lines"),
                       (F.size(items) - F.size(stay)).cast("long").alias("n_dropped"))
    return (out.withColumn(P + "copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(P + "copies"))))
            .drop(P + "copy", P + "copies"))


def _bytes(text: str) -> int:
    text = text.strip().lower().removesuffix("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}.get(text[-1:], 0)
    return int(text[:-1]) * unit if unit else int(text)
