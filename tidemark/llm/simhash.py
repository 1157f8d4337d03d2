"""SimHash near-dedup by anchor-point covering.

A document's fingerprint has bit b set when more than half of its shingles' 64-bit
hashes have it. Two fingerprints link at ``max_bits`` (0 to 2) or fewer differing bits.

Anchors are the codewords of a covering code over 46 of the 64 bits: the product of two
binary Golay [23,12] codes, each perfect with covering radius 3. So every fingerprint has
one nearest anchor (its home) within radius R = 6, and any fingerprint within distance d
of it lies within R + d of that anchor. Each distinct fingerprint is replicated to the
anchors within R + d that are the home of some fingerprint within d (about 70 of 2^24),
and per anchor its residents' homes are compared with the replicas by their whole 64 bits.
A pair is met at exactly one anchor, so links need no second dedup.

Copies never multiply: fingerprints are made distinct first. An anchor holds distinct
fingerprints only, and one fingerprint has at most 2,080 others within two bits.

Defined cases: null or empty text, or one without words, has fingerprint zero and links
like any other. Fewer words than a shingle: the whole sequence is the only shingle.
Repeated rows and ids: one output row each. A null id never is a component's id unless all
of the component's ids are null. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import P, as_bytes, by_value, small_batches
from tidemark.llm.graph import components
from tidemark.session import materialize

by_value(__name__)

SHINGLE = 3
MAX_BITS = 2
#: Generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1 (fixed value).
GOLAY = 0b110001110101
SEED = 42


# --- fingerprints -------------------------------------------------------------

def fingerprint(text: bytes, shingle: int = SHINGLE, block: int = 1 << 15) -> int:
    """SimHash of one UTF-8 text. Long texts are hashed block by block."""
    words = text.lower().split()  # on bytes: A-Z only, and exactly the six ASCII spaces
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    last = ends[min(shingle, len(words)) - 1:]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for lo in range(0, n, block):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[lo:min(n, lo + block)], last[lo:lo + block])],
                     dtype=">u8")
        counts += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    bits = counts * 2 > n
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                 keep: list | None = None) -> DataFrame:
    """(id, kept columns, fp): fp is the fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    cols = [F.col(id_col), *(keep or [])]
    rows = docs.select(*cols, F.col(text_col).alias(P + "text"))
    out = rows.drop(P + "text").withColumn("fp", F.lit(0).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in as_bytes(b.column(b.num_columns - 1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps.view(np.int64))], names=[*b.schema.names[:-1], "fp"])

    return rows.mapInArrow(run, out.schema)


# --- anchors ------------------------------------------------------------------

def golay_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Syndrome of every 23-bit word, and by syndrome the xor offsets from a word to the
    anchors that are home to some word 0, 1 or 2 flips away (-1 pads)."""
    column = []
    for i in range(23):  # x^i modulo the generator
        r = 1 << i
        for b in range(i, 10, -1):
            if r >> b & 1:
                r ^= GOLAY << (b - 11)
        column.append(r)
    syndrome = np.zeros(1, dtype=np.int16)
    for c in column:
        syndrome = np.concatenate((syndrome, syndrome ^ c))
    one = [1 << i for i in range(23)]
    two = [a | b for i, a in enumerate(one) for b in one[:i]]
    three = [a | b for a in two for b in one if b < (a & -a)]
    leader = np.zeros(2048, dtype=np.int64)
    for e in (one, two, three):
        leader[syndrome[e]] = e
    found: list[list[list[int]]] = [[], [], []]
    flips = [np.array([0]), np.array(one), np.array(two)]
    for s in range(2048):
        seen: set[int] = set()
        for k, f in enumerate(flips):
            offsets = set((f ^ leader[s ^ syndrome[f]]).tolist()) - seen
            found[k].append(sorted(offsets))
            seen |= offsets
    tables = []
    for k in range(3):
        width = max(map(len, found[k]))
        tables.append(np.array([x + [-1] * (width - len(x)) for x in found[k]], dtype=np.int64).reshape(2048, width))
    return syndrome, tables


def replicas(fps: np.ndarray, syndrome: np.ndarray, reach: list[np.ndarray], max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row number and anchor of every replica; the first ``len(fps)`` are the homes."""
    u = fps.view(np.uint64)
    mask = np.uint64((1 << 23) - 1)
    a = (u >> np.uint64(41)).astype(np.int64)
    b = (u >> np.uint64(18) & mask).astype(np.int64)
    sa, sb = syndrome[a], syndrome[b]
    rows, anchors = [], []
    for i in range(max_bits + 1):
        for j in range(max_bits + 1 - i):
            oa, ob = reach[i][sa], reach[j][sb]
            ok = (oa >= 0)[:, :, None] & (ob >= 0)[:, None, :]
            key = ((a[:, None] ^ oa) << 23)[:, :, None] | (b[:, None] ^ ob)[:, None, :]
            at = np.nonzero(ok)
            rows.append(at[0])
            anchors.append(key[at])
    return np.concatenate(rows), np.concatenate(anchors)


def links(distinct_fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """All links (u, v), u < v, between distinct fingerprints (column fp)."""
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2")
    small_batches(distinct_fps.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = None
        for b in batches:
            tables = tables or golay_tables()
            fps = b.column(0).to_numpy(zero_copy_only=False)
            if len(fps):
                row, anchor = replicas(fps, *tables, max_bits)
                home = np.zeros(len(row), dtype=bool)
                home[:len(fps)] = True
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fps[row]), pa.array(home)],
                                                 names=["anchor", "fp", "home"])

    placed = distinct_fps.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")
    home = placed.where("home").select("anchor", F.col("fp").alias("u"))
    visit = placed.select("anchor", F.col("fp").alias("v"))
    # Spark sizes ``visit`` by the fingerprints it is made of, not by their 60 to 70 replicas, and would broadcast it
    return home.join(visit.hint("merge"), "anchor").where(
        (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits)).select("u", "v")


def classes(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, class): class is the smallest fingerprint reachable; ``fps``: distinct fp."""
    linked = components(links(fps, max_bits))
    return (fps.join(linked.select(F.col("node").alias("fp"), F.col("component").alias("class")), "fp", "left")
            .select("fp", F.coalesce("class", "fp").alias("class")))


def _classed(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int, keep: list | None) -> DataFrame:
    """id, kept columns, fp, class and component_id of every document."""
    rows = materialize(fingerprints(docs, id_col, text_col, shingle, keep), "simhash")
    per_fp = materialize(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash_fp")
    cls = materialize(classes(per_fp.select("fp"), max_bits), "simhash_class")
    # every class's smallest id, then back to its fingerprints: both tables hold distinct fingerprints
    least = per_fp.join(cls, "fp").groupBy("class").agg(F.min("least").alias("component_id"))
    return rows.join(cls.join(least, "class"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id."""
    return _classed(docs, id_col, text_col, shingle, max_bits, None).select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                  max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each group: the smallest id (an id before none; then by
    a hash of the row). Rows alike in every column are one document."""
    cols = [F.col(f.name) for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    key = [F.xxhash64(*cols).alias(P + "r1"), F.xxhash64(F.lit("row"), *cols).alias(P + "r2")]
    rows = _classed(docs, id_col, text_col, shingle, max_bits, key)
    first = rows.groupBy("class").agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), P + "r1", P + "r2")).alias("w"))
    names = [P + "r1", P + "r2"]
    winners = materialize(first.select(*[F.col("w." + n).alias(n) for n in names]).distinct(), "simhash_winners")
    return docs.select("*", *key).join(winners, names).dropDuplicates(names).drop(*names)
