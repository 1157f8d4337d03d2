"""Helpers shared by the training-data operators.

Functions that run inside Python workers are pickled by value (`by_value`), so a
cluster needs no copy of this package on its workers.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_value(module: str) -> None:
    """Ship ``module``'s functions to Python workers as code, not as an import."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)

#: The six ASCII whitespace characters of the contracts, as a regex class body.
SPACE = r"\x20\x09-\x0D"
#: Bytes of text that one vectorised step of a Python worker takes at a time.
CHUNK_BYTES = 1 << 20
#: Rows per Arrow batch: a batch of long documents stays far below a worker's memory.
BATCH_ROWS = 512

#: Work columns carry this prefix so that a user's own columns cannot clash.
P = "__tm_"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch (a session setting, lowered, never raised)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds`` (a null id counts as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def sample_ids(rows: DataFrame, id_col: str, by: list[str], per_group: int, seed: int) -> DataFrame:
    """At most ``per_group`` rows for each value of ``by`` (not null), the smallest by a
    seeded hash.

    The groups are counted first, and only hashes below a bound that leaves a little more
    than enough rows go on, so the ranking of a group is small however large the group.
    """
    space, spare = 1 << 40, 1.5
    names = {c: P + f"by{i}" for i, c in enumerate(by)}
    counts = rows.groupBy(*by).agg(F.count("*").alias(P + "n")).withColumnsRenamed(names)
    u = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(space))
    enough = F.lit((per_group * spare + 256) * space) / F.col(P + "n")
    same = [F.col(c) == F.col(n) for c, n in names.items()]
    near = rows.withColumn(P + "u", u).join(counts, same).where(F.col(P + "u") < enough)
    rank = F.row_number().over(W.partitionBy(*by).orderBy(P + "u", id_col))
    return near.withColumn(P + "r", rank).where(F.col(P + "r") <= per_group).drop(P + "u", P + "r", P + "n", *names.values())


# --- vectorised text ----------------------------------------------------------

def chunks(blobs: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges holding about ``limit`` bytes each; a longer text is a range of its own."""
    lo = size = 0
    for i, b in enumerate(blobs):
        if i > lo and size + len(b) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(b)
    if lo < len(blobs):
        yield lo, len(blobs)


def ascii_lower() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def word_bytes() -> np.ndarray:
    """ASCII letters and digits, and every byte of a non-ASCII character."""
    t = np.zeros(256, dtype=bool)
    t[48:58] = t[65:91] = t[97:123] = True
    t[128:] = True
    return t


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, plain: int = 64) -> np.ndarray:
    """A 64-bit hash of each byte span: all spans advance one byte at a time together;
    spans over ``plain`` bytes are hashed one by one, so one endless word costs no more."""
    n = len(start)
    length = end - start
    h = np.full(n, 0xCBF29CE484222325, dtype=np.uint64)
    if not n:
        return h
    order = np.argsort(-np.minimum(length, plain + 1), kind="stable")
    s, ln = start[order], length[order]
    long_n = int(np.searchsorted(-ln, -plain, side="left"))
    hs = h[order]
    alive = n
    for k in range(int(min(ln[long_n] if long_n < n else 0, plain))):
        alive = int(np.searchsorted(-ln, -k, side="left"))
        hs[long_n:alive] = (hs[long_n:alive] ^ data[s[long_n:alive] + k]) * np.uint64(0x100000001B3)
    raw = data.tobytes() if long_n else b""
    for i in range(long_n):
        hs[i] = xxhash.xxh64_intdigest(raw[s[i]:s[i] + ln[i]])
    h[order] = hs
    return mix64(h)


def joined(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes in one array, each followed by a newline, and their offsets."""
    data = np.frombuffer(b"\n".join(blobs) + b"\n", dtype=np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(b) + 1 for b in blobs]))).astype(np.int64)
    return data, offsets


def as_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes, null as empty."""
    import pyarrow as pa

    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]
