"""Row-series operators: add one column to a per-instrument ordered frame.

These keep every input row (unlike the long-store operators, which drop
edge rows), also rows with a null key (one series) or a null order value
(first in its series), and follow the row-series conventions:

* ``performance(n)``: ``x[t] / x[t+n] - 1`` for both signs of ``n`` (n > 0
  compares with the future), ``derivative(n)``: ``x[t] - x[t+n]``.  A NULL or
  zero operand gives 0.0; a row without counterpart gives NULL.
* ``rate``: ``a / b - 1`` per row, 0.0 when an operand is NULL or b is 0.
* ``ema``: ``y = x * r + y_prev * (1 - r)`` seeded with the first value; a
  NULL input gives NULL and the next value re-seeds.

Series are identified by ``key`` and ordered by ``order``; the physical order
and partitioning of the input never matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators.sequence import (CHUNK, DEFAULT_CHUNK_ROWS, HALO, ChunkPlan, chunked,
                                         join_null_safe, series_window)


def _zero_or(value, *operands_nonzero):
    cond = None
    for o in operands_nonzero:
        c = o.isNull() | (o == 0)
        cond = c if cond is None else cond | c
    return F.when(cond, F.lit(0.0)).otherwise(value)


def _paired(df: DataFrame, src: str, to: str, n: int, key: str, order: str,
            combine, chunk_rows: int, bucket=None, plan: ChunkPlan | None = None) -> DataFrame:
    def run(d, w):
        x = F.col(src).cast("double")
        other = C.shifted(x, n, w)
        exists = C.shifted(F.lit(1), n, w).isNotNull()
        v = F.when(exists, _zero_or(combine(x, other), x, other))
        return d.select("*", v.alias(to))

    return series_window(df, key, order, run, max(-n, 0), max(n, 0), chunk_rows, bucket, plan)


def performance(df: DataFrame, src: str, to: str, n: int, key: str = "ISIN",
                order: str = "date", chunk_rows: int = DEFAULT_CHUNK_ROWS, bucket=None,
                plan: ChunkPlan | None = None) -> DataFrame:
    return _paired(df, src, to, n, key, order, lambda a, b: F.try_divide(a, b) - 1, chunk_rows, bucket, plan)


def derivative(df: DataFrame, src: str, to: str, n: int, key: str = "ISIN",
               order: str = "date", chunk_rows: int = DEFAULT_CHUNK_ROWS, bucket=None,
               plan: ChunkPlan | None = None) -> DataFrame:
    return _paired(df, src, to, n, key, order, lambda a, b: a - b, chunk_rows, bucket, plan)


def rate(df: DataFrame, a: str, b: str, to: str) -> DataFrame:
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    v = F.when(x.isNull() | y.isNull() | (y == 0), F.lit(0.0)).otherwise(x / y - 1)
    return df.withColumn(to, v)


# --- exponential moving average ----------------------------------------------
#
# With a = 1 - r, a segment of non-NULL values starting at row s has
#     y[t] = a^(t-s) x[s] + r * sum_{k=s+1..t} a^(t-k) x[k].
# Rows of a chunk are cut into blocks of S rows. Inside a block the sum is a
# window running sum of a^-(k-b) x[k] (b = block start; S keeps the powers
# finite); the EMA before the block enters as a^(t-b+1) times the value at the
# previous block's end, which older blocks no longer change (a^S < 1e-130).
#
# What lies H rows back has weight a^H < e^-FADE = 1e-130, as a block has, so it
# can show in a double only beside values smaller by 114 orders of magnitude. So
# the EMA is a window operator with H halo rows, in which the first row of a
# chunk's halo stands for the unseen past. A slow rate (H above MAX_HALO, and
# r = 0) carries the exact value from chunk to chunk instead.

FADE = 300
MAX_HALO = 1 << 16
CARRY_BLOCK = 1024


def _local(d: DataFrame, keys: list[str], w: Window, x: Column, r: float, a: float, rows: int, seeded: bool) -> DataFrame:
    """Adds _x, _rn, _s (start of the row's segment in its chunk, null-run aware),
    _rel (row in its block), _own (EMA of the block's own rows of the segment).
    ``seeded``: the chunk's first row stands for the past; else it adds r * x only."""
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_x", x).withColumn("_rn", F.row_number().over(w) - 1)
    d = d.withColumn("_s", F.max(F.when(F.col("_x").isNull(), F.col("_rn") + 1)).over(so_far))
    d = d.withColumn("_seg", F.coalesce("_s", F.lit(0))).withColumn("_b", F.expr(f"_rn div {rows}"))
    d = d.withColumn("_rel", (F.col("_rn") % rows).cast("double"))
    seed = (F.col("_rn") == F.col("_seg")) & (F.lit(True) if seeded else F.col("_s").isNotNull())
    term = F.when(F.col("_x").isNull(), F.lit(0.0)).otherwise(
        F.when(seed, F.col("_x")).otherwise(F.col("_x") * r) * F.pow(F.lit(a), -F.col("_rel")))
    own = Window.partitionBy(*keys, CHUNK, "_b", "_seg").orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_own", F.sum(term).over(own) * F.pow(F.lit(a), F.col("_rel")))
    end = F.when(F.col("_rel") == rows - 1, F.col("_own"))
    before = F.last(end, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    older = F.when(F.col("_seg") < F.col("_b") * rows, before * F.pow(F.lit(a), F.col("_rel") + 1))
    y = F.when(seed, F.col("_x")).otherwise(F.col("_own") + F.coalesce(older, F.lit(0.0)))  # a seed is the value itself
    return d.withColumn("_own", F.when(F.col("_x").isNotNull(), y))


_WORK = ["_x", "_rn", "_s", "_seg", "_b", "_rel", "_own"]


def ema(df: DataFrame, src: str, to: str, rate: float = 0.2, key: str = "ISIN", order: str = "date",
        chunk_rows: int = DEFAULT_CHUNK_ROWS, bucket=None, plan: ChunkPlan | None = None) -> DataFrame:
    """``to`` = the EMA of ``src``.  Missing values are nulls; a NaN or infinite value
    spoils the rows after it, up to the next null or for as long as the form of the
    sum remembers it (at least the rest of its block)."""
    if not 0 <= rate <= 1:
        raise ValueError("the rate of an EMA lies between 0 and 1")
    x = F.col(src).cast("double")
    if rate == 1:
        return df.withColumn(to, x)
    a = 1.0 - rate
    fade = -math.log(a) if a < 1 else 0.0
    if fade * MAX_HALO < FADE:
        return _slow_ema(df, x, to, rate, a, key, order, chunk_rows, bucket, plan)
    halo, rows = math.ceil(FADE / fade), max(2, int(FADE / fade))
    return series_window(df, key, order, lambda d, w: _local(d, [key], w, x, rate, a, rows, True)
                         .withColumn(to, F.col("_own")).drop(*_WORK), halo, 0, chunk_rows, bucket, plan)


def _compose(maps: Column) -> Column:
    """Prefix compositions of an ordered array of affine maps (c, a, b): v -> a v + b."""
    none = F.array().cast("array<struct<c:bigint,a:double,b:double>>")

    def add(acc: Column, m: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        joined = F.when(F.size(acc) == 0, F.struct(m["c"].alias("c"), m["a"].alias("a"), m["b"].alias("b"))).otherwise(
            F.struct(m["c"].alias("c"), (m["a"] * last["a"]).alias("a"),
                     (F.when(m["a"] == 0, F.lit(0.0)).otherwise(m["a"] * last["b"]) + m["b"]).alias("b")))
        return F.concat(acc, F.array(joined))

    return F.aggregate(maps, none, add)


def _slow_ema(df: DataFrame, x: Column, to: str, r: float, a: float, key: str, order: str, chunk_rows: int, bucket,
              plan: ChunkPlan | None) -> DataFrame:
    """The EMA entering each chunk is a scan over one affine map per chunk, composed in
    blocks of CARRY_BLOCK chunks and then over the blocks of a series."""
    w = Window.partitionBy(key, CHUNK).orderBy(order)
    d = _local(chunked(df, key, order, 0, 0, chunk_rows, bucket, plan), [key], w, x, r, a, 1 << 30, False)
    last = F.max_by(F.struct("_x", "_own", "_s"), "_rn")
    chunks = (d.groupBy(key, CHUNK).agg(F.count("*").alias("n"), F.min_by("_x", "_rn").alias("x0"), last.alias("l"))
              .select(key, CHUNK, "n", "x0", F.col("l._x").isNull().alias("ends_null"), F.col("l._s").isNotNull().alias("nulls"),
                      F.coalesce("l._own", F.lit(0.0)).alias("own")))
    by_key = Window.partitionBy(key).orderBy(CHUNK)
    chunks = chunks.withColumn("_fresh", F.coalesce(F.lag("ends_null").over(by_key), F.lit(True)))
    fade = F.pow(F.lit(a), F.col("n").cast("double"))
    entry = F.struct(F.col(CHUNK).cast("long").alias("c"),
                     F.when(F.col("_fresh") | F.col("nulls"), F.lit(0.0)).otherwise(fade).alias("a"),
                     F.when(F.col("_fresh") & ~F.col("nulls"), F.col("own") + fade * F.coalesce("x0", F.lit(0.0)))
                     .otherwise(F.col("own")).alias("b"))
    blocks = (chunks.groupBy(key, F.expr(f"{CHUNK} div {CARRY_BLOCK}").alias("_j"))
              .agg(_compose(F.sort_array(F.collect_list(entry))).alias("m")))
    tops = (blocks.select(key, "_j", F.element_at("m", -1).alias("t"))
            .groupBy(key).agg(_compose(F.sort_array(F.collect_list(
                F.struct(F.col("_j").cast("long").alias("c"), F.col("t.a").alias("a"), F.col("t.b").alias("b"))))).alias("m"))
            .select(key, F.explode("m").alias("t")).select(key, (F.col("t.c") + 1).alias("_j"), F.col("t.b").alias("_in")))
    ends = join_null_safe(blocks, tops, [key, "_j"], "left").select(key, F.explode("m").alias("e"), "_in").select(
        key, (F.col("e.c") + 1).alias(CHUNK), (F.col("e.a") * F.coalesce("_in", F.lit(0.0)) + F.col("e.b")).alias("_end"))
    # the value before a chunk: the previous chunk's end, or, after a null or at the start, the chunk's own first value
    carry = join_null_safe(chunks.select(key, CHUNK, "x0", "_fresh"), ends, [key, CHUNK], "left").select(
        key, CHUNK, F.when(F.col("_fresh"), F.col("x0")).otherwise(F.col("_end")).alias("_carry"))
    y = F.when(F.col("_s").isNotNull() | F.col("_x").isNull(), F.col("_own")).otherwise(
        F.col("_own") + F.pow(F.lit(a), (F.col("_rn") + 1).cast("double")) * F.col("_carry"))
    return join_null_safe(d, carry, [key, CHUNK]).withColumn(to, y).drop("_carry", CHUNK, HALO, *_WORK)
