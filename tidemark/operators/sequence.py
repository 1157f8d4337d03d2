"""Hot-key-safe ordered windows over per-instrument series.

A plain ``Window.partitionBy("isin").orderBy("date")`` sends every row of an
instrument to one task, so an instrument holding a third of the data would be
sorted and buffered by a single task.  Instead each series is cut into chunks
and windows run per (instrument, chunk):

* ``ChunkPlan`` counts the rows per (key, time bucket) with a map-side-combined
  aggregate; on that small table running sums give each bucket its row range,
  buckets are grouped into chunks of about ``chunk_rows`` rows, and the buckets
  that reach into the last ``back`` / first ``fwd`` rows of a chunk are marked
  as halo for the neighbouring chunk.
* ``series_window`` joins the rows to that plan (null-safe, so rows without a
  key or an order value stay) and shuffles them on (key, chunk).

The plan is lazy: nothing runs while a query is built, and the chunk size of a
series follows from its own buckets.  ``ChunkPlan.of(table).stored()`` writes
the counts once, so a chain of operators over one store shares them, and Spark
broadcasts the plan when its written size is below the session's threshold
(otherwise, or for a lazy plan, adaptive execution decides on measured sizes).

As long as ``back``/``fwd`` cover the total look-back/look-ahead of the chained
expressions, every non-halo row sees exactly the rows it would see in an
unsplit series; halo rows are dropped afterwards.  No group is larger than one
chunk (or one time bucket) of one series.

A bucket may hold too many rows itself (a day of ticks, rows without a date).
``split_buckets`` cuts such buckets into parts of about equal depth at order
values taken from a bounded sample by hash, and counts the parts again, until
none is over-full or holds a single value.  ``ChunkPlan.stored`` and
``number_rows`` do so; a lazy plan keeps whole buckets.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import materialize
from tidemark.sources.sizing import maybe_broadcast

RN = "_rn"
CHUNK = "_chunk"
HALO = "_halo"
BUCKET = "_bk"

# Rows per chunk: bounds the rows a single window task buffers.
DEFAULT_CHUNK_ROWS = 1 << 17

# Values sampled for each part that a bucket is cut into, the most parts one cut
# makes (a part still over-full is cut again), and the most rounds of cuts.
SAMPLE_PER_PART = 24
MAX_PARTS = 1024
MAX_ROUNDS = 8


def _bucket_expr(df: DataFrame, order: str, bucket) -> Column:
    """Coarse bucket of the order key (bounds the numbering groups and the
    halo granularity).  ``bucket`` is a unit name or, for numeric order keys,
    an integer width."""
    dt = df.schema[order].dataType
    if isinstance(bucket, int) and not isinstance(bucket, bool):
        return F.floor(F.col(order) / F.lit(bucket)).cast("long")
    if bucket is None:
        if isinstance(dt, T.DateType):
            bucket = "year"
        elif isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
            bucket = "day"
        else:
            bucket = "value"
    c = F.col(order)
    if bucket == "year":
        return F.year(c).cast("long")
    if bucket == "month":
        return (F.year(c) * 12 + F.month(c)).cast("long")
    if bucket == "day":
        return F.unix_date(F.to_date(c)).cast("long")
    if bucket == "hour":
        return F.floor(F.unix_micros(c.cast("timestamp")) / F.lit(3_600_000_000)).cast("long")
    if bucket == "value":
        # numeric order key: blocks of 4096 consecutive key values
        return F.floor(c / F.lit(4096)).cast("long")
    raise ValueError(f"unknown bucket {bucket!r}")


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet; the right side's keys are dropped."""
    r = right.select(*[F.col(f"`{c}`").alias(f"_r_{c}") if c in on else F.col(f"`{c}`") for c in right.columns])
    cond = reduce(lambda a, b: a & b, [left[c].eqNullSafe(r[f"_r_{c}"]) for c in on])
    return left.join(r, cond, how).drop(*[f"_r_{c}" for c in on])


def _part(cuts: Column, value: Column) -> Column:
    """How many of the ascending ``cuts`` are at most ``value`` (binary search)."""
    def step(acc: Column, _) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        above = (acc["lo"] < acc["hi"]) & (F.get(cuts, mid) <= value)
        return F.struct(F.when(above, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(above, acc["hi"]).otherwise(mid).alias("hi"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(cuts) + F.lit(1.0))).cast("int"))
    found = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi")), step)["lo"]
    return F.when(cuts.isNull(), F.lit(0)).otherwise(found)


def _with_part(rows: DataFrame, keys: list[str], cuts: DataFrame | None) -> DataFrame:
    """``rows`` (with ``_bk`` and ``_v``) and ``_p``, the row's part of its bucket."""
    if cuts is None:
        return rows.withColumn("_p", F.lit(0))
    there = join_null_safe(rows, maybe_broadcast(cuts), [*keys, BUCKET], "left")
    return there.withColumn("_p", _part(F.col("_cuts"), F.col("_v"))).drop("_cuts")


def split_buckets(rows: DataFrame, keys: list[str], value: Column, limit: int, counts: DataFrame) -> DataFrame | None:
    """(keys, _bk, _cuts): the values at which each bucket of more than ``limit`` rows is
    cut, or None if no bucket is over-full. Runs now.

    ``value`` is a struct that orders the rows. ``rows`` has ``_bk``; ``counts`` is the
    written (keys, _bk, _n). Values are sampled by their hash, so a run repeated finds the
    same cuts. Equal values stay together. Rounds look only at rows of over-full buckets."""
    full = counts.where(F.col("_n") > limit).select(*keys, BUCKET)
    if full.isEmpty():
        return None
    hot = join_null_safe(rows.withColumn("_v", value).select(*keys, BUCKET, "_v"), materialize(full, "full_buckets"), [*keys, BUCKET])
    at, cuts = [*keys, BUCKET, "_p"], None
    for salt in range(MAX_ROUNDS):
        v = _with_part(hot, keys, cuts)
        n = v.groupBy(*at).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
                               F.approx_count_distinct("_v").alias("_d"))
        n = n.where((F.col("_n") > limit) & (F.col("_lo") < F.col("_hi")))
        parts = F.least(F.ceil(F.col("_n") * 2 / limit).cast("int"), F.lit(MAX_PARTS))
        todo = materialize(n.select(*at, parts.alias("_parts"), (parts * SAMPLE_PER_PART / F.col("_d")).alias("_share")), "full_parts")
        if todo.isEmpty():
            break
        hashed = F.pmod(F.xxhash64(F.lit(salt), "_v"), F.lit(1 << 30)) / float(1 << 30)
        some = join_null_safe(v, maybe_broadcast(todo), at).where(hashed < F.col("_share"))
        some = some.groupBy(*at, "_parts").agg(F.sort_array(F.collect_set("_v")).alias("_s"))  # about 24 a part
        every = F.transform(F.sequence(F.lit(1), F.col("_parts") - 1),
                            lambda i: F.get("_s", F.floor(i * F.size("_s") / F.col("_parts")).cast("int")))
        new = some.select(*keys, BUCKET, F.explode(every).alias("_c"))
        if cuts is not None:
            new = new.unionByName(cuts.select(*keys, BUCKET, F.explode("_cuts").alias("_c")))
        cuts = materialize(new.groupBy(*keys, BUCKET).agg(F.sort_array(F.collect_set("_c")).alias("_cuts")), "bucket_cuts")
    return cuts


def cut_buckets(rows: DataFrame, keys: list[str], value: Column, cuts: DataFrame | None) -> DataFrame:
    """``rows`` with ``_bk`` as (bucket, part) where there are cuts."""
    if cuts is None:
        return rows
    part = F.struct(F.coalesce(F.col(BUCKET), F.lit(-1 << 63)).alias("b"), F.col("_p").alias("p"))
    return _with_part(rows.withColumn("_v", value), keys, cuts).withColumn(BUCKET, part).drop("_v", "_p")


def number_rows(df: DataFrame, key: str | list[str], order: str | list[str],
                bucket: str | None = None, out: str = RN, split_rows: int | None = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Append ``out`` = 0-based position of each row within its key, ordered
    by ``order`` (nulls first, ties broken by the remaining order columns).
    Rows with a null key are one series; every row stays.

    Buckets of more than ``split_rows`` rows are split first, by the order columns and then
    by a hash of the row, so ties and rows without an order value are split too (equal rows
    are not). This counts the rows now; with None nothing runs and no bucket is split."""
    keys = [key] if isinstance(key, str) else list(key)
    orders = [order] if isinstance(order, str) else list(order)
    with_bk = df.withColumn(BUCKET, _bucket_expr(df, orders[0], bucket))

    # The count branch reads only the key and order columns; feed a stored
    # table (or ``materialize`` a derived one) so it is a narrow re-scan.
    def count(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("_n"))

    counts = count(with_bk)
    if split_rows:
        counts = materialize(counts, "bucket_counts")
        hashed = [F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()]
        value = F.struct(*[F.col(o) for o in orders], F.xxhash64(*hashed).alias("_tie"))
        cuts = split_buckets(with_bk, keys, value, split_rows, counts)
        if cuts is not None:
            with_bk = cut_buckets(with_bk, keys, value, cuts)
            counts = materialize(count(with_bk), "bucket_counts")
    w_b = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, BUCKET, F.coalesce(F.sum("_n").over(w_b), F.lit(0)).alias("_start"))
    w_r = Window.partitionBy(*keys, BUCKET).orderBy(*orders)
    return (join_null_safe(with_bk, starts, [*keys, BUCKET])
            .withColumn(out, F.col("_start") + F.row_number().over(w_r) - 1)
            .drop(BUCKET, "_start"))


@dataclass(frozen=True)
class ChunkPlan:
    """Row counts of a table's (key, bucket) groups, and the chunks made of them.

    ``counts`` has, per bucket, the rows and those that a look-back over present
    rows has to pass (see ``targets``). ``cuts``: where over-full buckets are cut."""
    keys: tuple[str, ...]
    order: str
    bucket: object
    counts: DataFrame
    rows: DataFrame | None = None
    cuts: DataFrame | None = None

    @classmethod
    def of(cls, df: DataFrame, key: str | list[str], order: str, bucket=None, gap: Column | None = None) -> "ChunkPlan":
        keys = [key] if isinstance(key, str) else list(key)
        rows = df.withColumn(BUCKET, _bucket_expr(df, order, bucket)).withColumn("_gap", gap if gap is not None else F.lit(False))
        rows = rows.select(*keys, order, BUCKET, "_gap")
        return cls(tuple(keys), order, bucket, cls._count(rows, keys), rows)

    @staticmethod
    def _count(rows: DataFrame, keys) -> DataFrame:
        return rows.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("_n"), F.count_if("_gap").alias("_g"))

    def stored(self, split_rows: int = DEFAULT_CHUNK_ROWS) -> "ChunkPlan":
        """The same plan over counts written once (one job, now). Buckets of more than
        ``split_rows`` rows are split by the order value; rows that tie, or have none, stay
        together."""
        plan = replace(self, counts=materialize(self.counts, "chunk_counts"))
        if self.rows is None:
            return plan
        keys, value = list(self.keys), F.struct(F.col(self.order))
        cuts = split_buckets(self.rows, keys, value, split_rows, plan.counts)
        if cuts is None:
            return plan
        counts = self._count(cut_buckets(self.rows, keys, value, cuts), keys)
        return replace(plan, counts=materialize(counts, "chunk_counts"), cuts=cuts)

    def targets(self, back: int, fwd: int, chunk_rows: int) -> DataFrame:
        """(keys, bucket, _targets): the chunks each bucket goes to, with a halo flag.

        Chunks are runs of whole buckets: bucket k (rows [start, end) of its
        series) belongs to chunk ``floor(start / C)``.  With every bucket of
        the series holding at most B rows and ``C > B + max(back, fwd)``,
        every chunk but the last spans more than ``max(back, fwd)`` rows, so
        halo rows only ever come from the adjacent chunk.  ``back`` grows by
        the most gap rows of adjoining buckets that have any: no run of gap
        rows is longer."""
        by_key = Window.partitionBy(*self.keys).orderBy(BUCKET)
        whole_key = Window.partitionBy(*self.keys)
        so_far = by_key.rowsBetween(Window.unboundedPreceding, 0)
        t = self.counts.withColumn("_run", F.count(F.when(F.col("_g") == 0, 1)).over(so_far))
        t = t.withColumn("_run", F.sum("_g").over(Window.partitionBy(*self.keys, "_run")))
        t = t.withColumn("_back", F.lit(back) + (F.max("_run").over(whole_key) if back else F.lit(0)))
        t = t.withColumn("_C", F.greatest(F.lit(int(chunk_rows)).cast("long"),
                                          F.max("_n").over(whole_key) + F.greatest(F.col("_back"), F.lit(fwd)) + 1))
        t = (t.withColumn("_end", F.sum("_n").over(so_far)).withColumn("_start", F.col("_end") - F.col("_n"))
             .withColumn("_c", F.expr("_start div _C")))
        t = t.withColumn("_pc", F.lag("_c").over(by_key)).withColumn("_nc", F.lead("_c").over(by_key))
        by_chunk = Window.partitionBy(*self.keys, "_c")
        t = (t.withColumn("_cs", F.min("_start").over(by_chunk)).withColumn("_ce", F.max("_end").over(by_chunk))
             .withColumn("_prev", F.max(F.when(F.col("_start") == F.col("_cs"), F.col("_pc"))).over(by_chunk))
             .withColumn("_next", F.max(F.when(F.col("_end") == F.col("_ce"), F.col("_nc"))).over(by_chunk)))
        entries = F.array(
            F.struct(F.col("_c").alias("c"), F.lit(False).alias("h")),
            F.when((F.col("_end") > F.col("_ce") - F.col("_back")) & F.col("_next").isNotNull(),
                   F.struct(F.col("_next").alias("c"), F.lit(True).alias("h"))),
            F.when((F.col("_start") < F.col("_cs") + fwd) & F.col("_prev").isNotNull(),
                   F.struct(F.col("_prev").alias("c"), F.lit(True).alias("h"))),
        )
        return t.select(*self.keys, BUCKET, F.filter(entries, lambda x: x.isNotNull()).alias("_targets"))


def chunked(df: DataFrame, key: str | list[str], order: str, back: int, fwd: int,
            chunk_rows: int = DEFAULT_CHUNK_ROWS, bucket=None, plan: ChunkPlan | None = None,
            gap: Column | None = None) -> DataFrame:
    """``df`` with ``_chunk`` and ``_halo``: each row once in its own chunk, and
    again as halo of a neighbour that looks back or ahead to it."""
    keys = [key] if isinstance(key, str) else list(key)
    plan = plan or ChunkPlan.of(df, keys, order, bucket, gap)
    with_bk = df.withColumn(BUCKET, _bucket_expr(df, order, plan.bucket))
    with_bk = cut_buckets(with_bk, list(plan.keys), F.struct(F.col(plan.order)), plan.cuts)
    rows = join_null_safe(with_bk, plan.targets(back, fwd, chunk_rows), [*plan.keys, BUCKET])
    return (rows.withColumn("_e", F.explode("_targets"))
            .withColumns({CHUNK: F.col("_e.c"), HALO: F.col("_e.h")}).drop("_e", "_targets", BUCKET))


def series_window(df: DataFrame, key: str | list[str], order: str | list[str],
                  layers: Callable[[DataFrame, Window], DataFrame],
                  back: int, fwd: int, chunk_rows: int = DEFAULT_CHUNK_ROWS,
                  bucket=None, plan: ChunkPlan | None = None, gap: Column | None = None) -> DataFrame:
    """Run ``layers(df, w)`` (which adds window columns over ``w``) on a
    chunked copy of ``df`` and return only the real rows.

    Windows are ordered by ``order``, which should be unique per key (rows
    that tie stand in any order, all of them stay).  ``plan``: counts shared
    with other operators over the same rows, or over a superset of them whose
    extra rows are edge rows or counted as gaps.  ``gap``: rows that a series
    skips when it looks back over present rows."""
    keys = [key] if isinstance(key, str) else list(key)
    orders = [order] if isinstance(order, str) else list(order)
    w = Window.partitionBy(*keys, CHUNK).orderBy(*orders)
    out = layers(chunked(df, keys, orders[0], back, fwd, chunk_rows, bucket, plan, gap), w)
    return out.where(~F.col(HALO)).drop(CHUNK, HALO)


def series_blocks(df: DataFrame, key: str | list[str], order: str | list[str], task, schema: T.StructType,
                  back: int, fwd: int, chunk_rows: int = DEFAULT_CHUNK_ROWS,
                  bucket=None, plan: ChunkPlan | None = None, gap: Column | None = None) -> DataFrame:
    """``series_window`` for a ``mapInArrow`` function: the chunked copy of ``df``, halo rows
    and all, dealt by (key, chunk) and sorted by ``order`` inside. ``task`` leaves the halo out."""
    keys = [key] if isinstance(key, str) else list(key)
    orders = [order] if isinstance(order, str) else list(order)
    rows = chunked(df, keys, orders[0], back, fwd, chunk_rows, bucket, plan, gap)
    return rows.repartition(*keys, CHUNK).sortWithinPartitions(*keys, CHUNK, *orders).mapInArrow(task, schema)
