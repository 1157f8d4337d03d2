"""The indicator plan, built wide.

``build_wide`` turns a quote table ``(isin, date, Open, High, Low, Close)``
into one row per (isin, date) with one column per series of the plan.  Spark
deals and sorts the rows once by (series, chunk); all series of the plan are
then computed on numpy blocks of whole chunks (``functions.kernels``).

The long store ``(isin, date, value, type)`` is a view of the wide table that
keeps exactly the rows the row-based operators produce (``long_view``);
``pivot`` is its inverse.

Precondition (kept by the ingest): (isin, date) is unique.  Rows with null
prices stay.  A missing Close leaves a performance series without a row where
its counterpart is missing; series over such a series look back over its
present rows, as the row-based operators do, and the chunks' halo grows by the
longest run of missing closes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import kernels as K
from tidemark.operators.sequence import CHUNK, DEFAULT_CHUNK_ROWS, HALO, ChunkPlan, series_blocks
from tidemark.plans import spec as S

KEY = "isin"
ORDER = "date"
PRESENT = "__p__"


def prepare_quotes(quotes: DataFrame) -> DataFrame:
    """Project the four prices; every row stays."""
    return quotes.select(F.col(KEY).cast("string").alias(KEY), F.col(ORDER),
                         *[F.col(c).cast("double").alias(c) for c in S.BASE])


def _built(quotes: DataFrame, plan, wanted: list[str], chunk_rows: int, bucket, chunks: ChunkPlan | None,
           make, fields: list[T.StructField]) -> DataFrame:
    """One pass over the quotes: ``make(steps, base, groups, halo, kept)`` is the task that
    computes the needed definitions and returns (isin, date) and ``fields``."""
    needed = S.closure(plan, wanted)
    back, fwd = S.reach(needed)
    q, gap = prepare_quotes(quotes), F.col("Close").isNull()
    steps = [(s.name, s.op, s.inputs, s.n) for layer in S.layering(needed)[1:] for s in layer]
    base = [s.name for s in needed if s.op == "base"]
    if chunks is None and "Close" not in base:
        chunks = ChunkPlan.of(q, KEY, ORDER, bucket, gap)
    schema = T.StructType([q.schema[KEY], q.schema[ORDER], *fields])
    task = make(steps, base, [KEY, CHUNK], HALO, [KEY, ORDER])
    return series_blocks(q.select(KEY, ORDER, *base), KEY, ORDER, task, schema, back, fwd, chunk_rows, bucket, chunks, gap)


def build_wide(quotes: DataFrame, plan=None, columns: list[str] | None = None,
               presence: bool = False, chunk_rows: int = DEFAULT_CHUNK_ROWS,
               bucket: str | None = None, chunks: ChunkPlan | None = None, grid: bool = False) -> DataFrame:
    """Wide indicator table.  ``columns`` restricts the output (only the
    needed definitions are computed); ``presence`` adds ``__p__<name>``
    flags used by ``long_view``; ``grid`` returns the values as longs on the
    grid of ``kernels.on_grid``, not as doubles."""
    plan = tuple(plan or S.standard_plan())
    wanted = columns or [s.name for s in plan]
    flags = [n for n in wanted if n not in S.BASE] if presence else []
    fields = [*[T.StructField(n, T.LongType() if grid else T.DoubleType()) for n in wanted],
              *[T.StructField(PRESENT + n, T.BooleanType()) for n in flags]]
    names = [KEY, ORDER, *[f.name for f in fields]]
    return _built(quotes, plan, wanted, chunk_rows, bucket, chunks,
                  lambda *a: K.wide_task(*a, wanted, flags, names, K.on_grid if grid else K.doubles), fields)


def _q(name: str) -> str:
    return "`" + name + "`"


def long_view(wide_with_presence: DataFrame, names: list[str]) -> DataFrame:
    """Unpivot to ``(isin, date, value, type)`` keeping only emitted rows."""
    entries = []
    for n in names:
        p = F.lit(True) if n in S.BASE else F.col(_q(PRESENT + n))
        entries.append(F.when(p, F.struct(F.col(_q(n)).alias("value"), F.lit(n).alias("type"))))
    e = F.explode(F.filter(F.array(*entries), lambda x: x.isNotNull())).alias("_e")
    return (wide_with_presence.select(KEY, ORDER, e)
            .select(KEY, ORDER, F.col("_e.value").alias("value"), F.col("_e.type").alias("type")))


def build_long(quotes: DataFrame, plan=None, columns: list[str] | None = None,
               chunk_rows: int = DEFAULT_CHUNK_ROWS, chunks: ChunkPlan | None = None) -> DataFrame:
    """The long rows of the plan, emitted by the tasks that compute the series."""
    plan = tuple(plan or S.standard_plan())
    wanted = columns or [s.name for s in plan]
    names = [KEY, ORDER, "value", "type"]
    return _built(quotes, plan, wanted, chunk_rows, None, chunks, lambda *a: K.long_task(*a, wanted, names),
                  [T.StructField("value", T.DoubleType()), T.StructField("type", T.StringType())])


def pivot(indicator: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Long -> wide with ``sum(value)`` per (isin, date, type).  Pass the
    column list: it saves the distinct-type job and fixes the schema, and the
    long rows of a (isin, date) are combined into one wide row before the
    shuffle (Spark's own pivot shuffles a row for each type)."""
    g = indicator.groupBy(KEY, ORDER)
    if columns is None:
        return g.pivot("type").agg(F.sum("value"))
    return g.agg(*[F.sum(F.when(F.col("type") == c, F.col("value"))).alias(c) for c in columns])


def stats(indicator: DataFrame) -> DataFrame:
    """Row count per series type, ordered by type."""
    return (indicator.groupBy("type").agg(F.count(F.lit(1)).alias("count"))
            .orderBy("type"))


def max_dates(indicator: DataFrame) -> DataFrame:
    """Latest date per (isin, type)."""
    return indicator.groupBy(KEY, "type").agg(F.max(ORDER).alias(ORDER))


def stats_wide(wide_with_presence: DataFrame, names: list[str]) -> DataFrame:
    """``stats`` of the long view without building it: one aggregate of the
    presence flags over the wide rows (69 sums instead of a 69x row shuffle)."""
    sums = [F.count(F.lit(1)).alias(n) if n in S.BASE
            else F.sum(F.col(_q(PRESENT + n)).cast("long")).alias(n) for n in names]
    one = wide_with_presence.agg(*sums)
    stack = ", ".join(f"'{n}', `{n}`" for n in names)
    return (one.selectExpr(f"stack({len(names)}, {stack}) as (type, count)")
            .orderBy("type"))


def max_dates_wide(wide_with_presence: DataFrame, names: list[str]) -> DataFrame:
    """``max_dates`` of the long view from the wide rows: one aggregate per
    instrument (partial aggregation map-side), then a per-instrument stack."""
    aggs = [F.max(F.col(ORDER) if n in S.BASE else F.when(F.col(_q(PRESENT + n)), F.col(ORDER))).alias(n)
            for n in names]
    per = wide_with_presence.groupBy(KEY).agg(*aggs)
    stack = ", ".join(f"'{n}', `{n}`" for n in names)
    return (per.selectExpr(KEY, f"stack({len(names)}, {stack}) as (type, {ORDER})")
            .where(F.col(ORDER).isNotNull()))
