"""Row-based indicator operators over the long store.

The long store holds one row per (isin, date, type) with a ``value``.  Each
operator reads the rows of its input type(s) and returns new long rows
``(isin, date, value, type)``, with the row semantics of the original SQL
operators: performance / derivative drop rows without a counterpart, binary
series are inner joins on (isin, date), labels keep one row per source row.

Windowed operators go through ``series_window`` (hot-key-safe chunking), joins
are plain equi-joins on (isin, date).  All series of one store stand on the same
(isin, date) rows, so a chain of operators shares one ``chunk_plan`` of its
quotes (``plan=``): each step then adds one pass over its input and no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions import names as N
from tidemark.operators.sequence import DEFAULT_CHUNK_ROWS, ChunkPlan, series_window

KEY, ORDER = "isin", "date"
LONG_COLS = [KEY, ORDER, "value", "type"]


def _typed(ind: DataFrame, t: str) -> DataFrame:
    return ind.where(F.col("type") == t).select(KEY, ORDER, "value")


def _emit(df: DataFrame, value: Column, t: str) -> DataFrame:
    return df.select(KEY, ORDER, value.cast("double").alias("value"), F.lit(t).alias("type"))


def _windowed(ind: DataFrame, src: str, to: str, make, back: int, fwd: int,
              keep: Column | None = None, chunk_rows: int = DEFAULT_CHUNK_ROWS,
              plan: ChunkPlan | None = None) -> DataFrame:
    def run(df, w):
        out = df.select("*", make(F.col("value"), w).alias("_v"))
        if keep is not None:
            out = out.select("*", keep(F.col("value"), w).alias("_keep"))
        return out

    res = series_window(_typed(ind, src), KEY, ORDER, run, back, fwd, chunk_rows, plan=plan)
    if keep is not None:
        res = res.where(F.col("_keep"))
    return _emit(res, F.col("_v"), to)


def base_series(quotes: DataFrame, names=("Close", "Open", "Low", "High")) -> DataFrame:
    """Quote prices as long rows (one ``stack`` instead of four scans)."""
    stack = ", ".join(f"'{n}', `{n}`" for n in names)
    return quotes.selectExpr(f"cast({KEY} as string) as {KEY}", ORDER,
                             f"stack({len(names)}, {stack}) as (type, value)").select(*LONG_COLS)


def chunk_plan(quotes: DataFrame, bucket=None) -> ChunkPlan:
    """The plan shared by the operators over the series of ``quotes``. Rows without a
    closing price count as gaps: a chained series may have no row there."""
    return ChunkPlan.of(quotes.withColumn(KEY, F.col(KEY).cast("string")), KEY, ORDER, bucket, gap=F.col("Close").isNull())


def sma(ind: DataFrame, src: str, to: str, n: int, **kw) -> DataFrame:
    return _windowed(ind, src, to, lambda x, w: C.sma(x, n, w), n - 1, 0, **kw)


def ma_plus(ind: DataFrame, src: str, to: str, n: int, **kw) -> DataFrame:
    return _windowed(ind, src, to, lambda x, w: C.ma_plus(x, n, w), n - 1, 0, **kw)


def stddev(ind: DataFrame, src: str, n: int, **kw) -> DataFrame:
    return _windowed(ind, src, N.stddev_name(src, n),
                     lambda x, w: C.rolling_stddev(x, n, w), n, 0, **kw)


def _counterpart(n: int):
    return lambda x, w: C.shifted(x, n, w).isNotNull()


def performance(ind: DataFrame, src: str, n: int, **kw) -> DataFrame:
    """Relative change; rows whose counterpart value is missing are dropped."""
    return _windowed(ind, src, N.perf_name(src, n), lambda x, w: C.performance(x, n, w),
                     max(-n, 0), max(n, 0), keep=_counterpart(n), **kw)


def derivative(ind: DataFrame, src: str, n: int, **kw) -> DataFrame:
    return _windowed(ind, src, N.deriv_name(src, n), lambda x, w: C.derivative(x, n, w),
                     max(-n, 0), max(n, 0), keep=_counterpart(n), **kw)


def _pair(ind: DataFrame, a: str, b: str) -> DataFrame:
    left = _typed(ind, a).withColumnRenamed("value", "_a")
    right = _typed(ind, b).withColumnRenamed("value", "_b")
    return left.join(right, [KEY, ORDER], "inner")


def bollinger(ind: DataFrame, src: str, sd_type: str) -> DataFrame:
    """High and low bands ``x +/- 2 sd`` (one join, two rows per match)."""
    j = _pair(ind, src, sd_type)
    e = F.explode(F.array(
        F.struct(C.boll_high(F.col("_a"), F.col("_b")).alias("value"),
                 F.lit(N.boll_high_name(src)).alias("type")),
        F.struct(C.boll_low(F.col("_a"), F.col("_b")).alias("value"),
                 F.lit(N.boll_low_name(src)).alias("type")))).alias("_e")
    return j.select(KEY, ORDER, e).select(KEY, ORDER, "_e.value", "_e.type")


def diff(ind: DataFrame, a: str, b: str) -> DataFrame:
    return _emit(_pair(ind, a, b), C.diff(F.col("_a"), F.col("_b")), N.diff_name(a, b))


def rate(ind: DataFrame, a: str, b: str) -> DataFrame:
    return _emit(_pair(ind, a, b), C.rate(F.col("_a"), F.col("_b")), N.rate_name(a, b))


def classification(ind: DataFrame, src: str = "P-XS+15") -> DataFrame:
    return _emit(_typed(ind, src), C.classify(F.col("value")), N.CLASS_NAME)


def bin_gt(ind: DataFrame, src: str, threshold: int) -> DataFrame:
    return _emit(_typed(ind, src), C.bin_gt(F.col("value"), threshold), N.gt_name(threshold))


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
