"""Resample trade-like rows into OHLCV quote bars.

The test tables carry no quotes, so two adapters derive quote series from
them (stand-ins for the quotation table):

* ``supplier_day``: one series per supplier, one bar per ship day, price =
  extended price / quantity.
* ``event_hour``: one series per event type, one bar per hour, price = value.

Open/Close are the first/last price under a *total* order inside the bar
(tie-breakers make it deterministic); the aggregation is one hash/sort
aggregate, keyed on (series, bar) so a hot series spreads over all its bars.
Bars of many rows are combined map-side first. Where a bar has about one row
(a supplier's day) that combines nothing, and a partial bar, with both prices
and their order keys, is several times its row: there the rows themselves are
shuffled, and sorted on disk if need be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUOTE_COLS = ["isin", "date", "Open", "High", "Low", "Close",
              "Number_of_Shares", "Number_of_Trades", "Turnover"]


def bars(df: DataFrame, isin: Column, ts: Column, price: Column, unit: str,
         order: list[Column], volume: Column | None = None, rows_of: list[str] | None = None) -> DataFrame:
    """OHLCV bars of ``price`` per (``isin``, ``unit`` bucket of ``ts``).

    ``order`` is the total order of rows inside a bar (first = open). ``rows_of``: the
    columns that price, order and volume need, to shuffle rows and not partial bars."""
    if unit == "day":
        bar = F.to_date(ts)
    elif unit in ("hour", "minute", "second"):
        bar = F.date_trunc(unit, ts).cast("timestamp_ntz")
    else:
        raise ValueError(f"unsupported bar unit {unit!r}")
    vol = volume if volume is not None else F.lit(1.0)
    ordkey = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)])
    key = [isin.cast("string").alias("isin"), bar.alias("date")]
    if rows_of is not None:
        df, key = df.select(*key, *rows_of).repartition("isin", "date"), ["isin", "date"]
    rows = df.select(*key, price.cast("double").alias("_p"), vol.cast("double").alias("_v"),
                     ordkey.alias("_k"))
    return (rows.groupBy("isin", "date")
            .agg(F.min_by("_p", "_k").alias("Open"),
                 F.max("_p").alias("High"),
                 F.min("_p").alias("Low"),
                 F.max_by("_p", "_k").alias("Close"),
                 F.sum("_v").alias("Number_of_Shares"),
                 F.count(F.lit(1)).cast("double").alias("Number_of_Trades"),
                 F.sum(F.col("_p") * F.col("_v")).alias("Turnover")))


def supplier_day(lineitem: DataFrame) -> DataFrame:
    li = lineitem
    return bars(li,
                isin=F.col("l_suppkey"),
                ts=F.col("l_shipdate"),
                price=F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")),
                unit="day",
                order=[F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"),
                       F.col("l_extendedprice")],
                volume=F.col("l_quantity"),
                rows_of=["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"])


def event_hour(events: DataFrame) -> DataFrame:
    return bars(events,
                isin=F.col("event_type"),
                ts=F.col("ts"),
                price=F.col("value"),
                unit="hour",
                order=[F.col("ts"), F.col("event_id")])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def supplier_day_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplier_day(read_table(spark, sf_dir, "lineitem"))


def event_hour_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_hour(read_table(spark, sf_dir, "events"))
