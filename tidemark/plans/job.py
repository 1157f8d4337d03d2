"""The daily job, from vendor files to exports: instrument list, fetch plan,
quote files, append, indicators, prediction, exports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ingest import fetch_plan, top_by_turnover
from tidemark.plans import ml as ML
from tidemark.session import materialize, scratch
from tidemark.sources import csv as CSV
from tidemark.sources.export import export
from tidemark.sources.sizing import maybe_broadcast
from tidemark.sources.store import Store


def load_instruments(spark: SparkSession, store: Store, list_path: str) -> None:
    """The instrument list becomes the ``stock`` table."""
    store.replace("stock", CSV.read_instrument_list(spark, list_path))


def planned_quotes(quotes: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows of ``quotes`` inside their instrument's [from, to) range."""
    p = maybe_broadcast(plan.select(F.col("isin").alias("_pk"), "from", "to"))
    return quotes.join(p, (quotes["isin"] == F.col("_pk")) & (quotes["date"] >= F.col("from")) & (quotes["date"] < F.col("to")),
                       "left_semi")


def ingest(spark: SparkSession, store: Store, list_path: str, quotes_path: str, top_n: int, as_of: dt.date) -> DataFrame:
    """List, ranges still to fetch for the ``top_n`` instruments by turnover, and
    the quote files' rows in those ranges; returns the fetch plan. Lines that are no quotes
    go to the table ``rejects``."""
    load_instruments(spark, store, list_path)
    listed = top_by_turnover(store.table("stock"), top_n)
    marks = store.high_water() if store.exists("quotation") else spark.createDataFrame([], "isin string, last_quotation date")
    plan = materialize(fetch_plan(listed, marks, as_of=F.lit(as_of)), "fetch_plan")
    store.ingest_quotes(quotes_path, lambda quotes: planned_quotes(quotes, plan))
    return plan


def predict(store: Store, model_dir: str, as_of: dt.date, learn: bool = False, **learn_options) -> None:
    """Scores of the recent rows become the ``prediction`` table."""
    if learn:
        ML.learn(store.table("data"), model_dir, **learn_options)
    recent = store.between("data", as_of - dt.timedelta(days=ML.RECENT_DAYS))  # only these months are read
    store.replace("prediction", ML.predict(recent, model_dir, as_of))


def run(spark: SparkSession, store: Store, list_path: str, quotes_path: str, model_dir: str, export_dir: str,
        top_n: int, as_of: dt.date, learn: bool = True, **learn_options) -> dict[str, str]:
    """The whole chain; returns the exported paths."""
    with scratch():
        ingest(spark, store, list_path, quotes_path, top_n, as_of)
        store.update_indicators()
        predict(store, model_dir, as_of, learn, **learn_options)
        return export(store, export_dir)
