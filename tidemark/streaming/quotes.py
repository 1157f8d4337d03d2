"""Structured Streaming ingestion of quote files.

New vendor files dropped in a folder are parsed with the declared schema and
appended micro-batch by micro-batch with the same high-water-mark rule as the
batch ingest: a row is kept only if it is newer than the instrument's latest
stored date.  A replayed micro-batch (after a failure) therefore appends
nothing twice.  Progress is tracked in ``checkpoint`` (a shared folder).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.csv import QUOTE_SCHEMA, parse_quotes


def quote_stream(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    r = (spark.readStream.schema(QUOTE_SCHEMA)
         .option("sep", ",").option("header", "false").option("mode", "PERMISSIVE"))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return parse_quotes(r.csv(folder))


def start_quote_ingest(spark: SparkSession, folder: str, store, checkpoint: str,
                       available_now: bool = True) -> StreamingQuery:
    """Append new quotes from ``folder`` into ``store``'s quotation table."""

    def append_batch(batch: DataFrame, epoch_id: int) -> None:
        store.append_quotes(batch)

    w = (quote_stream(spark, folder).writeStream
         .foreachBatch(append_batch)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
