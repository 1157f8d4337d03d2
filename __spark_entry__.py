"""

Every query reads the given parquet tables (quote series are derived from
``lineitem`` — supplier x ship-day bars — and ``events`` — event-type x hour
bars; the instrument list and watchlist from ``supplier``/``nation``/
``region``).  Doubles are returned quantised to BIGINTs (1e-6 grid, eight
significant digits above 1e4) on both sides of the comparison; the library
API itself returns raw doubles.
"""

from __future__ import annotations

import datetime as dt
import os
import sys
import uuid
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Column, DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from tidemark.functions.precision import PrecisionReducer  # noqa: E402
from tidemark.operators import ingest as ING  # noqa: E402
from tidemark.operators import longform as LF  # noqa: E402
from tidemark.operators import series as SR  # noqa: E402
from tidemark.plans import indicators as IND  # noqa: E402
from tidemark.plans import ml as ML  # noqa: E402
from tidemark.plans import oracle as O  # noqa: E402
from tidemark.plans import reports as REP  # noqa: E402
from tidemark.plans import spec as S  # noqa: E402
from tidemark.session import checkpoint_dir, materialize  # noqa: E402
from tidemark.sources import bars as B  # noqa: E402
from tidemark.sources import csv as CSV  # noqa: E402
from tidemark.sources import export as EX  # noqa: E402
from tidemark.sources import fixtures as FX  # noqa: E402
from tidemark.sources.store import Store  # noqa: E402

try:  # the training-data operators and their pipeline can be taken out as a whole
    import corpus_pipeline
    from tidemark.llm import queries as LLM
except ImportError as missing:  # they, or a package that only they use, are not there
    print(f"training-data queries are left out: {missing}", file=sys.stderr)
    corpus_pipeline = LLM = None

SF_SMOKE = "/root/testdata/sf0.001"

# Fixed parameters of the registered queries.
AS_OF = dt.date(1998, 8, 2)          # "today" of the recent-window reports
SPLIT = dt.date(1998, 1, 1)          # stored / new cut for the ingestion queries
WRONG_FROM = dt.date(1997, 11, 3)
INCREMENTS = [dt.date(1998, 2, 1), dt.date(1998, 5, 11), dt.date(2100, 1, 1)]
JOB_SHIFT, JOB_CUT, JOB_TOP = 3653, dt.date(2007, 1, 1), 8  # after the first day ever requested
NULL_DAY = dt.date(1995, 6, 17)
EXPORT_COLS = ["Close", "XS", "P-XS-5", "BOL-H-XS", "gt1"]
BATCH_FROM = dt.date(1997, 7, 1)     # new batches overlap the stored history
FETCH_AS_OF = dt.date(2002, 1, 1)
TOP_N = 20
REPORT_ISIN = "1"
PIVOT_SUBSET = ["Close", "XS", "STDDEV-XS-10", "P-XS-5", "P-XS+15", "BOL-H-XS",
                "XS/BOL-H-XS", "D-XS/S-1", "Class", "gt1"]


# --- helpers -----------------------------------------------------------------

def q6(c: Column) -> Column:
    """Same grid as the oracle: 1e-6 below 1e4, eight significant digits above."""
    big = F.floor(c * F.pow(F.lit(10.0), 7 - F.floor(F.log10(F.abs(c)))) + 0.3183098)
    return F.when(F.abs(c) < 1e4, F.floor(c * 1e6 + 0.3183098)).otherwise(big).cast("long")


def quantize(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        cols.append(q6(c).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c)
    return df.select(*cols)


def _bars_sd(spark: SparkSession, sf: str, columns: list[str] | None = None) -> DataFrame:
    """The stored bars; ``columns``: those that the query reads, besides isin and date."""
    checkpoint_dir(spark)
    quotes = B.supplier_day_quotes(spark, sf)
    return materialize(quotes if columns is None else quotes.select("isin", "date", *columns), "bars_sd")


def _bars_eh(spark: SparkSession, sf: str) -> DataFrame:
    checkpoint_dir(spark)
    return materialize(B.event_hour_quotes(spark, sf), "bars_eh")


def _base(spark, sf) -> DataFrame:
    return LF.base_series(_bars_sd(spark, sf, S.BASE))


def _long_q(df: DataFrame) -> DataFrame:
    return df.select("isin", "date", q6(F.col("value")).alias("value"), "type")


def _wide(spark, sf, columns=None, grid=False) -> DataFrame:
    bars = _bars_sd(spark, sf, S.BASE)
    return IND.build_wide(bars, columns=columns, chunks=LF.chunk_plan(bars).stored(), grid=grid)


def _scored(data: DataFrame) -> DataFrame:
    """Rule-based scores in the shape of the prediction table (SQL-checkable
    stand-in for the forest / k-means outputs)."""
    preds = [F.when(ML.q("P-Close-1") * 100 > t, 1.0).otherwise(0.0).alias(ML.predicted_col(f"gt{t}"))
             for t in (1, 2, 3)]
    return (ML.recent(data, AS_OF)
            .select("isin", "date", "Close", ML.q("P-Close-1"), *preds,
                    ML.q("XS/L").alias(ML.probability_col("gt1")),
                    F.when(ML.q("XS/S") > 0, 1).otherwise(0).alias("kmeans")))


SCORE_COLS = ["Close", "P-Close-1", "XS/L", "XS/S"]


def _ml_data(spark, sf, columns=None) -> DataFrame:
    return _wide(spark, sf, columns)


def _posexplode(df: DataFrame, vec: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    return (df.select("isin", "date", F.posexplode(vector_to_array(F.col(vec))).alias("pos", "v"))
            .select("isin", "date", "pos", q6(F.col("v")).alias("v")))


# --- queries -----------------------------------------------------------------

def q_bars_supplier_day(spark, sf):
    return quantize(B.supplier_day_quotes(spark, sf))


def q_bars_event_hour(spark, sf):
    return quantize(B.event_hour_quotes(spark, sf))


def q_base_long(spark, sf):
    return _long_q(_base(spark, sf))


def q_sma(spark, sf):
    return _long_q(LF.sma(_base(spark, sf), "Close", "MA-10", 10))


def q_ma_plus(spark, sf):
    return _long_q(LF.ma_plus(_base(spark, sf), "Close", "M", 12))


def q_stddev(spark, sf):
    return _long_q(LF.stddev(_base(spark, sf), "Close", 10))


def q_perf_past(spark, sf):
    return _long_q(LF.performance(_base(spark, sf), "Close", -5))


def q_perf_future(spark, sf):
    return _long_q(LF.performance(_base(spark, sf), "Close", 5))


def q_derivative(spark, sf):
    return _long_q(LF.derivative(_base(spark, sf), "Close", -1))


def q_derivative_future(spark, sf):
    return _long_q(LF.derivative(_base(spark, sf), "Close", 3))


def q_bollinger(spark, sf):
    base = _base(spark, sf)
    ind = base.unionByName(LF.stddev(base, "Close", 10))
    return _long_q(LF.bollinger(ind, "Close", "STDDEV-Close-10"))


def q_diff(spark, sf):
    return _long_q(LF.diff(_base(spark, sf), "Close", "Open"))


def q_rate(spark, sf):
    return _long_q(LF.rate(_base(spark, sf), "High", "Low"))


def q_label_class(spark, sf):
    bars = _bars_sd(spark, sf)
    plan, base = LF.chunk_plan(bars).stored(), LF.base_series(bars)
    xs = LF.ma_plus(base, "Close", "XS", 3, plan=plan)
    ind = LF.union_all([base, xs, LF.performance(xs, "XS", 15, plan=plan)])
    return _long_q(LF.classification(ind, "P-XS+15"))


def q_label_gt(spark, sf):
    base = _base(spark, sf)
    ind = base.unionByName(LF.performance(base, "Close", 5))
    return _long_q(LF.bin_gt(ind, "P-Close+5", 2))


def q_ema(spark, sf):
    b = _bars_sd(spark, sf).select("isin", "date", "Close")
    return quantize(SR.ema(b, "Close", "ema", 0.2, key="isin", order="date"))


def q_ema_gaps(spark, sf):
    b = (_bars_sd(spark, sf)
         .select("isin", "date", F.when(F.col("Number_of_Trades") < 2, F.col("Close")).alias("px")))
    return quantize(SR.ema(b, "px", "ema", 0.3, key="isin", order="date"))


def _serie(spark, sf):
    return _bars_sd(spark, sf).select("isin", "date", "Close", "Open")


def q_serie_perf(spark, sf):
    return quantize(SR.performance(_serie(spark, sf), "Close", "p", 5, key="isin", order="date"))


def q_serie_perf_past(spark, sf):
    return quantize(SR.performance(_serie(spark, sf), "Close", "p", -3, key="isin", order="date"))


def q_serie_derivative(spark, sf):
    return quantize(SR.derivative(_serie(spark, sf), "Close", "d", -1, key="isin", order="date"))


def q_serie_derivative_future(spark, sf):
    return quantize(SR.derivative(_serie(spark, sf), "Close", "d", 2, key="isin", order="date"))


def q_serie_rate(spark, sf):
    return quantize(SR.rate(_serie(spark, sf), "Close", "Open", "r"))


def q_serie_perf_null_keys(spark, sf):
    """Rows without a key (one series) and rows without a date (first in theirs)."""
    d = _serie(spark, sf).withColumns({"isin": F.nullif("isin", F.lit("7")), "date": F.nullif("date", F.lit(NULL_DAY))})
    return quantize(SR.performance(d, "Close", "p", 5, key="isin", order="date"))


def q_features_wide_nulls(spark, sf):
    """Missing closes (every ninth day of a month) and highs: the rows stay."""
    b = _bars_sd(spark, sf, [*S.BASE, "Number_of_Trades"]).withColumns({
        "Close": F.when(F.dayofmonth("date") % 9 != 0, F.col("Close")),
        "High": F.when(F.col("Number_of_Trades") < 2, F.col("High"))})
    return IND.build_wide(b, grid=True)


def q_features_wide(spark, sf):
    return _wide(spark, sf, grid=True)


def q_event_features(spark, sf):
    return IND.build_wide(_bars_eh(spark, sf), grid=True)


def q_indicator_stats(spark, sf):
    names = S.standard_names()
    return IND.stats_wide(IND.build_wide(_bars_sd(spark, sf), presence=True), names)


def q_indicator_stats_long(spark, sf):
    return IND.stats(IND.build_long(_bars_sd(spark, sf)))


def q_max_dates(spark, sf):
    names = S.standard_names()
    return IND.max_dates_wide(IND.build_wide(_bars_sd(spark, sf), presence=True), names)


def q_day_count(spark, sf):
    """Running day count per instrument (1-based), from the exact numbering."""
    from tidemark.operators.sequence import number_rows
    n = number_rows(_bars_sd(spark, sf).select("isin", "date"), "isin", "date")
    return n.select("isin", "date", (F.col("_rn") + 1).alias("Day_Count"))


def q_last_quotation(spark, sf):
    return ING.last_quotation(B.supplier_day_quotes(spark, sf))


def q_pivot_subset(spark, sf):
    long = IND.build_long(_bars_sd(spark, sf, S.BASE), columns=PIVOT_SUBSET)
    return quantize(IND.pivot(long, PIVOT_SUBSET))


def q_training_set(spark, sf):
    return quantize(ML.training_set(_wide(spark, sf, ["gt1", *ML.FEATURES]), "gt1", extra=["isin", "date"]))


def q_top_by_turnover(spark, sf):
    return ING.top_by_turnover(FX.stock(spark, sf), TOP_N)


def _stored_and_batch(spark, sf):
    bars = _bars_sd(spark, sf)
    return bars.where(F.col("date") < F.lit(SPLIT)), bars.where(F.col("date") >= F.lit(BATCH_FROM))


def q_fetch_plan(spark, sf):
    stored, _ = _stored_and_batch(spark, sf)
    listed = ING.top_by_turnover(FX.stock(spark, sf), TOP_N)
    return ING.fetch_plan(listed, ING.last_quotation(stored), as_of=F.lit(FETCH_AS_OF))


def q_incremental_append(spark, sf):
    stored, batch = _stored_and_batch(spark, sf)
    return quantize(ING.incremental_append(batch, stored))


def q_upsert_append(spark, sf):
    """New days are added and stored days corrected (here: Open set to Close)."""
    stored, batch = _stored_and_batch(spark, sf)
    return quantize(ING.upsert(batch.withColumn("Open", F.col("Close")), stored))


def _scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/files/{name}-{uuid.uuid4().hex}"


def q_quotes_csv_roundtrip(spark, sf):
    """Bars written as vendor quote files (after junk lines) and read back."""
    path = _scratch(spark, "quotes")
    b = _bars_sd(spark, sf)
    rows = b.select("isin", F.lit("XPAR").alias("MIC"), F.date_format("date", CSV.QUOTE_DATE_FORMAT).alias("Date"), "Open", "High", "Low",
                    "Close", "Number_of_Shares", "Number_of_Trades", F.col("Turnover").cast("string").alias("Turnover"), F.lit("EUR").alias("Currency"))
    rows.write.csv(path)
    b.select(F.concat(F.lit("Historical data of "), "isin")).distinct().write.mode("append").text(path)
    return quantize(CSV.read_quotes(spark, path).select("isin", "date", *O.BAR_COLS))


def q_quotes_rejects(spark, sf):
    """Quote files with damaged lines stored: how many lines were kept, and rejected why, by
    the tables and by the counts taken while storing."""
    path, store = _scratch(spark, "damaged"), _own_store(spark)
    day = F.dayofmonth("date")
    cells = [F.when(day != 30, F.col("isin")), F.lit("XPAR"),
             F.when(day == 31, F.date_format("date", "'32'/MM/yyyy")).when(day != 29, F.date_format("date", CSV.QUOTE_DATE_FORMAT)),
             *[F.col(c).cast("string") for c in ("Open", "High", "Low", "Close", "Number_of_Shares", "Number_of_Trades")],
             F.when(day == 28, F.lit("n/a")).otherwise(F.col("Turnover").cast("string")), F.lit("EUR")]
    line = F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in cells])
    _bars_sd(spark, sf).select(F.explode(F.when(day == 1, F.array(F.lit("  "), line)).otherwise(F.array(line))).alias("value")).write.text(path)
    counted = store.ingest_quotes(path)
    stored = store.table("quotation").agg(F.count("*").alias("kept"), F.count_if(F.col("Turnover").isNull()).alias("damaged")).first().asDict()
    rejected = {r["reason"]: r["count"] for r in store.table("rejects").groupBy("reason").count().collect()}  # four reasons
    spark.sql(f"DROP DATABASE {store.db} CASCADE")
    rows = [(k, n, counted[k]) for k, n in (stored | rejected).items()]
    return spark.createDataFrame(rows, "reason string, n_lines long, n_counted long")


def q_history_csv_roundtrip(spark, sf):
    """Bars written as history files of two layouts, each with its header row, and read back."""
    path, b = _scratch(spark, "history"), _bars_sd(spark, sf)
    days = [F.date_format("date", f).alias("Date") for f in CSV.HISTORY_DATE_FORMATS]
    one = b.where(F.col("isin").cast("long") % 2 == 0).select("Close", F.lit("a, b").alias("Remark"), days[0], "High", "isin", "Low", "Open",
                                                              F.col("Number_of_Shares").alias("Number of Shares"))
    two = b.where(F.col("isin").cast("long") % 2 == 1).select("isin", days[1], "Open", "High", "Low", "Close", "Turnover")
    one.write.option("header", True).csv(path)
    two.write.mode("append").option("header", True).csv(path)
    return quantize(CSV.read_instrument_history(spark, path).select("isin", "date", "Open", "High", "Low", "Close", "Number_of_Shares", "Turnover"))


def q_stock_csv_roundtrip(spark, sf):
    """The instrument list written in the vendor's layout and read back."""
    path = _scratch(spark, "stock")
    null = F.lit(None).cast("double")
    isin = F.concat(F.lit("FR"), F.lpad("ISIN", 9, "0"), F.lit("0"))
    st = FX.stock(spark, sf).select(
        "Name", isin.alias("ISIN"), "Symbol", "Market", F.lit("EUR").alias("c"), null.alias("o"), null.alias("h"), null.alias("l"), null.alias("x"),
        F.date_format("Last_DateTime", CSV.LIST_TIMESTAMP_FORMAT).alias("t"), F.lit("CET").alias("z"), null.alias("v"), "Turnover")
    st.write.option("sep", ";").csv(path)
    back = CSV.read_instrument_list(spark, path)
    return quantize(back.select("Name", "ISIN", "Symbol", "Market", "Trading_Currency", F.to_date("Last_DateTime").alias("Last_Day"), "Turnover"))


def _own_store(spark) -> Store:
    return Store(spark, f"tidemark_{uuid.uuid4().hex[:12]}")


def q_long_store_roundtrip(spark, sf):
    """Series appended to the long store, one of them dropped again, the rest read back."""
    store = _own_store(spark)
    store.init_indicator()
    long = IND.build_long(_bars_sd(spark, sf), columns=["Close", "XS", "P-XS-5"])
    store.append_indicator(long.where(F.col("type") != "Close"))
    store.append_indicator(long.where(F.col("type") == "Close"))
    store.drop_indicator("XS")
    out = materialize(_long_q(store.table("indicator")), "long_store")
    spark.sql(f"DROP DATABASE {store.db} CASCADE")
    return out


def q_indicators_incremental(spark, sf):
    """Features built to a cut-off, with wrong closes in some instruments' last months, then
    brought up to date after three batches: two appended, the last with the corrections."""
    bars, store = _bars_sd(spark, sf), _own_store(spark)
    wrong = (F.col("date") >= F.lit(WRONG_FROM)) & (F.col("date") < F.lit(SPLIT)) & F.col("isin").isin("3", "7")
    store.append_quotes(bars.where(F.col("date") < F.lit(SPLIT)).withColumn("Close", F.when(wrong, F.col("Close") * 2).otherwise(F.col("Close"))))
    store.update_indicators()
    for until in INCREMENTS:
        store.append_quotes(bars.where(F.col("date") < F.lit(until)))
        if until == INCREMENTS[-1]:
            store.upsert_quotes(bars.where(wrong))
        store.update_indicators()
    out = materialize(quantize(store.table("data")), "incremental")
    spark.sql(f"DROP DATABASE {store.db} CASCADE")
    return out


def q_upsert_partitions(spark, sf):
    """``upsert_append`` through the month-partitioned store."""
    stored, batch = _stored_and_batch(spark, sf)
    store = _own_store(spark)
    store.append_quotes(stored)
    store.upsert_quotes(batch.withColumn("Open", F.col("Close")))
    out = materialize(quantize(store.table("quotation")), "upserted")
    spark.sql(f"DROP DATABASE {store.db} CASCADE")
    return out


def q_watchlist_store_roundtrip(spark, sf):
    """The watchlist stored (twice over), the instrument list and quotes as views, read back by SQL."""
    store = _own_store(spark)
    store.init_watchlist()
    for _ in range(2):
        store.insert_watchlist(FX.watchlist(spark, sf))
    store.overwrite("stock", FX.stock(spark, sf))
    store.append_quotes(_bars_sd(spark, sf))
    store.create_views(("stock", "quotation"))
    store.watchlist().createOrReplaceTempView("watched")
    out = materialize(spark.sql("""
        SELECT w.isin, s.Name AS name, count(q.date) AS days, max(q.date) AS last
        FROM watched w JOIN stock s ON s.ISIN = w.isin LEFT JOIN quotation q ON q.isin = w.isin GROUP BY w.isin, s.Name"""), "watched")
    for view in ("stock", "quotation", "watched"):
        spark.catalog.dropTempView(view)
    spark.sql(f"DROP DATABASE {store.db} CASCADE")
    return out


def q_daily_job(spark, sf):
    """The whole daily job from vendor files, twice (the second day's files hold more), for the
    instruments of largest turnover; returns the exported features."""
    from tidemark.plans import job
    isin = F.concat(F.lit("FR"), F.lpad("isin", 9, "0"), F.lit("0"))
    later = _bars_sd(spark, sf).withColumn("date", F.date_add("date", JOB_SHIFT)).withColumn("isin", isin)
    null, base, store = F.lit(None).cast("double"), _scratch(spark, "job"), _own_store(spark)
    store.init_watchlist()
    for n, before in enumerate((JOB_CUT, dt.date(2100, 1, 1))):
        b = later.where(F.col("date") < F.lit(before))
        b.select("isin", F.lit("XPAR"), F.date_format("date", CSV.QUOTE_DATE_FORMAT), "Open", "High", "Low", "Close", "Number_of_Shares",
                 "Number_of_Trades", F.col("Turnover").cast("string"), F.lit("EUR")).write.csv(f"{base}/quotes{n}")
        (b.groupBy("isin").agg(F.max("date").alias("d"), F.sum("Turnover").alias("t"))
         .select(F.lit("Name"), "isin", F.lit("SYM"), F.lit("Paris"), F.lit("EUR"), null, null, null, null,
                 F.date_format("d", CSV.LIST_TIMESTAMP_FORMAT), F.lit("CET"), null, "t").write.option("sep", ";").csv(f"{base}/list{n}"))
        as_of = b.agg(F.max("date")).first()[0]
        paths = job.run(spark, store, f"{base}/list{n}", f"{base}/quotes{n}", f"{base}/models", f"{base}/out{n}", JOB_TOP, as_of, learn=n == 0, num_trees=2)
    schema = store.table("data").schema
    spark.sql(f"DROP DATABASE {store.db} CASCADE")
    back = spark.read.option("header", True).schema(schema).csv(paths["data"])
    return quantize(back.select("isin", "date", *[F.col(f"`{c}`") for c in EXPORT_COLS]))


def q_export_roundtrip(spark, sf):
    """The feature table exported as CSV and read back."""
    store, path = _own_store(spark), _scratch(spark, "export")
    store.overwrite("data", _wide(spark, sf, EXPORT_COLS))
    EX.export(store, path)
    back = spark.read.option("header", True).schema(store.table("data").schema).csv(f"{path}/data")
    out = materialize(quantize(back), "export")
    spark.sql(f"DROP DATABASE {store.db} CASCADE")
    return out


def q_recent_window(spark, sf):
    d = _wide(spark, sf, ["Close", "XS"])
    return quantize(ML.recent(d, AS_OF))


def _scored_q(spark, sf):
    return _scored(_wide(spark, sf, SCORE_COLS))


def q_instrument_history(spark, sf):
    return quantize(REP.history(_scored_q(spark, sf), FX.stock(spark, sf), REPORT_ISIN))


def q_watchlist_report(spark, sf):
    return quantize(REP.watchlist_report(_scored_q(spark, sf), FX.stock(spark, sf),
                                         FX.watchlist(spark, sf)))


def q_top_opportunities_rule(spark, sf):
    return quantize(REP.opportunities(_scored_q(spark, sf), FX.stock(spark, sf), 6))


def q_dips_rule(spark, sf):
    return quantize(REP.dips(_scored_q(spark, sf), FX.stock(spark, sf), 6))


def q_precision_reduce(spark, sf):
    from pyspark.ml.feature import VectorAssembler
    ts = ML.training_set(_wide(spark, sf, ML.FEATURES), None, extra=["isin", "date"])
    v = VectorAssembler(inputCols=ML.FEATURES, outputCol="features").transform(ts)
    r = PrecisionReducer(inputCol="features", outputCol="reduced", precision=0.01).fit(v).transform(v)
    return _posexplode(r, "reduced")


def q_minmax_scaled(spark, sf):
    ts = ML.training_set(_wide(spark, sf, ML.FEATURES), None, extra=["isin", "date"])
    return _posexplode(ML.feature_pipeline(ts).transform(ts), "scaledFeatures")


# model outputs ----------------------------------------------------------------
# A fitted model's numbers have no SQL. These queries return the rows that SQL can
# derive (which rows are scored, the split's label counts, the latest days), each with
# `valid`: an invariant computed apart from the model's own transform. They do not prove
# that a forest or a clustering is the one another implementation would fit.

def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int").alias("valid")


def _prepared(spark, sf, label=None):
    keep = [label] if label else []
    ts = ML.training_set(_ml_data(spark, sf, keep + ML.FEATURES), label, extra=["isin", "date"])
    return ML.prepared(ts, [*keep, "isin", "date"])


def _argmax_ok(label: str) -> Column:
    """The prediction is the likelier class of probabilities that sum to 1."""
    from pyspark.ml.functions import vector_to_array
    p = vector_to_array(ML.q(ML.probability_col(label)))
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return (F.abs(total - 1) < 1e-9) & (F.array_position(p, F.array_max(p)) - 1 == ML.q(ML.predicted_col(label)))


def q_rf_predict(spark, sf):
    p = _prepared(spark, sf, "gt1")
    m = ML.train_forest(p, "gt1")
    return m.transform(p).select("isin", "date", _flag(_argmax_ok("gt1")))


def q_kmeans_assign(spark, sf):
    """Every row's centre is the nearest one."""
    p = _prepared(spark, sf)
    model = ML.train_kmeans(p)
    d = ML.center_distances(model.clusterCenters())
    near = F.get(d, F.col("kmeans")) <= F.array_min(d) * (1 + 1e-9) + 1e-12
    return model.transform(p).select("isin", "date", _flag(near))


def q_elbow(spark, sf):
    """Each k's error against MLlib's training cost, which is that of the centres before the
    last step: no less than the error, and within a thousandth of it once the fit has settled."""
    e = ML.elbow(_prepared(spark, sf), details=True)
    near = (F.col("wssse") <= F.col("training_cost") * (1 + 1e-9)) & (F.col("training_cost") <= F.col("wssse") * 1.001)
    return e.select("k", "rows", _flag(near & (F.col("n_centers") <= F.col("k"))))


def q_confusion(spark, sf):
    """Row totals of the confusion matrix: the test rows of each label."""
    train, test = ML.split_by_hash(_prepared(spark, sf, "gt1"))
    cells = ML.confusion(ML.train_forest(train, "gt1").transform(test), "gt1")
    return cells.groupBy("gt1").agg(F.sum("count").alias("rows"), (F.count("*") <= 2).cast("int").alias("valid")).withColumn(
        "gt1", F.col("gt1").cast("int"))


def q_evaluate(spark, sf):
    e = ML.evaluate(_ml_data(spark, sf, ["gt1", "P-XS+5", *ML.FEATURES]), "gt1")
    same = ((F.col("detected") == F.col("ok") + F.col("false_positive")) & (F.col("real") == F.col("ok") + F.col("false_negative"))
            & (F.col("missed") == F.col("real") - F.col("detected")) & (F.col("bad") <= F.col("detected"))
            & (F.abs(F.col("test_error") * F.col("total") - F.col("false_positive") - F.col("false_negative")) < 1e-6))
    return e.select("label", "total", "real", _flag(same))


_models: dict[tuple[str, str], str] = {}


def _predicted(spark, sf):
    """Scores of the recent rows; the models are learned once per session and folder. The columns that models
    and reports read are computed and stored once, for learning and scoring."""
    data = materialize(_ml_data(spark, sf, ["Close", *ML.LABELS, *ML.FEATURES]), "features")
    key = (spark.sparkContext.applicationId, sf)
    if key not in _models:
        model_dir = _scratch(spark, "models")
        ML.learn(data, model_dir, stored=True)
        _models[key] = model_dir
    return materialize(ML.predict(data, _models[key], as_of=AS_OF), "predicted")


def in_rank_order(rows: list, scored: DataFrame, order: list[tuple[str, str]]) -> list[bool]:
    """For each row of a report, whether exactly the rows before it rank above it among all
    scored rows. ``order``: (column, "desc", "asc" or "asc_nulls_first"); nulls come last
    otherwise. One aggregate over the scored rows, apart from the report's own sort."""
    def above(row) -> Column:
        out, level = F.lit(False), F.lit(True)
        for name, way in order:
            c, v = ML.q(name), row[name]
            if v is None:
                better, same = (c.isNotNull() if way != "asc_nulls_first" else F.lit(False)), c.isNull()
            else:
                better = (c > F.lit(v)) if way == "desc" else (c < F.lit(v))
                better = F.coalesce(better, F.lit(way == "asc_nulls_first"))
                same = F.coalesce(c == F.lit(v), F.lit(False))
            out, level = out | (level & better), level & same
        return out

    if not rows:
        return []
    counts = scored.agg(*[F.count_if(above(r)).alias(f"n{i}") for i, r in enumerate(rows)]).first()
    return [counts[f"n{i}"] == i for i in range(len(rows))]


TOP_ORDER = [("date", "desc"), ("prediction-gt1", "desc"), ("prediction-gt2", "desc"), ("prediction-gt3", "desc"), ("probability-gt1", "desc"), ("isin", "asc")]
DIPS_ORDER = [("date", "desc"), ("P-Close-1", "asc_nulls_first"), ("isin", "asc")]


def _scores(pred: DataFrame) -> DataFrame:
    """The columns that the reports rank by, each probability as that of the class 1."""
    from pyspark.ml.functions import vector_to_array
    p = ML.probability_col("gt1")
    return pred.withColumn(p, vector_to_array(ML.q(p))[1]) if dict(pred.dtypes)[p] == "vector" else pred


def q_top_opportunities(spark, sf):
    """Six rows: above each, only the rows before it rank among all scored rows; names belong to their rows."""
    pred = _predicted(spark, sf)
    top = REP.opportunities(pred, FX.stock(spark, sf), 6).collect()  # six rows
    right = in_rank_order(top, _scores(pred), TOP_ORDER)
    rows = [(i, r["date"], int(ok and r["symbol"] == "S" + r["isin"])) for i, (r, ok) in enumerate(zip(top, right), 1)]
    return spark.createDataFrame(rows, "place int, date date, valid int")


def q_dips(spark, sf):
    """Up to six rows that are predicted to rise: no other such row of the day fell more."""
    pred = _predicted(spark, sf)
    rising = pred.where(ML.q("prediction-gt1") == 1).select("isin", "date", ML.q("P-Close-1"))
    dips = REP.dips(pred, FX.stock(spark, sf), 6).collect()  # six rows
    rows = [r.asDict() | {"P-Close-1": r["PClose"]} for r in dips]
    there = {(r["isin"], r["date"], r["P-Close-1"]) for r in rising.where(F.col("isin").isin([r["isin"] for r in rows]) & F.col("date").isin([r["date"] for r in rows])).collect()}
    right = (len(rows) == min(6, rising.limit(6).count()) and all(in_rank_order(rows, rising, DIPS_ORDER))
             and all((r["isin"], r["date"], r["P-Close-1"]) in there for r in rows))
    return spark.createDataFrame([(int(right),)], "valid int")


def q_cluster_listing(spark, sf):
    """Listings of all clusters, and the rows short of a feature: every recent row once."""
    pred = _predicted(spark, sf)
    lists = [REP.cluster_listing(pred, FX.stock(spark, sf), c).select("isin", "date", _flag(F.col("kmeans") == c)) for c in range(ML.KMEANS_K)]
    out = pred.where(F.col("kmeans").isNull()).select("isin", "date", F.lit(1).alias("valid"))
    for part in lists:
        out = out.unionByName(part)
    return out


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the 69-series indicator table over supplier-day bars,
    the 20 latest rows by 5-day past performance."""
    data = _wide(spark, SF_SMOKE)
    return (data.where(F.col("`P-XS-5`").isNotNull())
            .orderBy(F.desc("date"), F.desc("`P-XS-5`"), F.asc("isin")).limit(20))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {name[2:]: fn for name, fn in globals().items() if name.startswith("q_") and callable(fn)}
    return own if LLM is None else own | LLM.queries() | {"pipeline": corpus_pipeline.run}


# --- oracle SQL -----------------------------------------------------------------

def _plan(*series: S.Series) -> tuple[S.Series, ...]:
    return tuple(S.base(b) for b in S.BASE) + tuple(series)


def _long_sql(plan, names) -> str:
    return O.long_sql(plan, names, O.BARS_SUPPLIER_DAY,
                      f"SELECT isin, date, {O.Q('value')} AS value, type FROM long")


def _serie_sql(value_expr: str, name: str, other: str) -> str:
    return f"""
WITH b AS ({O.BARS_SUPPLIER_DAY}),
s AS (SELECT isin, date, "Close" AS x, "Open" AS o,
        row_number() OVER (PARTITION BY isin ORDER BY date) AS rn,
        count(*) OVER (PARTITION BY isin) AS n FROM b),
t AS (SELECT *, {other} AS y FROM s)
SELECT isin, date, {O.Q('x')} AS "Close", {O.Q('o')} AS "Open", {O.Q(value_expr)} AS {name} FROM t
"""


def _paired_sql(n: int, kind: str, name: str) -> str:
    other = (f"lag(x, {-n}) OVER (PARTITION BY isin ORDER BY date)" if n < 0 else
             f"lead(x, {n}) OVER (PARTITION BY isin ORDER BY date)" if n > 0 else "x")
    has = f"(rn + {n} >= 1 AND rn + {n} <= n)"
    op = "x / y - 1" if kind == "perf" else "x - y"
    value = (f"CASE WHEN NOT {has} THEN NULL WHEN x IS NULL OR y IS NULL OR x = 0 OR y = 0 "
             f"THEN 0.0 ELSE {op} END")
    return _serie_sql(value, name, other)


def _ema_sql(src_expr: str, out_name: str, rate: float) -> str:
    a = 1.0 - rate
    return f"""
WITH RECURSIVE b AS ({O.BARS_SUPPLIER_DAY}),
s AS (SELECT isin, date, {src_expr} AS x,
        row_number() OVER (PARTITION BY isin ORDER BY date) AS rn FROM b),
r(isin, rn, date, x, y) AS (
  SELECT isin, rn, date, x, x FROM s WHERE rn = 1
  UNION ALL
  SELECT s.isin, s.rn, s.date, s.x,
         CASE WHEN s.x IS NULL THEN NULL WHEN r.y IS NULL THEN s.x
              ELSE s.x * CAST({rate!r} AS DOUBLE) + r.y * CAST({a!r} AS DOUBLE) END
  FROM r JOIN s ON s.isin = r.isin AND s.rn = r.rn + 1)
SELECT isin, date, {O.Q('x')} AS {O.ident(out_name)}, {O.Q('y')} AS ema FROM r
"""


PQ = ", ".join(O.Q(f'"prediction-gt{t}"') + f' AS "prediction-gt{t}"' for t in (1, 2, 3))
PRED_COLS = PQ + ", " + O.Q('"probability-gt1"') + ' AS "probability-gt1"'
RANK = ('date DESC, "prediction-gt1" DESC, "prediction-gt2" DESC, "prediction-gt3" DESC, '
        '"probability-gt1" DESC NULLS LAST, isin ASC')


def _scored_sql(select: str, extra_ctes: str = "") -> str:
    plan = S.standard_plan()
    w, _ = O.long_ctes(plan, SCORE_COLS, O.BARS_SUPPLIER_DAY)
    piv = ", ".join(f"sum(value) FILTER (WHERE type = {O.lit(n)}) AS {O.ident(n)}" for n in SCORE_COLS)
    preds = ", ".join(f'CASE WHEN "P-Close-1" * 100 > {t} THEN 1.0 ELSE 0.0 END AS "prediction-gt{t}"'
                      for t in (1, 2, 3))
    return f"""{w},
data AS (SELECT isin, date, {piv} FROM long GROUP BY isin, date),
scored AS (SELECT isin, date, "Close", "P-Close-1", {preds}, "XS/L" AS "probability-gt1",
                  CASE WHEN "XS/S" > 0 THEN 1 ELSE 0 END AS kmeans
           FROM data WHERE date > DATE '{AS_OF.isoformat()}' - INTERVAL 300 DAY),
stock AS (SELECT CAST(s_suppkey AS VARCHAR) AS isin, 'S' || CAST(s_suppkey AS VARCHAR) AS symbol,
                 s_name AS name FROM supplier),
named AS (SELECT p.*, s.symbol, s.name FROM scored p LEFT JOIN stock s ON p.isin = s.isin){extra_ctes}
{select}"""


def _training_ctes(label: str | None) -> str:
    """``ts``: label + features, rows with a NULL/NaN among them removed."""
    feats = ML.FEATURES
    cols = ([label] if label else []) + feats
    w, _ = O.long_ctes(S.standard_plan(), cols, O.BARS_SUPPLIER_DAY)
    piv = ", ".join(f"sum(value) FILTER (WHERE type = {O.lit(n)}) AS {O.ident(n)}" for n in cols)
    cond = " AND ".join(f"{O.ident(n)} IS NOT NULL AND NOT isnan({O.ident(n)})" for n in cols)
    return (f"{w},\ndata AS (SELECT isin, date, {piv} FROM long GROUP BY isin, date),\n"
            f"ts AS (SELECT * FROM data WHERE {cond})")


def _training_sql() -> str:
    cols = ", ".join(f"{O.Q(O.ident(c))} AS {O.ident(c)}" for c in ["gt1"] + ML.FEATURES)
    return _training_ctes("gt1") + f"\nSELECT {cols}, isin, date FROM ts"


def _unnest_sql(expr_for) -> str:
    return " UNION ALL ".join(
        f"SELECT isin, date, {i} AS pos, {O.Q(expr_for(O.ident(f), i))} AS v FROM ts"
        for i, f in enumerate(ML.FEATURES))


def _precision_sql() -> str:
    return _training_ctes(None) + "\n" + _unnest_sql(lambda c, i: f"floor({c} / 0.01 + 0.5) * 0.01")


def _minmax_sql() -> str:
    mm = ", ".join(f"min({O.ident(f)}) AS mn{i}, max({O.ident(f)}) AS mx{i}"
                   for i, f in enumerate(ML.FEATURES))
    body = _unnest_sql(lambda c, i: f"CASE WHEN mx{i} = mn{i} THEN 0.5 "
                                    f"ELSE ({c} - mn{i}) / (mx{i} - mn{i}) * 1.0 + 0.0 END")
    body = body.replace(" FROM ts", " FROM ts, mm")
    return _training_ctes(None) + f",\nmm AS (SELECT {mm} FROM ts)\n" + body


def _model_sql() -> dict[str, str]:
    cut = int(65536 * 0.8)
    test = (f"CAST('0x' || substr(md5(isin || '|' || CAST(CAST(date AS DATE) AS VARCHAR) || '|{ML.FOREST_SEED}'), 1, 4) AS INT) >= {cut}")
    gt1 = _training_ctes("gt1")
    w, _ = O.long_ctes(S.standard_plan(), ["Close"], O.BARS_SUPPLIER_DAY)
    recent = f"{w}, rec AS (SELECT DISTINCT isin, date FROM long WHERE date > DATE '{AS_OF}' - INTERVAL 300 DAY)"
    return {
        "rf_predict": f"{gt1} SELECT isin, date, 1 AS valid FROM ts",
        "kmeans_assign": f"{_training_ctes(None)} SELECT isin, date, 1 AS valid FROM ts",
        "elbow": f"{_training_ctes(None)} SELECT CAST(k AS INT) AS k, count(*) AS rows, 1 AS valid FROM ts, range(3, 90, 3) r(k) GROUP BY k",
        "confusion": f"{gt1} SELECT CAST(gt1 AS INT) AS gt1, count(*) AS rows, 1 AS valid FROM ts WHERE {test} GROUP BY 1",
        "evaluate": f"{gt1} SELECT 'gt1' AS label, count(*) AS total, CAST(sum(gt1) AS BIGINT) AS real, 1 AS valid FROM ts WHERE {test}",
        "top_opportunities": f"{recent} SELECT row_number() OVER (ORDER BY date DESC) AS place, date, 1 AS valid FROM rec ORDER BY date DESC LIMIT 6",
        "dips": "SELECT 1 AS valid FROM (SELECT 1) t",
        "cluster_listing": f"{recent} SELECT isin, date, 1 AS valid FROM rec",
    }


def _upsert_sql() -> str:
    cols = [O.Q(f"CASE WHEN date >= DATE '{BATCH_FROM}' THEN \"Close\" ELSE \"Open\" END" if c == "Open" else O.ident(c)) + f" AS {O.ident(c)}" for c in O.BAR_COLS]
    return f"SELECT isin, date, {', '.join(cols)} FROM ({O.BARS_SUPPLIER_DAY}) b"


def _job_bars() -> str:
    """What two days of the job store: all days of the first list's instruments, and of the second
    list's new ones all but the last trade day, which a first fetch leaves out."""
    shifted = f"date + INTERVAL {JOB_SHIFT} DAY"

    def top(before: dt.date) -> str:
        return (f"SELECT isin FROM b WHERE {shifted} < DATE '{before}' GROUP BY isin "
                f"ORDER BY sum(\"Turnover\") DESC NULLS LAST, lpad(isin, 9, '0') LIMIT {JOB_TOP}")

    return f"""SELECT 'FR' || lpad(isin, 9, '0') || '0' AS isin, CAST({shifted} AS DATE) AS date, {', '.join(map(O.ident, S.BASE))} FROM (
        WITH b AS MATERIALIZED ({O.BARS_SUPPLIER_DAY}), t1 AS ({top(JOB_CUT)}), t2 AS ({top(dt.date(2100, 1, 1))}),
        m AS (SELECT isin, max(date) AS last FROM b GROUP BY isin)
        SELECT b.* FROM b JOIN m USING (isin) WHERE isin IN (SELECT isin FROM t1) OR (isin IN (SELECT isin FROM t2) AND date < last)) j"""


def oracle_sql() -> dict[str, str]:
    plan = S.standard_plan()
    names = [s.name for s in plan]
    sd = O.BARS_SUPPLIER_DAY
    out: dict[str, str] = {
        "bars_supplier_day": O.quantized_bars(sd),
        "bars_event_hour": O.quantized_bars(O.BARS_EVENT_HOUR),
        "base_long": _long_sql(_plan(), list(S.BASE)),
        "sma": _long_sql(_plan(S.sma("Close", "MA-10", 10)), ["MA-10"]),
        "ma_plus": _long_sql(_plan(S.ma_plus("Close", "M", 12)), ["M"]),
        "stddev": _long_sql(_plan(S.stddev("Close", 10)), ["STDDEV-Close-10"]),
        "perf_past": _long_sql(_plan(S.perf("Close", -5)), ["P-Close-5"]),
        "perf_future": _long_sql(_plan(S.perf("Close", 5)), ["P-Close+5"]),
        "derivative": _long_sql(_plan(S.deriv("Close", -1)), ["D-Close-1"]),
        "derivative_future": _long_sql(_plan(S.deriv("Close", 3)), ["D-Close+3"]),
        "bollinger": _long_sql(_plan(S.stddev("Close", 10), *S.bollinger("Close", "STDDEV-Close-10")),
                               ["BOL-H-Close", "BOL-L-Close"]),
        "diff": _long_sql(_plan(S.diff("Close", "Open")), ["Close-Open"]),
        "rate": _long_sql(_plan(S.rate("High", "Low")), ["High/Low"]),
        "label_class": _long_sql(_plan(S.ma_plus("Close", "XS", 3), S.perf("XS", 15),
                                       S.classification("P-XS+15")), ["Class"]),
        "label_gt": _long_sql(_plan(S.perf("Close", 5), S.bin_gt("P-Close+5", 2)), ["gt2"]),
        "ema": _ema_sql('"Close"', "Close", 0.2),
        "ema_gaps": _ema_sql('CASE WHEN "Number_of_Trades" < 2 THEN "Close" END', "px", 0.3),
        "serie_perf": _paired_sql(5, "perf", "p"),
        "serie_perf_past": _paired_sql(-3, "perf", "p"),
        "serie_derivative": _paired_sql(-1, "deriv", "d"),
        "serie_derivative_future": _paired_sql(2, "deriv", "d"),
        "serie_rate": f"""SELECT isin, date, {O.Q('"Close"')} AS "Close", {O.Q('"Open"')} AS "Open",
            {O.Q('CASE WHEN "Close" IS NULL OR "Open" IS NULL OR "Open" = 0 THEN 0.0 ELSE "Close" / "Open" - 1 END')} AS r
            FROM ({sd}) b""",
        "features_wide": O.wide_sql(plan, names, sd),
        "indicators_incremental": O.wide_sql(plan, names, sd),
        "watchlist_store_roundtrip": f"""
            SELECT CAST(s_suppkey AS VARCHAR) AS isin, s_name AS name, count(b.date) AS days, max(b.date) AS last
            FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
            LEFT JOIN ({sd}) b ON b.isin = CAST(s_suppkey AS VARCHAR) WHERE r_name = '{FX.WATCH_REGION}' GROUP BY ALL""",
        "event_features": O.wide_sql(plan, names, O.BARS_EVENT_HOUR),
        "indicator_stats": O.long_sql(plan, names, sd, "SELECT type, count(*) AS count FROM long GROUP BY type"),
        "indicator_stats_long": O.long_sql(plan, names, sd, "SELECT type, count(*) AS count FROM long GROUP BY type"),
        "max_dates": O.long_sql(plan, names, sd, "SELECT isin, type, max(date) AS date FROM long GROUP BY isin, type"),
        "last_quotation": f"SELECT isin, max(date) AS last_quotation FROM ({sd}) b GROUP BY isin",
        "day_count": f"""SELECT isin, date, row_number() OVER (PARTITION BY isin ORDER BY date) AS "Day_Count"
            FROM ({sd}) b""",
        "pivot_subset": O.wide_sql(plan, PIVOT_SUBSET, sd),
        "top_by_turnover": f"""
            WITH last AS (SELECT l_suppkey, max(l_shipdate) AS t FROM lineitem GROUP BY l_suppkey)
            SELECT CAST(s_suppkey AS VARCHAR) AS isin, CAST(last.t AS TIMESTAMP) AS "to"
            FROM supplier LEFT JOIN last ON s_suppkey = last.l_suppkey
            ORDER BY s_acctbal DESC NULLS LAST, CAST(s_suppkey AS VARCHAR) ASC LIMIT {TOP_N}""",
        "fetch_plan": f"""
            WITH b AS ({sd}),
            stored AS (SELECT isin, max(date) AS last_quotation FROM b WHERE date < DATE '{SPLIT}' GROUP BY isin),
            last AS (SELECT l_suppkey, max(l_shipdate) AS t FROM lineitem GROUP BY l_suppkey),
            listed AS (SELECT CAST(s_suppkey AS VARCHAR) AS isin, CAST(last.t AS TIMESTAMP) AS "to"
                       FROM supplier LEFT JOIN last ON s_suppkey = last.l_suppkey
                       ORDER BY s_acctbal DESC NULLS LAST, CAST(s_suppkey AS VARCHAR) ASC LIMIT {TOP_N}),
            j AS (SELECT coalesce(l.isin, s.isin) AS isin, l."to", s.last_quotation
                  FROM listed l FULL OUTER JOIN stored s ON l.isin = s.isin),
            p AS (SELECT isin, coalesce(last_quotation, DATE '2000-01-01') AS "from",
                     CASE WHEN "to" IS NOT NULL AND last_quotation IS NOT NULL
                               THEN CAST(CAST("to" AS DATE) + INTERVAL 1 DAY AS DATE)
                          WHEN "to" IS NOT NULL THEN CAST("to" AS DATE)
                          ELSE CAST(DATE '{FETCH_AS_OF}' + INTERVAL 1 DAY AS DATE) END AS "to"
                  FROM j)
            SELECT * FROM p WHERE "to" > "from" """,
        "incremental_append": f"""
            WITH b AS ({sd}),
            stored AS (SELECT isin, max(date) AS hw FROM b WHERE date < DATE '{SPLIT}' GROUP BY isin)
            SELECT b.isin, b.date, {', '.join(f'{O.Q("b." + O.ident(c))} AS {O.ident(c)}' for c in O.BAR_COLS)}
            FROM b LEFT JOIN stored s ON b.isin = s.isin
            WHERE b.date >= DATE '{BATCH_FROM}' AND (s.hw IS NULL OR b.date > s.hw)""",
        "recent_window": O.long_sql(plan, ["Close", "XS"], sd, f"""
            SELECT isin, date, {O.Q('sum(value) FILTER (WHERE type = \'Close\')')} AS "Close",
                   {O.Q('sum(value) FILTER (WHERE type = \'XS\')')} AS "XS"
            FROM long WHERE date > DATE '{AS_OF}' - INTERVAL 300 DAY GROUP BY isin, date"""),
        "instrument_history": _scored_sql(f"""
            SELECT isin, symbol, name, date, {O.Q('"Close"')} AS "Close", {O.Q('"P-Close-1"')} AS "PClose",
                   kmeans, {PRED_COLS} FROM named WHERE isin = '{REPORT_ISIN}'"""),
        "watchlist_report": _scored_sql(f"""
            SELECT isin, symbol, name, date, kmeans, {PRED_COLS}
            FROM named WHERE isin IN (SELECT isin FROM wl)
            QUALIFY row_number() OVER (ORDER BY {RANK}) <= (SELECT 2 * count(*) FROM wl)""",
                                        extra_ctes=f""",
wl AS (SELECT DISTINCT CAST(s_suppkey AS VARCHAR) AS isin FROM supplier
       JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
       WHERE r_name = '{FX.WATCH_REGION}')"""),
        "top_opportunities_rule": _scored_sql(f"""
            SELECT isin, symbol, name, date, {PRED_COLS} FROM named ORDER BY {RANK} LIMIT 6"""),
        "dips_rule": _scored_sql(f"""
            SELECT isin, symbol, name, date, {O.Q('"prediction-gt1"')} AS "prediction-gt1",
                   {O.Q('"P-Close-1"')} AS "PClose" FROM named WHERE "prediction-gt1" = 1
            ORDER BY date DESC, "P-Close-1" ASC NULLS FIRST, isin ASC LIMIT 6"""),
        "training_set": _training_sql(),
        "precision_reduce": _precision_sql(),
        "minmax_scaled": _minmax_sql(),
        "serie_perf_null_keys": f"""
            WITH b AS (SELECT nullif(isin, '7') AS isin, nullif(date, DATE '{NULL_DAY}') AS date, "Close" AS x, "Open" AS o FROM ({sd}) t),
            s AS (SELECT *, row_number() OVER w AS rn, lead(x, 5) OVER w AS y, count(*) OVER (PARTITION BY isin) AS n
                  FROM b WINDOW w AS (PARTITION BY isin ORDER BY date NULLS FIRST))
            SELECT isin, date, {O.Q('x')} AS "Close", {O.Q('o')} AS "Open",
                   {O.Q('CASE WHEN rn + 5 > n THEN NULL WHEN x IS NULL OR y IS NULL OR x = 0 OR y = 0 THEN 0.0 ELSE x / y - 1 END')} AS p FROM s""",
        "features_wide_nulls": O.wide_sql(plan, names, f"""SELECT isin, date, "Open", "Low",
            CASE WHEN day(date) % 9 <> 0 THEN "Close" END AS "Close", CASE WHEN "Number_of_Trades" < 2 THEN "High" END AS "High" FROM ({sd}) t"""),
        "upsert_append": _upsert_sql(),
        "upsert_partitions": _upsert_sql(),
        "daily_job": O.wide_sql(plan, EXPORT_COLS, _job_bars()),
        "quotes_csv_roundtrip": O.quantized_bars(sd),
        "quotes_rejects": f"""
            WITH b AS (SELECT day(date) AS d FROM ({sd}) q), c AS (
                SELECT 'kept' AS reason, count(*) FILTER (WHERE d < 29) AS n FROM b UNION ALL SELECT 'damaged', count(*) FILTER (WHERE d = 28) FROM b
                UNION ALL SELECT 'no date', count(*) FILTER (WHERE d = 29) FROM b UNION ALL SELECT 'no instrument', count(*) FILTER (WHERE d = 30) FROM b
                UNION ALL SELECT 'bad date', count(*) FILTER (WHERE d = 31) FROM b UNION ALL SELECT 'blank', count(*) FILTER (WHERE d = 1) FROM b)
            SELECT reason, n AS n_lines, n AS n_counted FROM c""",
        "history_csv_roundtrip": f"""
            SELECT isin, date, {', '.join(O.Q(O.ident(c)) + ' AS ' + O.ident(c) for c in ('Open', 'High', 'Low', 'Close'))},
                   {O.Q('CASE WHEN CAST(isin AS BIGINT) % 2 = 0 THEN "Number_of_Shares" END')} AS "Number_of_Shares",
                   {O.Q('CASE WHEN CAST(isin AS BIGINT) % 2 = 1 THEN "Turnover" END')} AS "Turnover" FROM ({sd}) b""",
        "stock_csv_roundtrip": f"""
            WITH last AS (SELECT l_suppkey, max(l_shipdate) AS t FROM lineitem GROUP BY l_suppkey)
            SELECT s_name AS "Name", 'FR' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || '0' AS "ISIN", 'S' || CAST(s_suppkey AS VARCHAR) AS "Symbol",
                   n_name AS "Market", 'EUR' AS "Trading_Currency", CAST(last.t AS DATE) AS "Last_Day", {O.Q('CAST(s_acctbal AS DOUBLE)')} AS "Turnover"
            FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN last ON s_suppkey = last.l_suppkey""",
        "long_store_roundtrip": _long_sql(plan, ["Close", "P-XS-5"]),
        "export_roundtrip": O.wide_sql(plan, EXPORT_COLS, sd),
        **_model_sql(),
    }
    return out if LLM is None else out | LLM.oracle_sql()
