"""The checks of the model reports fail for a wrong report."""
import datetime as dt

import __spark_entry__ as E
import pytest


@pytest.fixture(scope="module")
def scored(spark):
    d = dt.date(2020, 1, 2)
    rows = [("a", d, 1.0, 0.9, -0.1), ("b", d, 1.0, 0.8, None), ("c", d, None, 0.99, 0.2), ("d", dt.date(2020, 1, 1), 1.0, 1.0, -0.9), ("e", d, 1.0, 0.8, -0.3)]
    return spark.createDataFrame(rows, "isin string, date date, `prediction-gt1` double, `probability-gt1` double, `P-Close-1` double")


ORDER = [("date", "desc"), ("prediction-gt1", "desc"), ("probability-gt1", "desc"), ("isin", "asc")]


def test_right_and_wrong_reports(scored):
    by = {r["isin"]: r for r in scored.collect()}
    pick = lambda names: [by[n] for n in names]
    assert all(E.in_rank_order(pick("abecd"), scored, ORDER)) and E.in_rank_order([], scored, ORDER) == []
    assert E.in_rank_order(pick("bae"), scored, ORDER) == [False, False, True]  # swapped
    assert not all(E.in_rank_order(pick("abc"), scored, ORDER))  # a better row left out
    assert not all(E.in_rank_order(pick("dab"), scored, ORDER))  # an older day first
    falls = [("date", "desc"), ("P-Close-1", "asc_nulls_first"), ("isin", "asc")]
    assert all(E.in_rank_order(pick("beacd"), scored, falls)) and not all(E.in_rank_order(pick("ea"), scored, falls))


def test_a_long_report_is_selected_by_day(spark):
    """Ties, NaN and nulls in every ranking column; the cut on each kind of day."""
    from pyspark.sql import functions as F

    from tidemark.plans import reports as REP
    col = lambda m, v: F.when(F.col("id") % m == 0, None).when(F.col("id") % m == 1, float("nan")).otherwise((F.col("id") % v).cast("double"))
    pred = spark.range(4000).select(
        F.when(F.col("id") % 50 != 0, F.concat(F.lit("i"), (F.col("id") % 400).cast("string"))).alias("isin"),
        F.when(F.col("id") >= 400, F.date_add(F.lit(dt.date(2020, 1, 1)), (F.col("id") % 9).cast("int"))).alias("date"),
        col(11, 2).alias("prediction-gt1"), col(13, 2).alias("prediction-gt2"), col(17, 2).alias("prediction-gt3"),
        col(19, 5).alias("probability-gt1"), F.lit(1).alias("kmeans"))
    pred = spark.createDataFrame(pred.collect(), pred.schema)
    stock = spark.createDataFrame([(f"i{i}", f"S{i}", f"N{i}") for i in range(400)], "ISIN string, Symbol string, Name string")
    d = pred.withColumn("_p1", F.col("probability-gt1"))
    for n in (1, 7, 390, 1000, 3601, 3999, 4000, 9000):
        want = d.orderBy(*REP._ranking(d)).limit(n).drop("isin")  # equal rows may stand in for each other
        got = REP.first_by_day(d, n, part_rows=64).drop("isin")
        assert got.count() == want.count() == min(n, 4000) and got.exceptAll(want).isEmpty()
    watched = spark.createDataFrame([(f"i{i}",) for i in range(300)], "isin string")
    long, short = (REP.watchlist_report(pred, stock, watched, short=s) for s in (0, 10_000))
    text = lambda f: [str(r) for r in f.collect()]
    assert text(long) == text(short) and len(text(short)) == 600
    assert "TakeOrdered" not in long._jdf.queryExecution().executedPlan().toString()


def test_elbow_errors_are_those_of_the_centres(spark):
    from pyspark.ml.linalg import Vectors
    rows = spark.createDataFrame([(Vectors.dense(float(i), 0.0),) for i in range(6)], ["scaledFeatures"])
    from tidemark.plans import ml as ML
    got = {r["k"]: (r["rows"], r["wssse"]) for r in ML.errors_at(rows.repartition(3), {1: [[2.5, 0.0]], 2: [[1.0, 0.0], [4.0, 1.0]]}).collect()}
    assert got == {1: (6, 17.5), 2: (6, 7.0)}
