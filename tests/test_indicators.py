"""Wide plan vs row-based long-form operators, edge cases, plan shape."""
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import longform as LF
from tidemark.plans import indicators as IND
from tidemark.plans import spec as S
from tidemark.session import materialize


def test_standard_plan_shape():
    plan = S.standard_plan()
    assert len(plan) == 69 and len({s.name for s in plan}) == 69
    assert [len(l) for l in S.standard_layers()] == [4, 9, 13, 12, 18, 9, 4]
    assert S.reach(plan) == (199, 30)


def _long_by_operators(base):
    """The standard plan computed layer by layer with the long-form API."""
    ind = base
    for layer in S.standard_layers()[1:]:
        outs = []
        for s in layer:
            if s.op == "ma_plus":
                outs.append(LF.ma_plus(ind, s.inputs[0], s.name, s.n))
            elif s.op == "stddev":
                outs.append(LF.stddev(ind, s.inputs[0], s.n))
            elif s.op == "perf":
                outs.append(LF.performance(ind, s.inputs[0], s.n))
            elif s.op == "deriv":
                outs.append(LF.derivative(ind, s.inputs[0], s.n))
            elif s.op == "boll_h":
                outs.append(LF.bollinger(ind, s.inputs[0], s.inputs[1]))
            elif s.op == "boll_l":
                continue
            elif s.op == "diff":
                outs.append(LF.diff(ind, *s.inputs))
            elif s.op == "rate":
                outs.append(LF.rate(ind, *s.inputs))
            elif s.op == "class":
                outs.append(LF.classification(ind, s.inputs[0]))
            elif s.op == "gt":
                outs.append(LF.bin_gt(ind, s.inputs[0], s.n))
        # like the layered store: each layer is written before the next reads it
        ind = materialize(LF.union_all([ind] + outs), "layer")
    return ind


def _close(a, b):
    if a is None or b is None:
        return a is None and b is None
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def test_wide_equals_long_operators(spark, bars001):
    names = S.standard_names()
    long_ops = _long_by_operators(LF.base_series(bars001))
    long_view = IND.build_long(bars001)
    # same rows per type (row presence semantics)
    a = {r["type"]: r["count"] for r in IND.stats(long_ops).collect()}
    b = {r["type"]: r["count"] for r in IND.stats(long_view).collect()}
    assert a == b and len(a) == 69
    # same values after pivot
    wide = {(r["isin"], r["date"]): r for r in IND.build_wide(bars001).collect()}
    piv = IND.pivot(long_ops, names).collect()
    assert len(piv) == len(wide)
    bad = 0
    for r in piv:
        w = wide[(r["isin"], r["date"])]
        for n in names:
            bad += not _close(r[n], w[n])
    assert bad == 0


@pytest.mark.parametrize("bucket", ["day", "month", "year"])
def test_chunking_is_exact(spark, bars001, bucket):
    names = S.standard_names()
    ref = {(r["isin"], r["date"]): r for r in
           IND.build_wide(bars001, chunk_rows=1 << 20, bucket="year").collect()}
    small = IND.build_wide(bars001, chunk_rows=50, bucket=bucket).collect()   # halo 199/30
    assert len(small) == len(ref)
    for r in small:
        w = ref[(r["isin"], r["date"])]
        assert all(_close(r[n], w[n]) for n in names)


def test_chunks_really_split(spark, bars001):
    from tidemark.operators.longform import chunk_plan
    plan = chunk_plan(bars001, "day").targets(199, 30, 50)
    per = plan.select("isin", F.explode("_targets").alias("t")).groupBy("isin").agg(
        F.countDistinct("t.c").alias("chunks"), F.sum(F.col("t.h").cast("int")).alias("halo"))
    r = per.agg(F.min("chunks"), F.max("chunks"), F.sum("halo")).first()
    assert r[0] >= 2 and r[2] > 0


@pytest.mark.parametrize("chunk_rows", [1 << 20, 40])
def test_missing_prices_keep_their_rows(spark, chunk_rows):
    rows = [("k", i, None if i in (1, 50) or 70 <= i < 110 else float(1 + i % 7 + i / 50)) for i in range(400)]
    q = spark.createDataFrame(rows, "isin string, i int, p double").select(
        "isin", F.expr("date_add(DATE'2020-01-01', i)").alias("date"), F.col("p").alias("Close"), F.col("p").alias("Open"), F.col("p").alias("Low"),
        F.when(F.col("i") % 5 != 2, F.col("p")).alias("High"))
    names = S.standard_names()
    wide = {(r["isin"], r["date"]): r for r in IND.build_wide(q, chunk_rows=chunk_rows, bucket="month").collect()}
    assert len(wide) == 400
    base = LF.base_series(q)
    ind = [base, LF.ma_plus(base, "Close", "XS", 3)]
    ind.append(LF.performance(ind[1], "XS", -5))
    ind.append(LF.derivative(ind[2], "P-XS-5", -1))
    for r in LF.union_all(ind).collect():
        assert r["type"] in names and _close(r["value"], wide[(r["isin"], r["date"])][r["type"]]), r
    # three days, High missing on the second: the third day's return is of its neighbour
    few = spark.createDataFrame([("a", f"2020-01-0{i}", float(i), None if i == 2 else 1.0) for i in (1, 2, 3)], "isin string, d string, p double, h double").select(
        "isin", F.to_date("d").alias("date"), F.col("p").alias("Close"), F.col("p").alias("Open"), F.col("p").alias("Low"), F.col("h").alias("High"))
    got = sorted((str(r["date"]), r["P-Close-1"]) for r in IND.build_wide(few, columns=["P-Close-1"]).collect())
    assert got == [("2020-01-01", None), ("2020-01-02", 1.0), ("2020-01-03", 0.5)]


def _scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_chains_share_one_chunk_plan(spark, bars001):
    plan = LF.chunk_plan(bars001)
    cur, scans = LF.base_series(bars001), []
    sc = spark.sparkContext
    sc.setJobGroup("build", "plans only")
    for i in range(4):
        cur = LF.ma_plus(cur, "Close" if i == 0 else f"M{i - 1}", f"M{i}", 3, plan=plan)
        scans.append(_scans(cur))
    assert sc.statusTracker().getJobIdsForGroup("build") == []  # nothing runs while a query is built
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert [b - a for a, b in zip(scans, scans[1:])] == [1, 1, 1]
    stored = plan.stored()
    a = {(r["isin"], r["date"]): r["value"] for r in cur.collect()}
    cur = LF.base_series(bars001)
    for i in range(4):
        cur = LF.ma_plus(cur, "Close" if i == 0 else f"M{i - 1}", f"M{i}", 3, plan=stored)
    assert {(r["isin"], r["date"]): r["value"] for r in cur.collect()} == a


def test_single_row_and_zero_price(spark):
    q = spark.createDataFrame(
        [("one", "2020-01-01", 1.0, 1.0, 1.0, 1.0)]
        + [("z", f"2020-01-0{i + 1}", p, p, p, p) for i, p in enumerate([1.0, 2.0, 4.0, 0.0, 5.0])],
        "isin string, d string, Open double, High double, Low double, Close double"
    ).withColumn("date", F.to_date("d")).drop("d")
    w = {(r["isin"], str(r["date"])): r for r in
         IND.build_wide(q, columns=["Close", "XS", "STDDEV-Close-10", "P-Close-1", "P-Close+1", "Close/Open"]).collect()}
    one = w[("one", "2020-01-01")]
    assert one["XS"] == 1.0 and one["STDDEV-Close-10"] is None
    assert one["P-Close-1"] is None and one["P-Close+1"] is None
    # zero divisor -> NULL, not an error
    assert w[("z", "2020-01-05")]["P-Close-1"] is None
    assert w[("z", "2020-01-04")]["P-Close+1"] is None
    assert w[("z", "2020-01-04")]["Close/Open"] is None
    assert w[("z", "2020-01-03")]["P-Close+1"] == -1.0


def test_series_do_not_bleed_and_order_is_from_key(spark, bars001):
    names = ["XS", "P-XS-5", "STDDEV-XS-10"]
    a = {(r["isin"], r["date"]): r for r in IND.build_wide(bars001, columns=names).collect()}
    shuffled = bars001.orderBy(F.rand(3)).coalesce(1)
    b = IND.build_wide(shuffled, columns=names).collect()
    assert all(all(_close(r[n], a[(r["isin"], r["date"])][n]) for n in names) for r in b)


def test_labels_need_presence_not_value(spark):
    # Close 0 on day 1: P-XS+15 is NULL (zero divisor) but the row exists -> Class 0.0
    rows = [("k", f"2020-{1 + i // 28:02d}-{1 + i % 28:02d}", 0.0 if i < 3 else float(i))
            for i in range(40)]
    q = (spark.createDataFrame(rows, "isin string, d string, p double")
         .select("isin", F.to_date("d").alias("date"), *[F.col("p").alias(c) for c in S.BASE]))
    w = sorted(IND.build_wide(q, columns=["P-XS+15", "Class", "gt1"]).collect(), key=lambda r: r["date"])
    assert w[0]["P-XS+15"] is None and w[0]["Class"] == 0.0
    assert w[-1]["Class"] is None and w[-1]["gt1"] is None      # no future row


def test_one_window_exchange(spark, bars001):
    chunks = LF.chunk_plan(bars001).stored()
    plan = IND.build_wide(bars001, chunks=chunks)._jdf.queryExecution().executedPlan().toString()
    exchanges = [l for l in plan.split("\n") if "Exchange hashpartitioning" in l]
    chunk_ex = [l for l in exchanges if "_chunk" in l]
    assert len(chunk_ex) == 1           # one shuffle of the rows for all 69 series
    # the only other exchanges are over the small (isin, bucket) count table
    assert all("_bk" in l or "_c#" in l or "hashpartitioning(isin#" in l for l in exchanges)
    assert "BroadcastHashJoin" in plan  # by the written size of the counts, not by a hint


def test_scan_prunes_columns(spark, bars001):
    plan = IND.build_wide(bars001, columns=["XS"])._jdf.queryExecution().executedPlan().toString()
    schemas = [l[l.index("ReadSchema"):] for l in plan.split("\n") if "ReadSchema" in l]
    assert schemas
    for s in schemas:
        assert "Turnover" not in s and "Number_of_Shares" not in s


def _odd_quotes(spark):
    rows = [("k" if i % 3 else None, i, None if i % 11 == 4 else 0.0 if i == 60 else float("nan") if i == 130 else 900 + (i * 37 % 101) / 7) for i in range(400)]
    return spark.createDataFrame(rows, "isin string, i int, p double").select(
        "isin", F.expr("date_add(DATE'2020-01-01', i)").alias("date"), F.col("p").alias("Close"), (F.col("p") * 20).alias("Open"), F.col("p").alias("Low"),
        F.when(F.col("i") % 5 != 2, F.col("p")).alias("High"))


def test_blocks_give_the_doubles_of_spark_windows(spark):
    from pyspark.sql import Window
    from tidemark.functions import columns as C
    q = _odd_quotes(spark)
    w = Window.partitionBy("isin").orderBy("date")
    want = q.select("isin", "date", C.ma_plus(F.col("Close"), 200, w).alias("XXL"), C.ma_plus(F.col("High"), 3, w).alias("XS-H"),
                    C.rolling_stddev(F.col("Close"), 10, w).alias("STDDEV-Close-10"), C.performance(F.col("Close"), 5, w).alias("P-Close+5"))
    got = IND.build_wide(q, columns=["XXL", "XS-H", "STDDEV-Close-10", "P-Close+5"])
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()  # not a sliding frame for each row
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() == 400


def test_grid_is_that_of_the_queries(spark):
    import __spark_entry__ as E
    q = _odd_quotes(spark)
    a, b = IND.build_wide(q, grid=True), E.quantize(IND.build_wide(q))
    assert a.dtypes == b.dtypes and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_long_rows_come_from_the_tasks(spark):
    q, names = _odd_quotes(spark), S.standard_names()
    a, b = IND.build_long(q), IND.long_view(IND.build_wide(q, presence=True), names)
    assert a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert "__p__" not in a._jdf.queryExecution().executedPlan().toString()


def test_blocks_end_with_their_groups():
    import pyarrow as pa
    from tidemark.functions import kernels as K
    key = [k for k, n in ((None, 3), ("a", 70_000), ("b", 1), ("c", 40_000)) for _ in range(n)]
    t = pa.table({"isin": pa.array(key, pa.string()), "_chunk": pa.array([0] * len(key))})
    parts = list(K.blocks(t.to_batches(max_chunksize=9_000), ["isin", "_chunk"]))
    assert sum(p.num_rows for p, _ in parts) == len(key) and sum(int(new.sum()) for _, new in parts) == 4
    assert all(new[0] for _, new in parts) and len(parts) > 1


def test_pivot_shuffles_one_row_for_each_date(spark):
    rows = [("a", 1, 1.0, "x"), ("a", 1, 2.0, "y"), ("a", 1, 4.0, "x"), ("a", 2, None, "x"), ("b", 1, 3.0, "z"), (None, 1, 5.0, "y"), ("b", 2, 1.0, None), ("b", 2, 2.0, "y")]
    long = spark.createDataFrame(rows, "isin string, date int, value double, type string")
    got = IND.pivot(long, ["y", "x"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert sorted(map(str, got.collect())) == sorted(map(str, long.groupBy("isin", "date").pivot("type", ["y", "x"]).agg(F.sum("value")).collect()))


def test_bars_of_single_rows_are_not_combined_before_the_shuffle(spark):
    from tidemark.sources import bars as B
    rows = B.read_table(spark, "/root/testdata/sf0.001", "lineitem")
    plan = B.supplier_day(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Aggregate" not in plan.split("Exchange hashpartitioning")[1]
    events = B.event_hour(B.read_table(spark, "/root/testdata/sf0.001", "events"))._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" in events.split("Exchange hashpartitioning")[1]  # many rows a bar
