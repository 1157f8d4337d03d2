"""Over-full buckets are split: one key with a million rows in one day, ties, rows without an order value."""
import pytest
from pyspark.sql import functions as F

from tidemark.operators import sequence as SQ
from tidemark.operators import series as SR
from tidemark.operators.sequence import CHUNK, ChunkPlan, chunked, number_rows

N, LIMIT = 1_000_000, 50_000
DAY = 1_577_836_800  # 2020-01-01


@pytest.fixture(scope="module")
def ticks(spark):
    """Ticks of one day, nine tenths of them in its first second; and a few of another key."""
    micros = F.when(F.col("id") % 10 == 0, F.col("id") * 86_000).otherwise(F.col("id"))
    hot = spark.range(N).select(F.lit("hot").alias("ISIN"), F.timestamp_micros(F.lit(DAY * 1_000_000) + micros).alias("ts"), F.rand(3).alias("x"))
    cold = spark.range(100).select(F.lit("cold").alias("ISIN"), F.timestamp_seconds(F.lit(DAY) + F.col("id") * 90_000).alias("ts"), F.rand(4).alias("x"))
    return SQ.materialize(hot.unionByName(cold), "ticks")


def test_a_day_of_ticks_is_many_chunks(ticks):
    plan = ChunkPlan.of(ticks, "ISIN", "ts").stored(LIMIT)
    assert plan.cuts.count() == 1
    rows = chunked(ticks, "ISIN", "ts", 5, 0, LIMIT, plan=plan)
    sizes = [r["count"] for r in rows.groupBy("ISIN", CHUNK).count().collect()]
    assert max(sizes) < 3 * LIMIT and len(sizes) > N / LIMIT / 3
    assert rows.where("not _halo").count() == N + 100
    got = SR.performance(ticks, "x", "p", -5, order="ts", chunk_rows=LIMIT, plan=plan)
    want = SR.performance(ticks, "x", "p", -5, order="ts", chunk_rows=1 << 40)
    total = lambda d: d.agg(F.count("*"), F.count("p"), F.sum(F.xxhash64("ISIN", "ts", "p").cast("decimal(38,0)"))).first()
    assert total(got) == total(want)


def _positions_hold(df, n_keys):
    """Positions are 0..n-1 per key, and follow the order."""
    w = SQ.Window.partitionBy("k").orderBy("_rn")
    ok = F.coalesce(F.lag("o").over(w).isNull() | (F.lag("o").over(w) <= F.col("o")), F.lit(False)) & (F.col("_rn") == F.row_number().over(w) - 1)
    r = df.select("k", "o", "_rn", ok.alias("ok")).groupBy("k").agg(F.min("ok").alias("ok"), F.count("*").alias("n"), F.max("_rn").alias("last")).collect()
    assert len(r) == n_keys and all(x["ok"] and x["last"] == x["n"] - 1 for x in r)


def test_numbers_of_ticks_ties_and_rows_without_an_order(spark, ticks):
    _positions_hold(number_rows(ticks.select(F.col("ISIN").alias("k"), F.col("ts").alias("o"), "x"), "k", "o", split_rows=LIMIT), 2)
    odd = spark.range(40_000).select(
        F.when(F.col("id") % 4 < 3, F.lit("a")).alias("k"), F.when(F.col("id") % 2 == 0, F.col("id") % 3).alias("o"), F.col("id"))
    got = number_rows(odd, "k", ["o", "id"], split_rows=1000)
    _positions_hold(got, 2)
    _positions_hold(number_rows(odd, "k", "o", split_rows=1000), 2)  # ties part by a hash of the row
    same = number_rows(odd, "k", ["o", "id"], split_rows=None)
    assert got.exceptAll(same).isEmpty() and same.count() == got.count()


def test_parts_of_ties_and_nulls_are_small(spark):
    rows = spark.range(30_000).select(F.lit(1).alias("k"), F.when(F.col("id") % 3 == 0, F.lit(5)).alias("o"), "id").withColumn(
        SQ.BUCKET, F.floor(F.col("o") / 4096))
    value = F.struct("o", F.xxhash64("id").alias("t"))
    counts = SQ.materialize(rows.groupBy("k", SQ.BUCKET).agg(F.count("*").alias("_n")), "n")
    cuts = SQ.split_buckets(rows, ["k"], value, 1000, counts)
    sizes = [r["count"] for r in SQ.cut_buckets(rows, ["k"], value, cuts).groupBy("k", SQ.BUCKET).count().collect()]
    assert sum(sizes) == 30_000 and max(sizes) <= 1000
    assert SQ.split_buckets(rows, ["k"], value, 30_000, counts) is None
    one = F.struct("o")  # single values cannot be parted: no cuts, no endless rounds
    assert SQ.split_buckets(rows, ["k"], one, 1000, counts) is None
    assert SQ.split_buckets(rows.limit(0), ["k"], one, 1000, counts.limit(0)) is None
