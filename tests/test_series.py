"""Row-series operators: the original unit-test numbers plus brute force."""
import math
import random

import pytest

from tidemark.operators import series as SR

F1 = [("a", 1, 1.0), ("a", 2, 1.0), ("a", 3, 2.0), ("a", 4, 3.0), ("a", 5, 4.0),
      ("b", 1, 10.0), ("b", 2, 20.0)]


@pytest.fixture(scope="module")
def f1(spark):
    return spark.createDataFrame(F1, "ISIN string, id int, val double")


def rows(df, col):
    return {(r["ISIN"], r["id"]): r[col] for r in df.collect()}


def test_ema_rate_one_is_identity(f1):
    out = rows(SR.ema(f1, "val", "ema", 1.0, order="id"), "ema")
    assert all(out[(k, i)] == v for k, i, v in F1)


def test_ema_rate_zero_is_first_value(f1):
    out = rows(SR.ema(f1, "val", "ema", 0.0, order="id"), "ema")
    assert all(out[("a", i)] == 1.0 for i in range(1, 6))
    assert out[("b", 2)] == 10.0


def test_ema_recurrence(f1):
    out = rows(SR.ema(f1, "val", "ema", 0.2, order="id"), "ema")
    assert out[("b", 1)] == 10.0
    assert out[("b", 2)] == pytest.approx(10 * 0.8 + 20 * 0.2)


def test_ema_null_gap_reseeds(spark):
    df = spark.createDataFrame([("x", i, v) for i, v in enumerate([1.0, 2.0, None, 3.0, 4.0])],
                               "ISIN string, id int, val double")
    out = rows(SR.ema(df, "val", "ema", 0.2, order="id"), "ema")
    assert out[("x", 0)] == 1.0
    assert out[("x", 1)] == pytest.approx(1.2)
    assert out[("x", 2)] is None
    assert out[("x", 3)] == 3.0
    assert out[("x", 4)] == pytest.approx(3.2)


def test_ema_order_and_partition_independent(spark, f1):
    shuffled = spark.createDataFrame(list(reversed(F1)), "ISIN string, id int, val double").coalesce(1)
    a = rows(SR.ema(f1, "val", "ema", 0.3, order="id"), "ema")
    b = rows(SR.ema(shuffled, "val", "ema", 0.3, order="id"), "ema")
    assert a == pytest.approx(b)


def brute_ema(vals, r):
    out, prev = [], None
    for v in vals:
        if v is None:
            out.append(None)
        elif prev is None:
            out.append(v)
        else:
            out.append(v * r + prev * (1 - r))
        prev = out[-1]
    return out


@pytest.mark.parametrize("rate,chunk", [(0.2, 3), (0.5, 4), (0.0, 5), (0.9, 2), (0.2, 1 << 17)])
def test_ema_chunked_matches_brute_force(spark, rate, chunk):
    rnd = random.Random(7)
    data = []
    for key in ["k1", "k2", "k3"]:
        for i in range(rnd.randint(1, 40)):
            v = None if rnd.random() < 0.15 else round(rnd.uniform(-5, 50), 3)
            data.append((key, i, v))
    df = spark.createDataFrame(data, "ISIN string, id int, val double")
    got = rows(SR.ema(df, "val", "ema", rate, order="id", chunk_rows=chunk, bucket=1), "ema")
    for key in ["k1", "k2", "k3"]:
        series = sorted((i, v) for k, i, v in data if k == key)
        exp = brute_ema([v for _, v in series], rate)
        for (i, _), e in zip(series, exp):
            g = got[(key, i)]
            if e is None:
                assert g is None
            else:
                assert g == pytest.approx(e, rel=1e-9, abs=1e-9), (key, i)


def test_performance_conventions(f1):
    p0 = rows(SR.performance(f1, "val", "p", 0, order="id"), "p")
    assert all(v == 0.0 for v in p0.values())
    p1 = rows(SR.performance(f1, "val", "p", 1, order="id"), "p")
    assert p1[("b", 1)] == -0.5          # current / future - 1
    assert p1[("b", 2)] is None          # no counterpart
    pm1 = rows(SR.performance(f1, "val", "p", -1, order="id"), "p")
    assert pm1[("b", 2)] == 1.0          # current / past - 1
    assert pm1[("b", 1)] is None


def test_zero_and_null_operands(spark):
    df = spark.createDataFrame([("z", i, v) for i, v in enumerate([1.0, 2.0, 4.0, 0.0, 5.0, None, 6.0])],
                               "ISIN string, id int, val double")
    p = rows(SR.performance(df, "val", "p", -1, order="id"), "p")
    assert p[("z", 0)] is None and p[("z", 1)] == 1.0 and p[("z", 3)] == 0.0 and p[("z", 4)] == 0.0
    assert p[("z", 5)] == 0.0 and p[("z", 6)] == 0.0
    d = rows(SR.derivative(df, "val", "d", 1, order="id"), "d")
    assert d[("z", 0)] == -1.0 and d[("z", 2)] == 0.0 and d[("z", 6)] is None
    r = rows(SR.rate(df.withColumn("b", df["val"] - 1), "val", "b", "r"), "r")
    assert r[("z", 1)] == 1.0 and r[("z", 0)] == 0.0 and r[("z", 5)] == 0.0


@pytest.mark.parametrize("n", [-3, -1, 2, 5])
def test_paired_chunked_matches_brute_force(spark, n):
    rnd = random.Random(n + 10)
    data = [(k, i, None if rnd.random() < 0.1 else float(rnd.randint(0, 9)))
            for k in ["p", "q"] for i in range(rnd.randint(3, 30))]
    df = spark.createDataFrame(data, "ISIN string, id int, val double")
    got = rows(SR.performance(df, "val", "p", n, order="id", chunk_rows=4, bucket=1), "p")
    for key in ["p", "q"]:
        vals = [v for _, v in sorted((i, v) for k, i, v in data if k == key)]
        for t, v in enumerate(vals):
            j = t + n
            if j < 0 or j >= len(vals):
                exp = None
            else:
                o = vals[j]
                exp = 0.0 if (v is None or o is None or v == 0 or o == 0) else v / o - 1
            g = got[(key, t)]
            assert (g is None and exp is None) or g == pytest.approx(exp)


@pytest.mark.parametrize("block", [1, 2, 3])
def test_ema_multi_block_carry_scan(spark, monkeypatch, block):
    """Tiny chunks and tiny carry blocks: every level of the carry scan runs."""
    monkeypatch.setattr(SR, "CARRY_BLOCK", block)
    monkeypatch.setattr(SR, "MAX_HALO", 0)
    rnd = random.Random(block)
    data = [(k, i, None if rnd.random() < 0.1 else round(rnd.uniform(1, 9), 2))
            for k in ["m", "n"] for i in range(rnd.randint(20, 45))]
    df = spark.createDataFrame(data, "ISIN string, id int, val double")
    got = rows(SR.ema(df, "val", "ema", 0.25, order="id", chunk_rows=3, bucket=1), "ema")
    for key in ["m", "n"]:
        series = sorted((i, v) for k, i, v in data if k == key)
        for (i, _), e in zip(series, brute_ema([v for _, v in series], 0.25)):
            g = got[(key, i)]
            assert (g is None and e is None) or g == pytest.approx(e, rel=1e-9, abs=1e-9), (key, i)


@pytest.mark.parametrize("rate", [0.0, 0.0001, 0.2, 0.9])
@pytest.mark.parametrize("chunk", [3, 1 << 17])
def test_null_keys_and_orders_stay(spark, rate, chunk):
    data = [(k, o, float(i % 5) if i % 4 else None) for i, (k, o) in enumerate((k, o) for k in ("a", None, "b") for o in (None, *range(12)))]
    df = spark.createDataFrame(data, "ISIN string, id int, val double")
    exp = {}
    for k in ("a", None, "b"):
        prev = None
        for _, o, v in sorted((r for r in data if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0)):
            prev = None if v is None else v if prev is None else v * rate + prev * (1 - rate)
            exp[(k, o)] = prev
    got = {(r["ISIN"], r["id"]): r["e"] for r in SR.ema(df, "val", "e", rate, order="id", chunk_rows=chunk, bucket=2).collect()}
    assert got.keys() == exp.keys()
    assert all(got[k] == pytest.approx(v) if v is not None else got[k] is None for k, v in exp.items())
    assert SR.performance(df, "val", "p", 1, order="id", chunk_rows=chunk, bucket=2).count() == len(data)


def test_ema_forgets_within_its_halo(spark):
    """Long series over many chunks: the halo form equals the recurrence."""
    data = [("x", i, math.sin(i) * 1000 + (1e6 if i == 0 else 0)) for i in range(3000)]
    df = spark.createDataFrame(data, "ISIN string, id int, val double")
    for rate in (0.2, 0.01):
        got = sorted((r["id"], r["e"]) for r in SR.ema(df, "val", "e", rate, order="id", chunk_rows=100, bucket=10).collect())
        prev = None
        for (_, i, v), (j, e) in zip(data, got):
            prev = v if prev is None else v * rate + prev * (1 - rate)
            assert i == j and e == pytest.approx(prev, rel=1e-12, abs=1e-9)


def test_ema_runs_no_python(spark, f1):
    for rate in (0.0, 0.2):
        plan = SR.ema(f1, "val", "e", rate, order="id")._jdf.queryExecution().toString()
        assert "Pandas" not in plan and "Arrow" not in plan and "Python" not in plan
    with pytest.raises(ValueError):
        SR.ema(f1, "val", "e", 1.5, order="id")


def test_ties_in_the_order_lose_no_halo(spark):
    df = spark.createDataFrame([("k", i // 3, float(i)) for i in range(754)], "ISIN string, id int, val double")
    out = SR.performance(df, "val", "p", -5, order="id", chunk_rows=1, bucket=1)
    assert out.count() == 754 and out.where("p is null").count() == 5


@pytest.mark.parametrize("rate", [0.2, 0.05, 0.9, 0.0001])
def test_ema_of_an_outlier_does_not_depend_on_the_chunks(spark, rate):
    """A first value 1e25 times the rest: equal at every chunk size, and to the plain recursion."""
    values = [1e25] + [1.0 + (i % 7) / 10 for i in range(1, 4000)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "ISIN string, id int, val double")
    want, y = [], None
    for v in values:
        y = v if y is None else v * rate + y * (1 - rate)
        want.append(y)
    for chunk_rows, bucket in ((50, 16), (300, 16), (1 << 17, 4096)):
        got = [r[0] for r in SR.ema(df, "val", "e", rate, order="id", chunk_rows=chunk_rows, bucket=bucket).orderBy("id").select("e").collect()]
        assert max(abs(a - b) / abs(b) for a, b in zip(got, want)) < 1e-9
