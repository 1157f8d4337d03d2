import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries, rtree

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, anchor, positives=5, negatives=10, window=(30, 90, 100), scale=256):
    """Every anchor against every row with Python's whole numbers."""
    good = [(i, label, [math.floor(scale * float(x)) for x in v]) for i, v, label in rows]
    out = []
    for i, label, q in sorted({(i, label, tuple(v)) for i, label, v in good if anchor(i)}):
        scored = [(-sum(a * b for a, b in zip(q, v)), j, other) for j, other, v in good]
        for s, j, _ in sorted(x for x in scored if x[2] == label and x[1] != i)[:positives]:
            low, high, of = window
            fits = sorted(x for x in scored if x[2] != label and low * -s <= of * -x[0] <= high * -s)[:negatives]
            out += [(i, j, k, n, -s, -t) for k, (t, n, _) in enumerate(fits, 1)]
    return sorted(out)


def small(monkeypatch, leaf=4, fan=3, unit=16):
    for name, value in {"LEAF": leaf, "FAN": fan, "UNIT_ROWS": unit, "SMALL_UNIT": 8, "QUERY_BATCH": 3}.items():
        monkeypatch.setattr(rtree, name, value)


def mined(df, every=10, **kw):
    return sorted(tuple(r) for r in rtree.mine(df, F.col("id") % every == 0, **kw).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force_with_ties_and_copies(spark, monkeypatch, seed):
    small(monkeypatch)
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.integers(-3, 6, 5) / 256).tolist(), int(rng.integers(0, 3))) for i in range(200)]
    rows += [(i, [2 / 256, 1 / 256, 0.0, 3 / 256, 1 / 256], i % 2) for i in range(200, 330)]  # a third are copies of one vector
    assert mined(spark.createDataFrame(rows, SCHEMA).repartition(3), sample=40) == brute(rows, lambda i: i % 10 == 0)


def test_long_components_stay_exact(spark, monkeypatch):
    small(monkeypatch)
    rng = np.random.default_rng(4)
    rows = [(i, rng.uniform(0, 2e6, 3).tolist(), i % 3) for i in range(120)]
    rows += [(1000, [1e300, 0.0, 0.0], 1), (1001, [9e6, 0.0, 0.0], 1)]  # squared norms over 2^62 take no part
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows[:120], lambda i: i % 10 == 0)


def test_other_windows_and_counts(spark, monkeypatch):
    small(monkeypatch)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).tolist(), i % 2) for i in range(90)]
    kw = {"positives": 2, "negatives": 3, "window": (1, 2, 3), "scale": 10}
    assert mined(spark.createDataFrame(rows, SCHEMA), **kw) == brute(rows, lambda i: i % 10 == 0, **kw)


def test_boxes_prune(monkeypatch):
    """On clustered rows a query opens few leaves and finds what all rows hold."""
    small(monkeypatch, leaf=8, fan=4)
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.integers(-5, 6, (80, 6)) + c for c in rng.integers(-400, 400, (20, 6))])
    order = rtree.str_order(x, rtree.by_spread(x, len(x) // 8), 8)
    assert sorted(order.tolist()) == list(range(len(x)))
    x = x[order]
    tree = rtree.Tree(np.arange(len(x)), np.arange(len(x)) % 3, x)
    opened = []
    for q in x[::50]:
        below, above = tree.bounds(q[None])
        s = x @ q
        assert (below[0][:tree.leaves] <= np.minimum.reduceat(s, np.arange(0, len(x), 8))).all() and (above[0][:tree.leaves] >= np.maximum.reduceat(s, np.arange(0, len(x), 8))).all()
        for low, high in ((-1 << 62, 1 << 62), (int(np.median(s)), int(np.quantile(s, .8)))):
            scored: dict = {}
            got = tree.search(q, below[0].tolist(), above[0].tolist(), scored, None, 1, False, low, high, 10, rtree.LOW)
            assert got == sorted((-int(v), i) for i, v in enumerate(s) if i % 3 != 1 and low <= v <= high)[:10]
            opened.append(len(scored))
    assert np.mean(opened) < tree.leaves / 4


def test_tiles_part_equal_rows_by_their_own_numbers():
    rng = np.random.default_rng(8)
    x = np.zeros((4000, 3), dtype=np.int64)
    x[:1000] = rng.integers(-50, 50, (1000, 3))
    u = rng.random(4000)
    tiles = rtree.Tiles(x[::4], u[::4], 16)
    counts = np.bincount(tiles.place(x, u), minlength=tiles.blocks)
    assert 8 <= tiles.blocks <= 32 and counts.max() < 4000 / 4 and counts.sum() == 4000


def test_odd_rows(spark, monkeypatch):
    small(monkeypatch)
    good = [(i, [i / 256, 1.0], i % 2) for i in range(30)] + [(5, [5 / 256, 1.0], 1), (10, [10 / 256, 1.0], 0)]  # repeated rows
    odd = [(100, None, 1), (101, [1.0, None], 1), (102, [1.0, float("nan")], 0), (103, [float("-inf"), 1.0], 0), (104, [1.0, 1.0], None), (None, [1.0, 1.0], 1),
           (106, [], 1), (107, [1.0], 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in good + odd], SCHEMA + ", id string, u int")
    assert mined(df) == brute(good, lambda i: i % 10 == 0)
    for rows in ([], [(0, None, 1)], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [2.0], 1)], [(0, [1.0], 1), (1, [-1.0], 1), (2, [1.0], 0)]):
        assert mined(spark.createDataFrame(rows, SCHEMA)) == []


def test_query(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op11_hard_negatives(spark, sf).collect()) == brute(rows, lambda i: i % 100 == 0)


def test_routed_batches_are_not_broadcast(spark, monkeypatch):
    """They grow with anchors x units, which Spark cannot know: units and batches meet without a join."""
    small(monkeypatch)
    rows = [(i, [i / 256, (i % 7) / 256], i % 2) for i in range(200)]
    index = rtree.build(spark.createDataFrame(rows, SCHEMA), "vec_id", "label", "embedding")
    every = F.array(F.struct(F.lit(rtree.LOW).alias("low"), F.lit(rtree.HIGH).alias("high")))
    asked = index.rows.where(F.col("id") % 50 == 0).select(F.col("id").alias("key"), "id", "label", "vec", every.alias("windows"))
    found = rtree.search(index, asked, True, 3)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.key, r.rank) for r in found.collect()) == [(k, n) for k in (0, 50, 100, 150) for n in (1, 2, 3)]


def test_a_unit_without_rows_is_passed_over(spark, monkeypatch):
    small(monkeypatch)
    rows = [(i, [i / 256, (i % 7) / 256], i % 2) for i in range(100)]
    index = rtree.build(spark.createDataFrame(rows, SCHEMA), "vec_id", "label", "embedding")
    gone = index.units.where("unit = 1")
    ids = set(np.frombuffer(gone.first().ids, dtype=np.int64).tolist())
    index.units = index.units.where("unit <> 1")
    every = F.array(F.struct(F.lit(rtree.LOW).alias("low"), F.lit(rtree.HIGH).alias("high")))
    asked = index.rows.where(F.col("id") % 10 == 0).select(F.col("id").alias("key"), "id", "label", "vec", every.alias("windows"))
    got = {r.id for r in rtree.search(index, asked, False, 100).collect()}
    assert got == {i for i in range(100) if i % 2} - ids  # anchors are even, of label 0
