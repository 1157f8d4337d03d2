import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import multiindex


def brute(rows, top, query):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=float)
    out = {}
    for k in np.flatnonzero([query(i) for i in ids]):
        s = (x * x[k]).sum(1)
        use = ids != ids[k]
        order = np.lexsort((ids[use], -s[use]))[:top]
        out[int(ids[k])] = [(int(a), float(b)) for a, b in zip(ids[use][order], s[use][order])]
    return out


def test_recall_and_scores(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    exp = brute(rows, 20, lambda i: i % 20 == 0)
    got: dict = {}
    vec = {i: np.array(v, dtype=float) for i, v in rows}
    for r in multiindex.nearest_neighbours(table, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert abs(r.score - float((vec[r.query_id] * vec[r.vec_id]).sum())) < 1e-12
    assert got.keys() == exp.keys() and all(len(set(v)) == 20 for v in got.values())
    recall = np.mean([len(set(got[q]) & {i for i, _ in exp[q]}) / 20 for q in exp])
    assert recall >= 0.9, recall


def test_whole_search_is_exact_with_ties_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(multiindex, "BLOCK_ROWS", 16)
    monkeypatch.setattr(multiindex, "GROUP_QUERIES", 8)
    rng = np.random.default_rng(2)
    good = [(i, rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(150)] + [(i, [1.0, 2.0, 0.0, 0.0, 1.0, 1.0]) for i in range(150, 220)]
    good = [(i, v) for i, v in good if any(v)]
    odd = [(900, None), (901, [0.0] * 6), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (903, [float("nan")] * 6), (904, [float("inf")] + [0.0] * 5), (905, []), (None, [1.0] * 6), (906, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in good + odd], "vec_id long, embedding array<double>, rank string")
    got: dict = {}
    for r in multiindex.nearest_neighbours(df, F.col("id") % 5 == 0, share=1.0, k=4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute(good, 20, lambda i: i % 5 == 0)


def test_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    few = multiindex.nearest_neighbours(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], schema), F.col("id") == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(few, key=lambda r: r["rank"])] == [(0, 1, 1), (0, 2, 2)]
    for rows in ([], [(1, None)], [(0, [1.0])]):
        assert multiindex.nearest_neighbours(spark.createDataFrame(rows, schema), F.lit(True)).count() == 0
