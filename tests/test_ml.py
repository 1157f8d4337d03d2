"""Precision reducer, feature pipeline, forests, k-means, reports, entry."""
import os

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import Observation
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.precision import PrecisionReducer, PrecisionReducerModel
from tidemark.plans import indicators as IND
from tidemark.plans import ml as ML
from tidemark.plans import reports as REP


def test_precision_half_up(spark, tmp_path):
    df = spark.createDataFrame([(Vectors.dense([-0.025, 0.025, 0.014, -1.0]),)], ["v"])
    m = PrecisionReducer(inputCol="v", outputCol="r").fit(df)
    out = m.transform(df).first()["r"].toArray()
    assert list(out) == pytest.approx([-0.02, 0.03, 0.01, -1.0])
    m.write().overwrite().save(str(tmp_path / "m"))
    assert PrecisionReducerModel.load(str(tmp_path / "m")).getPrecision() == 0.01
    with pytest.raises(ValueError):
        PrecisionReducer(inputCol="v", outputCol="v").fit(df)
    with pytest.raises(TypeError):
        PrecisionReducer(inputCol="x", outputCol="r").fit(df.withColumn("x", F.lit(1.0)))


def test_learn_predict_report(spark, bars001, tmp_path):
    data = IND.build_wide(bars001)
    model_dir = str(tmp_path / "models")
    ML.learn(data, model_dir, num_trees=5)
    last = data.agg(F.max("date")).first()[0]
    pred = ML.predict(data, model_dir, as_of=last)
    cols = set(pred.columns)
    assert {"prediction-gt1", "probability-gt3", "kmeans", "scaledFeatures"} <= cols
    # rows short of a feature stay, unscored
    recent = ML.recent(data, last)
    assert pred.count() == recent.count() >= pred.where("kmeans is not null").count() > 0
    short = bars001.where("isin = '1'").orderBy("date").limit(20)
    few = ML.predict(IND.build_wide(short), model_dir, as_of=short.agg(F.max("date")).first()[0])
    assert few.count() == ML.recent(IND.build_wide(short), short.agg(F.max("date")).first()[0]).count() > 0
    assert few.where("kmeans is not null").count() == 0
    stock = spark.createDataFrame([(str(i), f"S{i}", f"N{i}") for i in range(10)], "ISIN string, Symbol string, Name string")
    top = REP.opportunities(pred, stock, 6).collect()
    assert len(top) == 6 and top[0]["symbol"] is not None
    assert REP.cluster_listing(pred, stock, 0).count() >= 0
    ev = ML.evaluate(data, "gt1", num_trees=5).first()
    assert ev["total"] > 0 and 0 <= ev["test_error"] <= 1


def _two_classes(spark):
    rows = [("1", 0.0, Vectors.dense([float(i % 7), 1.0])) if i % 7 < 3 else ("1", 1.0, Vectors.dense([float(i % 7), 2.0])) for i in range(60)]
    df = spark.createDataFrame(rows, ["isin", "gt1", "features"])
    seen = Observation()
    df.observe(seen, F.count("*").alias("n")).collect()
    assert seen.get["n"] == 60  # the session now holds what cannot be sent to a task
    return df


def test_forest_scores_after_an_observation(spark):
    df = _two_classes(spark)
    pred = ML.train_forest(df, "gt1", num_trees=3).transform(df)
    assert pred.where(ML.q("prediction-gt1") == ML.q("gt1")).count() == 60


def test_confusion_after_an_observation(spark):
    df = _two_classes(spark)
    cells = ML.confusion(ML.train_forest(df, "gt1", num_trees=3).transform(df), "gt1").collect()
    assert {(r["gt1"], r["count"]) for r in cells} == {(0.0, 27), (1.0, 33)}


def test_elbow_small(spark, bars001):
    ts = ML.training_set(IND.build_wide(bars001))
    prep = ML.feature_pipeline(ts).transform(ts)
    e = ML.elbow(prep, ks=[3, 6], max_iter=5).collect()
    assert [r["k"] for r in e] == [3, 6] and e[1]["wssse"] <= e[0]["wssse"] * 1.5


def test_elbow_steps_are_mllibs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(c, 0.3, (200, 3)) for c in (0.0, 1.0, 2.5, 4.0)])
    prep = spark.createDataFrame([(Vectors.dense(p.tolist()),) for p in points], ["scaledFeatures"]).coalesce(1)
    fits, plain = [], ML.train_kmeans
    monkeypatch.setattr(ML, "train_kmeans", lambda data, k, seed, max_iter: fits.append(max_iter) or plain(data, k, seed, max_iter))
    got = {r["k"]: r for r in ML.elbow(prep, ks=[3, 4, 6], max_iter=30, details=True).collect()}
    assert fits == [0, 0, 0]  # MLlib takes no step of its own: one pass a step serves all k
    for k in (3, 4, 6):
        model = plain(prep, k, ML.KMEANS_SEED, 30)
        nearest = ((points[:, None, :] - np.array(model.clusterCenters())[None]) ** 2).sum(axis=2).min(axis=1).sum()
        assert got[k]["wssse"] == pytest.approx(nearest, rel=1e-9)
        assert got[k]["training_cost"] == pytest.approx(model.summary.trainingCost, rel=1e-9) and got[k]["rows"] == 800


def test_learning_keeps_no_rows_in_the_cache(spark, bars001, tmp_path, monkeypatch):
    monkeypatch.setattr(DataFrame, "persist", lambda *a, **k: pytest.fail("the training rows are cached"))
    ML.learn(IND.build_wide(bars001), str(tmp_path / "m"), num_trees=2)


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 20
    assert set(E.oracle_sql()) <= set(E.queries())


def test_hash_split_ignores_partitioning(spark, bars001):
    a, b = ML.split_by_hash(bars001)
    c, _ = ML.split_by_hash(bars001.repartition(7))
    assert a.count() == c.count() and a.count() + b.count() == bars001.count()
    assert a.exceptAll(c).isEmpty() and 0.75 < a.count() / bars001.count() < 0.85


def test_names_belong_together(spark):
    stock = spark.createDataFrame([("I", "B", "first"), ("I", "A", "second")], "ISIN string, Symbol string, Name string")
    assert [tuple(r)[1:] for r in REP.names(stock).collect()] == [("A", "second")]


def test_prepared_rows_are_the_pipelines(spark, bars001):
    ts = ML.training_set(IND.build_wide(bars001, columns=["gt1", *ML.FEATURES]), "gt1", extra=["isin", "date"])
    got = ML.prepared(ts, ["gt1", "isin", "date"])
    want = ML.feature_pipeline(ts).transform(ts).select(*got.columns)
    assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ML.FEATURES[0] not in plan and "vectors-" in got.inputFiles()[0]  # a fit reads the written vectors


def test_evaluate_scores_the_test_rows_once(spark, bars001, monkeypatch):
    written, plain = [], ML.materialize
    monkeypatch.setattr(ML, "materialize", lambda df, name: written.append((name, df.columns)) or plain(df, name))
    data = IND.build_wide(bars001, columns=["gt1", "P-XS+5", *ML.FEATURES])
    e = ML.evaluate(data, "gt1", num_trees=2).first()
    assert [n for n, _ in written] == ["vectors", "scored"] and written[1][1] == ["prediction-gt1", "gt1", "P-XS+5"]
    assert e["test_error"] * e["total"] == pytest.approx(e["false_positive"] + e["false_negative"])


def test_center_distances_by_blocks(spark):
    points, centers = np.arange(12.0).reshape(4, 3), [[0.0, 1.0, 2.0], [9.0, 9.0, 9.0]]
    df = spark.createDataFrame([(i, Vectors.dense(p.tolist())) for i, p in enumerate(points)], ["i", "scaledFeatures"])
    out = df.select("i", ML.center_distances(centers).alias("d"))
    assert "ArrowEvalPython" in out._jdf.queryExecution().executedPlan().toString()  # not a lambda for each number
    for r in out.collect():
        assert r["d"] == pytest.approx([((points[r["i"]] - c) ** 2).sum() for c in np.array(centers)])
    assert df.limit(0).select(ML.center_distances(centers)).collect() == []


def test_elbow_takes_the_cost_once_at_the_end(spark, monkeypatch):
    rows = [(Vectors.dense([float(i % 5), float(i % 7), float(i)]),) for i in range(60)]
    data, asked, step = spark.createDataFrame(rows, ["scaledFeatures"]), [], ML.lloyd_step

    def counted(vectors, centers, cost=True):
        asked.append(cost)
        return step(vectors, centers, cost)

    monkeypatch.setattr(ML, "lloyd_step", counted)
    monkeypatch.setattr(ML, "STEP_ROWS", 7)
    for r in ML.elbow(data, [2, 5], details=True).collect():
        assert r["rows"] == 60 and r["wssse"] <= r["training_cost"] * (1 + 1e-9) and r["training_cost"] > 0
    assert asked[-1] and not any(asked[:-1]) and len(asked) > 2


def test_models_and_scores_read_one_stored_pass(spark, monkeypatch):
    import __spark_entry__ as E

    class Stop(Exception):
        pass

    def learn(data, model_dir, stored=False):
        assert stored and "MapInArrow" not in data._jdf.queryExecution().executedPlan().toString()
        raise Stop

    monkeypatch.setattr(ML, "learn", learn)
    monkeypatch.setattr(E, "_models", {})
    with pytest.raises(Stop):
        E._predicted(spark, "/root/testdata/sf0.001")
