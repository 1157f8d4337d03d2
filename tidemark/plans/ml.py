"""Learning on the wide feature table with ``pyspark.ml``.

* ``feature_pipeline``: VectorAssembler over the 36 backward-looking features
  -> ``features``; MinMaxScaler -> ``scaledFeatures``.  Fitted once at learn
  time and saved with the models, so prediction scales exactly like training.
* ``train_forest``: one random forest per binary label (unscaled features).
* ``train_kmeans``: k-means on the scaled features; ``elbow`` scans k.
* ``evaluate``: train/test split, accuracy and the opportunity metrics as one
  conditional aggregate.
* ``learn`` / ``predict``: the end-to-end jobs.

All estimators get explicit seeds (PySpark's default seed depends on the
Python hash seed).  The training set is written once to the shared
checkpoint folder (reliable, survives executor loss) before the iterative
fits re-read it.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import or_

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import MinMaxScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialize, scratch
from tidemark.sources.versions import current, publish

# The model features (all look backwards) and the labels.
FEATURES = [
    "Close/BOL-H-Close", "Close/BOL-L-Close", "D-L/XL-1", "D-M/L-1", "D-P-XS-15-1",
    "D-P-XS-30-1", "D-P-XS-5-1", "D-S/L-1", "D-S/M-1", "D-XS/L-1", "D-XS/S-1",
    "D-XS/XS-H-1", "D-XS/XS-L-1", "D-XS/XS-O-1", "L/XL", "M/BOL-H-M", "M/BOL-L-M",
    "M/L", "P-Close-1", "P-XS-1", "P-XS-1-P-XS-5", "P-XS-15", "P-XS-15-P-XS-30",
    "P-XS-30", "P-XS-5", "P-XS-5-P-XS-15", "S/L", "S/M", "XL/XXL", "XS/BOL-H-XS",
    "XS/BOL-L-XS", "XS/L", "XS/S", "XS/XS-H", "XS/XS-L", "XS/XS-O",
]
LABELS = ["gt1", "gt2", "gt3"]
NUM_TREES = 50
KMEANS_K = 15
KMEANS_SEED = 1
KMEANS_MAX_ITER = 100
KMEANS_TOL = 1e-4  # MLlib's default
FOREST_SEED = 42
RECENT_DAYS = 300
STEP_ROWS = 512  # rows that a pass of the elbow takes at a time


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def predicted_col(label: str) -> str:
    return f"prediction-{label}"


def probability_col(label: str) -> str:
    return f"probability-{label}"


def raw_col(label: str) -> str:
    return f"rawPrediction-{label}"


def training_set(data: DataFrame, label: str | None = None,
                 extra: list[str] | None = None) -> DataFrame:
    """Label (optional) + features, rows with any NULL/NaN removed."""
    cols = ([label] if label else []) + FEATURES
    keep = cols + [c for c in (extra or []) if c not in cols]
    return data.select(*[q(c) for c in keep]).na.drop(subset=cols)


def feature_stages() -> list:
    return [VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="skip"),
            MinMaxScaler(inputCol="features", outputCol="scaledFeatures")]


def feature_pipeline(train: DataFrame) -> PipelineModel:
    return Pipeline(stages=feature_stages()).fit(train.na.drop(subset=FEATURES))


def prepared(train: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, features and scaledFeatures of the training rows. The assembled vectors are
    written once, so the many passes of a fit read one column, not one a feature."""
    assembler, scaler = feature_stages()
    rows = assembler.transform(train.na.drop(subset=FEATURES)).select(*[q(c) for c in keep], "features")
    stored = materialize(rows, "vectors")
    return scaler.fit(stored).transform(stored)


def forest(label: str, seed: int = FOREST_SEED, num_trees: int = NUM_TREES) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=num_trees, seed=seed, labelCol=label,
                                  featuresCol="features",
                                  predictionCol=predicted_col(label),
                                  rawPredictionCol=raw_col(label),
                                  probabilityCol=probability_col(label))


def train_forest(prepared: DataFrame, label: str, seed: int = FOREST_SEED,
                 num_trees: int = NUM_TREES) -> RandomForestClassificationModel:
    # a fitted forest carries its training summary, and that the session, into every task that
    # scores with it; once the session has taken an Observation it cannot be serialised. A copy
    # has no summary.
    return forest(label, seed, num_trees).fit(prepared).copy()


def train_kmeans(prepared: DataFrame, k: int = KMEANS_K, seed: int = KMEANS_SEED,
                 max_iter: int = KMEANS_MAX_ITER) -> KMeansModel:
    # the row solver gives the same centers as the blocked one here (same
    # cost, same iterations) in about 60% of the time on 36 dense features
    return KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="scaledFeatures",
                  predictionCol="kmeans", solver="row").fit(prepared)


def errors_at(vectors: DataFrame, centers: dict[int, list]) -> DataFrame:
    """(k, rows, wssse): the squared distances of all rows of ``vectors`` (scaledFeatures) to
    the nearest of each k's centres, in one pass with numpy for all k."""
    def batches(frames):  # sums of one task: a row for each k
        import numpy as np
        import pandas as pd
        sums, n = dict.fromkeys(centers, 0.0), 0
        for f in frames:
            if len(f):
                every = np.stack(f["x"].to_numpy())
                n += len(every)
                for x in (every[lo:lo + STEP_ROWS] for lo in range(0, len(every), STEP_ROWS)):
                    for k, c in centers.items():
                        sums[k] += float(np.min([((x - np.asarray(one)) ** 2).sum(axis=1) for one in c], axis=0).sum())
        yield pd.DataFrame({"k": list(sums), "rows": n, "wssse": list(sums.values())})

    x = vectors.select(vector_to_array("scaledFeatures").alias("x"))
    return (x.mapInPandas(batches, "k int, rows long, wssse double")
            .groupBy("k").agg(F.sum("rows").alias("rows"), F.sum("wssse").alias("wssse")))


def lloyd_step(vectors: DataFrame, centers: dict[int, list], cost: bool = True) -> dict[int, tuple]:
    """k -> (new centres, rows, cost): one step of Lloyd's algorithm for all k in one pass over
    ``vectors`` (a column x, array<double>). The cost is that of the given centres (0 if not
    asked for: it takes about a third of a pass); a centre without rows stays. Tasks return a
    row for each centre, which Spark adds up. Rows go in blocks whose distances to all centres
    stay in a core's cache."""
    import numpy as np

    ks, width = list(centers), len(next(iter(centers.values()))[0])
    sums = [f"s{i}" for i in range(width)]
    every = np.concatenate([np.asarray(centers[k], dtype=float) for k in ks])
    starts = np.cumsum([0, *[len(centers[k]) for k in ks]])
    owner = [k for k in ks for _ in centers[k]]

    def batches(frames):
        import pyarrow as pa
        total, n, costs = np.zeros(every.shape), np.zeros(len(every), dtype=np.int64), np.zeros(len(every))
        half, minus = (every ** 2).sum(axis=1) / 2, np.ascontiguousarray(-every.T)
        room, marks, row = np.empty((STEP_ROWS, len(every))), np.zeros((STEP_ROWS, len(every))), np.arange(STEP_ROWS)
        for f in frames:
            x = f.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for lo in range(0, len(x), STEP_ROWS):
                part = x[lo:lo + STEP_ROWS]
                far, mine, at = room[:len(part)], marks[:len(part)], row[:len(part)]
                np.matmul(part, minus, out=far)
                far += half
                near = np.stack([a + far[:, a:b].argmin(axis=1) for a, b in zip(starts, starts[1:])])
                mine[at, near] = 1.0
                n += np.bincount(near.ravel(), minlength=len(every))
                if cost:
                    for one in near:
                        costs += np.bincount(one, ((part - every[one]) ** 2).sum(axis=1), len(every))
                total += mine.T @ part
                mine[at, near] = 0.0
        columns = [np.asarray(owner, dtype=np.int32), np.arange(len(every), dtype=np.int32), n, costs, *total.T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["k", "j", "n", "cost", *sums])

    found = (vectors.mapInArrow(batches, "k int, j int, n long, cost double, " + ", ".join(f"{c} double" for c in sums))
             .groupBy("k", "j").agg(*[F.sum(c).alias(c) for c in ("n", "cost", *sums)]).collect())  # a row a centre
    fresh, rows, costs = every.copy(), dict.fromkeys(ks, 0), dict.fromkeys(ks, 0.0)
    for r in found:
        rows[r["k"]] += r["n"]
        costs[r["k"]] += r["cost"]
        if r["n"]:
            fresh[r["j"]] = np.array([r[c] for c in sums]) / r["n"]
    return {k: (fresh[a:b], rows[k], costs[k]) for k, a, b in zip(ks, starts, starts[1:])}


def elbow(prepared: DataFrame, ks=range(3, 90, 3), seed: int = KMEANS_SEED,
          max_iter: int = KMEANS_MAX_ITER, parallel_fits: int = 4, details: bool = False) -> DataFrame:
    """Within-cluster sum of squared errors for each k (29 by default), at the fitted
    centres (the training cost is that of the centres before the last step). ``details``
    adds rows, training_cost and n_centers.

    MLlib chooses each k's first centres (k-means||, its own seed). The steps of all k then go
    together: a pass over the rows for each step, not for each step of each k. A k is done by
    MLlib's rule, when none of its centres moves by more than the tolerance."""
    from concurrent.futures import ThreadPoolExecutor

    import numpy as np

    with scratch():
        data = materialize(prepared.select("scaledFeatures", vector_to_array("scaledFeatures").alias("x")), "elbow")

        def first(k):
            return int(k), [[float(x) for x in c] for c in train_kmeans(data.select("scaledFeatures"), k, seed, 0).clusterCenters()]

        with ThreadPoolExecutor(max_workers=max(1, parallel_fits)) as pool:
            centers = dict(pool.map(first, ks))
        moving, before, costs = set(centers), {}, dict.fromkeys(centers, 0.0)
        for _ in range(max_iter):
            if not moving:
                break
            for k, (fresh, _, _) in lloyd_step(data.select("x"), {k: centers[k] for k in sorted(moving)}, cost=False).items():
                moved = ((fresh - np.asarray(centers[k])) ** 2).sum(axis=1).max()
                before[k], centers[k] = centers[k], fresh.tolist()
                if moved <= KMEANS_TOL ** 2:
                    moving.discard(k)
        if before:
            costs |= {k: cost for k, (_, _, cost) in lloyd_step(data.select("x"), before).items()}
        errors = {r["k"]: r for r in errors_at(data, centers).collect()}  # a row for each k
    rows = [(k, errors[k]["wssse"], errors[k]["rows"], costs[k], len(c)) for k, c in centers.items() if k in errors]
    out = prepared.sparkSession.createDataFrame(rows, "k int, wssse double, rows long, training_cost double, n_centers int")
    return out if details else out.select("k", "wssse")


def split_by_hash(rows: DataFrame, weights=(0.8, 0.2), seed: int = FOREST_SEED) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of (isin, date) and the seed: the same split
    whatever the partitioning or the cluster."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", "isin", F.col("date").cast("string"), F.lit(str(seed)))), 1, 4), 16, 10).cast("int")
    train = h < int(65536 * weights[0] / sum(weights))
    return rows.where(train), rows.where(~train)


def evaluate(data: DataFrame, label: str, seed: int = FOREST_SEED,
             weights=(0.8, 0.2), num_trees: int = NUM_TREES) -> DataFrame:
    """Test error and opportunity metrics of a forest trained on a random
    split, as a one-row DataFrame (one aggregate, not one job per count)."""
    keep = [label, "P-XS+5", "isin", "date"]
    train, test = split_by_hash(prepared(training_set(data, label, extra=keep), keep), weights, seed)
    model = train_forest(train, label, seed, num_trees)
    to, lab = q(predicted_col(label)), q(label)
    pred = materialize(model.transform(test).select(to, lab, q("P-XS+5")), "scored")  # scored once, read twice
    acc = MulticlassClassificationEvaluator(labelCol=label, predictionCol=predicted_col(label),
                                            metricName="accuracy").evaluate(pred)

    def cnt(cond: Column) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0)).cast("long")

    agg = pred.agg(
        F.count(F.lit(1)).alias("total"),
        cnt(to == 1).alias("detected"),
        cnt(lab == 1).alias("real"),
        cnt((lab == 0) & (to == 1)).alias("false_positive"),
        cnt((lab == 1) & (to == 0)).alias("false_negative"),
        cnt((lab == 1) & (to == 1)).alias("ok"),
        cnt((q("P-XS+5") < 0.005) & (to == 1)).alias("bad"))
    pct = lambda a, b: F.try_divide(F.col(a) * 100, F.col(b)).cast("long")
    return agg.select(F.lit(label).alias("label"), F.lit(1.0 - acc).alias("test_error"), "*",
                      (F.col("real") - F.col("detected")).alias("missed"),
                      pct("detected", "real").alias("detected_pct"),
                      pct("false_positive", "detected").alias("risk_pct"),
                      pct("bad", "detected").alias("bad_pct"))


def confusion(pred: DataFrame, label: str) -> DataFrame:
    return (pred.groupBy(q(predicted_col(label)), q(label)).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc(predicted_col(label)), F.asc(label)))


def learn(data: DataFrame, model_dir: str, labels=LABELS, num_trees: int = NUM_TREES, stored: bool = False) -> None:
    """Fit and save: the feature pipeline, one forest per label, k-means. The training rows are
    written once (unless ``data`` is ``stored``: then they are read from there) and not cached, and the fits run one after another: each keeps its own copy of
    all rows in the executors while it runs, so no two copies lie there at once. All models are
    one version of ``model_dir``: ``predict`` loads four that belong together, the old ones until
    the last of the new is saved."""
    with scratch(), publish(data.sparkSession, model_dir) as folder:
        pert = training_set(data, None, extra=labels)
        pert = pert if stored else materialize(pert, "training")
        pipe = feature_pipeline(pert)
        prepared = pipe.transform(pert)
        train_kmeans(prepared.select("scaledFeatures")).save(f"{folder}/kmeans")
        for label in labels:
            lab = prepared.where(q(label).isNotNull() & ~F.isnan(q(label))).select("features", q(label))
            train_forest(lab, label, num_trees=num_trees).save(f"{folder}/rfc/{label}")
        pipe.save(f"{folder}/pipeline")


def models(spark: SparkSession, model_dir: str) -> str:
    """The folder of the models that are current."""
    return current(spark, model_dir) or model_dir.rstrip("/")


def recent(data: DataFrame, as_of: dt.date | Column | None = None, days: int = RECENT_DAYS) -> DataFrame:
    as_of = F.current_date() if as_of is None else (F.lit(as_of) if isinstance(as_of, dt.date) else as_of)
    return data.where(F.col("date") > F.date_sub(as_of, days))


def predict(data: DataFrame, model_dir: str, as_of=None, labels=LABELS) -> DataFrame:
    """Score recent rows with the saved pipeline, forests and k-means. Rows short
    of a feature stay, with null predictions."""
    folder = models(data.sparkSession, model_dir)
    pipe = PipelineModel.load(f"{folder}/pipeline")
    rows = materialize(recent(data, as_of), "recent")  # read twice below
    short = reduce(or_, [q(c).isNull() | F.isnan(q(c)) for c in FEATURES])
    out = pipe.transform(rows.where(~short))
    for label in labels:
        out = RandomForestClassificationModel.load(f"{folder}/rfc/{label}").transform(out)
    out = KMeansModel.load(f"{folder}/kmeans").transform(out)
    return out.unionByName(rows.where(short), allowMissingColumns=True)


def center_distances(centers, vec: str = "scaledFeatures") -> Column:
    """Squared distances from a vector to each centre, computed apart from the model's transform."""
    every = [[float(x) for x in c] for c in centers]

    @F.arrow_udf("array<double>")
    def distances(v):
        import numpy as np
        import pyarrow as pa
        x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
        d = np.stack([((x - np.asarray(c)) ** 2).sum(axis=1) for c in every], axis=1) if len(v) else np.zeros((0, len(every)))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * len(every)), pa.array(d.ravel()))

    return distances(vector_to_array(F.col(vec)))
