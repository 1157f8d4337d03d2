"""CSV exports of the feature table, prediction slice and watchlist (S13).

``single_file=True`` coalesces to one part file (small exports meant for a
spreadsheet); the default keeps the write parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.ml import LABELS, predicted_col


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> str:
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)
    return path


def prediction_slice(prediction: DataFrame) -> DataFrame:
    return prediction.select("isin", "date", "kmeans", *[F.col(f"`{predicted_col(l)}`") for l in LABELS])


def export(store, directory: str, single_file: bool = False) -> dict[str, str]:
    d = directory.rstrip("/")
    out = {"data": write_csv(store.table("data"), f"{d}/data", single_file)}
    if store.exists("prediction"):
        out["prediction"] = write_csv(prediction_slice(store.table("prediction")),
                                      f"{d}/prediction", single_file)
    if store.exists("watchlist"):
        out["watchlist"] = write_csv(store.table("watchlist"), f"{d}/watchlist", single_file)
    return out
