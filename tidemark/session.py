"""Spark session helpers.

The engine never creates machine-local scratch space on a cluster: the
checkpoint folder is taken from ``spark.checkpoint.dir``, and only a local
(single-machine) master may fall back to a private folder.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Settings of this engine; a submitted configuration always wins over them.
DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def submitted_conf() -> dict[str, str]:
    """Settings given from outside: by spark-submit (whose JVM this process was
    started from) or in PYSPARK_SUBMIT_ARGS; empty for a plain ``python`` run."""
    args = os.environ.get("PYSPARK_SUBMIT_ARGS", "")
    if "PYSPARK_GATEWAY_PORT" not in os.environ and "--master" not in args and "spark.master" not in args:
        return {}
    from pyspark import SparkConf, SparkContext
    SparkContext._ensure_initialized()
    return dict(SparkConf().getAll())


def get_session(master: str | None = None, cpus: int | None = None,
                app: str = "tidemark", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session configured for this engine.

    An active session is returned as it is. Under spark-submit the master,
    memory and shuffle partitions are the submitted ones; only settings absent
    there are filled in. A plain ``python`` run gets ``local[cpus]``.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        checkpoint_dir(active)
        return active
    given = submitted_conf()
    conf = dict(DEFAULTS)
    if not given:
        cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
        conf |= {"spark.master": master or f"local[{cpus}]", "spark.driver.memory": "16g",
                 "spark.sql.shuffle.partitions": str(max(8, cpus * 2))}
    elif master:
        conf["spark.master"] = master
    conf |= extra or {}
    b = SparkSession.builder
    if "spark.app.name" not in given:
        b = b.appName(app)
    for k, v in conf.items():
        if k not in given:
            b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder. Without one a local master gets a private
    folder; any other master must name it in ``spark.checkpoint.dir``, because
    executors could not read what the driver's machine keeps to itself."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share: "
                               f"master {spark.sparkContext.master} has no machine-local scratch")
        d = tempfile.mkdtemp(prefix="tidemark-ckpt-")
        with contextlib.suppress(Exception):  # core confs may be read-only at runtime
            spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


_written: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release_tables(since: int = 0) -> None:
    """Delete the tables that ``materialize`` has written (from the given one on)."""
    while len(_written) > since:
        _delete(*_written.pop())


atexit.register(release_tables)


@contextlib.contextmanager
def scratch():
    """Tables materialised inside are deleted at the end of the block; write the
    block's result before it ends."""
    mark = len(_written)
    try:
        yield
    finally:
        release_tables(mark)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession):
    """Writes inside the block delete their shuffle files as they end, not when the driver
    happens to collect them: nothing reads the shuffles of a write again."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as parquet (zstd) under the shared checkpoint folder and read it
    back: cuts the lineage and gives a columnar, prunable re-scan. The table
    lives until ``scratch`` or the process ends."""
    spark = df.sparkSession
    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{name}-{uuid.uuid4().hex}"
    with shuffles_deleted(spark):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.parquet(path)


@contextlib.contextmanager
def persisted(*frames: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
    """Frames read by several actions, cached inside the block only."""
    for df in frames:
        df.persist(level)
    try:
        yield frames[0] if len(frames) == 1 else frames
    finally:
        for df in frames:
            df.unpersist()
