"""Submitted settings win, scratch tables go, workers need no copy of the package."""
import os
import re
import subprocess
import sys
import time

import pytest

from tidemark import session

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(code, args=None, cwd="/"):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET", "PYSPARK_SUBMIT_ARGS", "BENCH_CPUS")}
    if args:
        env["PYSPARK_SUBMIT_ARGS"] = args + " pyspark-shell"
    out = subprocess.run([sys.executable, "-c", f"import sys; sys.path.insert(0, {ROOT!r})\n{code}"], cwd=cwd, env=env,
                         capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    return out.stdout.split()


SHOW = """
from tidemark.session import get_session
s = get_session()
print(s.sparkContext.master, s.conf.get('spark.sql.shuffle.partitions'))
"""


def test_submitted_master_and_partitions_are_kept():
    got = run(SHOW, "--master local[3] --driver-memory 1g --conf spark.sql.shuffle.partitions=4000 --conf spark.ui.enabled=false")
    assert got == ["local[3]", "4000"]


def test_plain_python_runs_locally():
    assert run(SHOW) == ["local[8]", "16"]


def test_ema_from_another_folder():
    code = """
from tidemark.session import get_session
from tidemark.operators import series
s = get_session(cpus=2, extra={'spark.driver.memory': '1g'})
d = s.createDataFrame([('b', 1, 10.0), ('b', 2, 20.0)], 'ISIN string, id int, val double')
print(sorted(r.e for r in series.ema(d, 'val', 'e', 0.2, order='id').collect())[1])
"""
    assert run(code) == ["12.0"]


class _Session:
    """As much of a session on a cluster as checkpoint_dir looks at."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)


def test_no_machine_local_scratch_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(_Session)


def test_scratch_deletes_its_tables(spark):
    before = list(session._written)
    with session.scratch():
        df = session.materialize(spark.range(5), "gone")
        path = session._written[-1][1]
        assert df.count() == 5 and os.path.isdir(path.removeprefix("file:"))
    assert not os.path.exists(path.removeprefix("file:")) and session._written == before


def test_written_tables_are_zstd(spark):
    from tidemark.session import materialize
    files = materialize(spark.range(10), "codec").inputFiles()
    assert files and all(f.endswith(".zstd.parquet") for f in files)


def test_materialize_leaves_no_shuffle_files(spark):
    from pyspark.sql import functions as F

    from tidemark.session import CLEANUP, materialize

    def shuffles():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().toString()
        return set(re.findall(r"shuffle_\d+_\d+", blocks))

    before, kept = shuffles(), spark.conf.get(CLEANUP, "false")
    out = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s")), "grouped")
    for _ in range(50):  # deleted in the background
        left = shuffles() - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and out.count() == 7 and spark.conf.get(CLEANUP, "false") == kept
