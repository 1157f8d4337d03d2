"""Every query in a process whose Python workers cannot import this package."""
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
         .config("spark.checkpoint.dir", {tmp!r} + "/ckpt").getOrCreate())


def importable(_):
    import importlib.util
    return importlib.util.find_spec("tidemark") is not None


assert not any(spark.sparkContext.parallelize(range(2), 2).map(importable).collect())
from tidemark.llm import queries
for name, query in queries.queries().items():
    print(name, query(spark, {sf!r}).count(), flush=True)
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(root=ROOT, tmp=str(tmp_path), sf="/root/testdata/sf0.001"))
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET", "PYSPARK_PIN_THREAD")}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert len(done.stdout.split("\n")) == 13 + 1
