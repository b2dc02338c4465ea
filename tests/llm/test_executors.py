"""Workers that cannot import the library: every query and the pipeline run from another folder, with a worker path without the repo."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]

SCRIPT = """
import sys
from pyspark.sql import SparkSession

spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")


def importable(batches):
    import importlib.util

    for b in batches:
        b["id"] = int(importlib.util.find_spec("corpusloom") is not None)
        yield b


assert spark.range(4).mapInPandas(importable, "id bigint").agg({"id": "sum"}).first()[0] == 0, "workers see the package"
sys.path.insert(0, ROOT)
import __spark_entry__

folder = "/root/testdata/sf0.001"
for name, query in __spark_entry__.queries().items():
    if name.startswith("op") or name == "pipeline":
        print(name, query(spark, folder).count(), flush=True)
""".replace("ROOT", repr(str(ROOT)))


def test_queries_run_where_workers_lack_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    counts = dict(line.rsplit(" ", 1) for line in done.stdout.splitlines() if line.startswith(("op", "pipeline")))
    assert len(counts) == 12 and all(int(n) > 0 for n in counts.values())
