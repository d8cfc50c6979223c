"""Python workers find the package even if the session was started elsewhere, without it on their path."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from siltstone.operators.skew import key_totals
from siltstone.sources.ingest import flatten_json
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
df = spark.createDataFrame([("F", "a", 1, 2, ["x"])], "f string, v string, i long, w long, items array<string>")
print("ROWS", [tuple(r) for r in key_totals(df, ("f", "v"), "i", "w", "items").collect()])
print("FLAT", flatten_json(spark.createDataFrame([('{{"a": 1}}',)], "j string"), "j").first()["fields"][0]["value"])
"""


def test_package_is_shipped(tmp_path):
    repo = str(Path(__file__).resolve().parent.parent)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS [('F', 'a', 1, 1, 2, 1)]" in run.stdout and "FLAT 1" in run.stdout, run.stderr[-2000:]
