"""The package works from another folder, in workers that cannot import it by themselves."""

import os
import subprocess
import sys

from tests.conftest import ROOT, SF

PROGRAM = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("entry", {str(ROOT / "__spark_entry__.py")!r})
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
for name in ("dense_topk", "bm25_topk"):
    print(name, entry.queries()[name](spark, {SF!r}).count() > 0)
"""


def test_queries_run_without_a_python_path(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", PROGRAM], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "dense_topk True" in done.stdout and "bm25_topk True" in done.stdout, done.stderr[-2000:]
