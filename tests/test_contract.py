"""The contract as another program would use it: from elsewhere, in a plain session."""

import os
import subprocess
import sys

from compare import DATA
from conftest import ROOT

SCRIPT = f"""
import importlib.util
from pyspark.sql import SparkSession

spec = importlib.util.spec_from_file_location("contract", {os.path.join(ROOT, "__spark_entry__.py")!r})
contract = importlib.util.module_from_spec(spec)
spec.loader.exec_module(contract)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
scored = contract.queries()["d10_score_changes"](spark, {DATA + "/sf0.001"!r})
print("rows", scored.count(), contract.entry(spark).count())
assert set(contract.oracle_sql()) <= set(contract.queries())
"""


def test_contract_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT")}
    run = subprocess.run(
        [sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True,
        timeout=300,
    )
    assert "rows 1000 5" in run.stdout, run.stderr[-2000:]
