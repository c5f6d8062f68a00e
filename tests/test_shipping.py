"""Queries with Python functions where the workers do not find the package by themselves."""

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NAMES = ["anomaly_flow_lof", "anomaly_flow_forest", "anomaly_flow_svm", "circular_cells", "dbscan_six_columns", "eps_join_crowded"]

RUN = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
         .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", "steps").getOrCreate())
from __spark_entry__ import queries
for name in sys.argv[3:]:
    try:
        print("ROWS", name, queries()[name](spark, sys.argv[2]).count())
    except Exception as exc:
        print(name, exc, file=sys.stderr)
"""


@pytest.fixture(scope="module")
def alone(sf, tmp_path_factory):
    """Output of a session outside the repository that knows nothing of the package."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", RUN, REPO, sf, *NAMES], cwd=tmp_path_factory.mktemp("away"), env=env, capture_output=True, text=True, timeout=900)


@pytest.mark.parametrize("name", NAMES)
def test_workers_get_the_package(name, alone):
    assert f"ROWS {name} " in alone.stdout, alone.stderr[-2000:]
