"""A session for all tests; workers find the repository by PYTHONPATH."""

import os
import sys
import tempfile
from pathlib import Path

import pytest

REPO = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, REPO)
os.environ["PYTHONPATH"] = REPO + os.pathsep + os.environ.get("PYTHONPATH", "")
os.environ.setdefault("TZ", "UTC")
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    home = tempfile.mkdtemp(prefix="spark-")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", f"{home}/warehouse")
        .config("spark.local.dir", f"{home}/local")
        .config("spark.checkpoint.dir", f"file://{home}/shared")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


def same_rows(got, expected, columns=None):
    """Both DataFrames or lists of dicts hold the same rows, whatever their order."""
    lists = [[r.asDict(recursive=True) for r in x.collect()] if hasattr(x, "collect") else list(x) for x in (got, expected)]
    columns = sorted(columns or lists[0][0].keys()) if lists[0] or columns else []
    a, b = (sorted(repr([r[c] for c in columns]) for r in rows) for rows in lists)
    assert a == b
