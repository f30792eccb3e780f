"""A local session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    folder = tmp_path_factory.mktemp("spark")
    found = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(folder / "warehouse"))
        .config("spark.checkpoint.dir", str(folder / "shared"))
        .getOrCreate()
    )
    found.sparkContext.setLogLevel("OFF")
    found.sparkContext.environment["PYTHONPATH"] = str(ROOT)
    yield found
    found.stop()


@pytest.fixture(scope="session")
def duck():
    """DuckDB views of the tables at sf0.001."""
    import duckdb

    found = duckdb.connect()
    for path in sorted(Path(DATA, "sf0.001").glob("*.parquet")):
        found.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return found
