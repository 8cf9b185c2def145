"""One small session for all tests, and the SQL side to compare with."""

from __future__ import annotations

import os
from pathlib import Path

import pandas as pd
import pytest

DATA = Path(os.environ.get("INKFOLD_TESTDATA", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark():
    from inkfold.session import build_session

    session = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(value):
    """A value in one form for both engines."""
    if value is None or value is pd.NA or value != value:
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return round(float(value), 6)
    return str(value)


def rows_of(frame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted((tuple(plain(v) for v in row) for row in frame[columns].itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def sql():
    """SQL over the test tables, as a frame."""
    duckdb = pytest.importorskip("duckdb")
    if not DATA.exists():
        pytest.skip("no test tables here")
    connection = duckdb.connect()
    for path in DATA.iterdir():
        source = path / "*.parquet" if path.is_dir() else path
        connection.execute(f"CREATE VIEW {path.name.split('.')[0]} AS SELECT * FROM '{source}'")
    return lambda text: connection.execute(text).df()
