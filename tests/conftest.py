from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from millrace.session import get_spark
    s = get_spark("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def hot(spark):
    """Treat every key as hot, so that the routes for hot keys run."""
    from millrace.scale import HOT_ROWS_KEY
    spark.conf.set(HOT_ROWS_KEY, "1")
    yield
    spark.conf.unset(HOT_ROWS_KEY)


def rows(df, *order):
    """Rows as tuples, sorted."""
    cols = order or df.columns
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=repr)
