"""Every registered query against its SQL, and the shape of its plan."""

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    status, n, info = compare(spark, con, queries()[name], oracle_sql().get(name), SF)
    assert status in ("ok", "rows-only"), info


@pytest.mark.parametrize("name", ["exact_topk_inner_product", "mix_datasets", "unified_runs", "project_checks", "loss_aot_pair", "gae"])
def test_no_pairwise_joins(spark, name):
    plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_entry(spark):
    assert entry(spark).columns == ["project_id", "dataset_id", "doc_id", "text"]


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
