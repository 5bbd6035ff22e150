"""A slice of the registered queries against their DuckDB oracle (sf0.001)."""

import duckdb
import pytest

import __spark_entry__ as E
from leafwise.sources.tables import TABLES
from tests.conftest import SF
from tools.check_oracle import rows_of

SAMPLE = ["checkpoint_report", "model_report", "roc_auc", "knn_leave_one_out", "neighbor_lists", "ema",
          "extract_tags", "pattern_catalog_match", "masked_mean_pool", "forest_leaves", "union_by_name"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    rel = con.sql(E.oracle_sql()[name])
    s_rows, d_rows = [tuple(r) for r in sdf.collect()], rel.fetchall()
    assert sorted(sdf.columns) == sorted(rel.columns)
    assert rows_of(sdf.columns, s_rows) == rows_of(rel.columns, d_rows)
