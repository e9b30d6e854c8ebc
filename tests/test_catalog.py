"""A cross-section of the catalogue against SQL; ``tools/check.py`` runs all of it."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import TABLES, rows  # noqa: E402

NAMES = [
    "asset_performance", "asof_macro_join", "time_series_folds", "cross_sectional_rank_pct", "correlation", "enhanced_features", "risk_decomposition", "regime_path_features",
    "fuse_entropy", "generate_signals", "size_risk_parity", "walk_forward_ledger", "bootstrap_ci", "scenario_risk", "long_series_features",
]


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(NAMES) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = entry.queries()[name](spark, sf).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
