"""The registered queries against their SQL twins, and under a hot ticker."""

from __future__ import annotations

import os
import shutil

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as registry
from tapeline import catalog, catalog_sql
from check import connect, differences

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="given tables not present")
SQL = registry.oracle_sql()
# Iterative fits have no SQL twin.
ROWS_ONLY = {"train_report", "model_scores", "model_signals", "model_metrics"}
# A spread over the operators; ``check.py`` runs all of them.
SAMPLE = [
    "bars_daily", "bars_monthly", "event_bars", "market_inference", "universe", "upsert_prices",
    "upsert_partial_indicators", "gap_fill", "missing_sessions", "null_profile", "all_indicators",
    "all_indicators_blocked", "forward_label", "ts_folds", "rule_report", "trade_log",
    "strategy_equity", "strategy_vs_benchmark", "full_refresh",
]


def test_every_query_has_its_twin():
    assert set(catalog.all_queries()) - set(SQL) == ROWS_ONLY and set(SQL) <= set(catalog.all_queries())


@pytest.fixture(scope="module")
def small():
    con = connect(SMALL)
    yield con
    con.close()


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, small, name):
    got = registry.queries()[name](spark, SMALL).toPandas()
    assert differences(got, small.execute(SQL[name]).df()) is None


@needs_data
def test_entry(spark):
    df = registry.entry(spark)
    assert df.columns[:2] == ["ticker_code", "date"] and df.limit(1).count() == 1


@pytest.fixture(scope="module")
def hot(tmp_path_factory):
    """The small tables with a third of all trades moved to one supplier."""
    folder = str(tmp_path_factory.mktemp("hot"))
    for file in os.listdir(SMALL):
        shutil.copyfile(f"{SMALL}/{file}", f"{folder}/{file}")
    items = pq.read_table(f"{SMALL}/lineitem.parquet")
    moved = pc.equal(pc.bit_wise_and(pc.cast(items["l_partkey"], pa.int64()), 3), 0)
    keys = pc.if_else(moved, pa.scalar(1, pa.int64()), items["l_suppkey"])
    at = items.schema.get_field_index("l_suppkey")
    pq.write_table(items.set_column(at, "l_suppkey", keys), f"{folder}/lineitem.parquet")
    return folder


@needs_data
@pytest.mark.parametrize("name", ["bars_daily", "gap_fill", "all_indicators_blocked", "chrono_split", "series_check", "trade_log", "strategy_equity"])
def test_hot_ticker(spark, hot, name):
    con: duckdb.DuckDBPyConnection = connect(hot)
    share = con.execute("SELECT max(n) / sum(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey)").fetchone()[0]
    assert share > 0.3
    got = registry.queries()[name](spark, hot).toPandas()
    assert differences(got, con.execute(SQL[name]).df()) is None
