from __future__ import annotations

from datetime import date, datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tapeline import catalog, session
from tapeline.operators import views
from tapeline.sources import market_tables as market


def test_long_keys_stay_apart(spark, tmp_path):
    """Keys beyond six digits and 2^20; ticks of one order and line follow the part key."""
    day, big = date(1999, 1, 4), 1 << 21
    rows = [
        (7, 1, 1_234_567, big + 5, 10.0, 1.0, 0.0, day), (7, 1, 1_234_567, 3, 20.0, 1.0, 0.0, day),
        (7, 9, 123_456, 1, 30.0, 1.0, 0.0, day), (8, 1, 123_456, 1, 40.0, 1.0, 0.0, day),
    ]
    columns = "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_extendedprice double, l_quantity double, l_discount double, l_shipdate date"
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    bars = {r.ticker_code.split(".")[0]: r for r in market.trade_bars(spark, str(tmp_path)).collect()}
    assert set(bars) == {"1234567.KQ".split(".")[0], "123456"}
    assert (bars["1234567"].open, bars["1234567"].close) == (20.0, 10.0)
    assert (bars["123456"].open, bars["123456"].close) == (30.0, 40.0)
    at = datetime(2020, 1, 1, 12)
    events = [(2, 1_234_567, at, 5.0), (1, 1_234_567, at, 4.0), (3, 123_456, at, 1.0)]
    spark.createDataFrame(events, "event_id long, user_id long, ts timestamp, value double").write.parquet(f"{tmp_path}/events.parquet")
    ticks = market.event_ticks(spark, str(tmp_path))
    assert sorted(r.ticker_code for r in ticks.select("ticker_code").distinct().collect()) == ["U123456", "U1234567"]
    assert [r.price for r in ticks.where("ticker_code = 'U1234567'").orderBy("seq").collect()] == [4.0, 5.0]


def test_failed_tickers_reads_each_ticker_once(spark):
    """The facts are reduced to tickers before they meet the request."""
    asked = spark.createDataFrame([("A",), ("B",)], "ticker_code string")
    ticks = spark.range(50_000).select(F.lit("A").alias("ticker_code"))
    missing = views.without_data(asked, ticks)
    assert [r.ticker_code for r in missing.collect()] == ["B"]
    assert "HashAggregate" in missing._jdf.queryExecution().executedPlan().toString()


def test_order_keys_sort_like_their_parts(spark):
    """Packed into a long where the widths allow it, into a decimal where they do not, whatever the sign."""
    big = 1 << 40
    for rows in ([(3, 1, 9), (-5, 7, 2), (3, 1, 8), (3, 0, 10)], [(big, 3, big), (big, 3, -big), (-big, 9, 0), (big, 2, 5)]):
        df = spark.createDataFrame(rows, "a long, b int, c long")
        key = market.order_key(df, {c: F.col(c) for c in "abc"})
        got = [tuple(r)[:3] for r in df.withColumn("key", key).orderBy("key").collect()]
        assert got == sorted(rows)
        kind = dict(df.select(key.alias("key")).dtypes)["key"]
        assert kind == ("bigint" if max(rows)[0] < big else "decimal(38,0)")
    none = spark.createDataFrame([], "a long, b int, c long")
    assert none.select(market.order_key(none, {c: F.col(c) for c in "abc"}).alias("k")).count() == 0


@pytest.fixture
def ticks(tmp_path):
    """Three suppliers with a line item on each of 320 days."""
    days = [(date(1998, 1, 1) + timedelta(days=i), s) for s in (1, 2, 3) for i in range(320)]
    n = len(days)
    table = pa.table({
        "l_orderkey": pa.array(range(n), pa.int64()), "l_linenumber": pa.array([1] * n, pa.int32()), "l_partkey": pa.array([1] * n, pa.int64()),
        "l_suppkey": pa.array([s for _, s in days], pa.int64()), "l_shipdate": pa.array([d for d, _ in days], pa.date32()),
        "l_extendedprice": [100.0 + (i * i * 7919) % 31 for i in range(n)], "l_quantity": [1.0] * n, "l_discount": [0.0] * n,
    })
    pq.write_table(table, str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def test_series_tasks_keep_their_size(spark, ticks, monkeypatch):
    """The indicator windows run in tasks of a number of rows, however many rows there are."""
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    table = catalog._indicators(spark, ticks, ["ma_5"])
    assert table.rdd.getNumPartitions() == 20
    assert market.series_bars(spark, ticks).exceptAll(market.daily_bars(spark, ticks)).isEmpty() and table.count() == 960


def test_passes_of_a_fit_read_labelled_rows(spark, ticks, monkeypatch):
    """Labels are made in the layout of the indicators and written with them, not found anew in each pass."""
    monkeypatch.setattr(catalog.learn, "fit_model", lambda rows, features, candidate: None)
    names = catalog.training.FEATURES
    table, rows, _ = catalog._plain_model(spark, ticks)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan
    full = catalog._training_table(spark, ticks)
    want = catalog.labels.training_rows(catalog.labels.forward_label(full), names).select(rows.columns)
    assert rows.exceptAll(want).isEmpty() and rows.count() == want.count() and table.count() == full.dropna(subset=names).count()
