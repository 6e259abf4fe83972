"""Market rules, periods, names and date arguments."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from tapeline.functions.indicators import check_names, lookback_rows
from tapeline.functions.markets import exchange_code, infer_market
from tapeline.functions.numeric import nan_to_null, to_double
from tapeline.functions.periods import check_range, extended_start, period_range, resolve_range
from tapeline.sources.bars import normalize_columns, rollup_bars, scan_bars

MARKETS = {
    "005930.KS": "KOSPI", "035720.kq": "KOSDAQ", "BTC-USD": "CRYPTO", "eth-usd": "CRYPTO",
    "7203.T": "TOKYO", "0700.HK": "HONGKONG", "AAPL": "US", "brk.b": "UNKNOWN", "X.UW": "UNKNOWN",
}
EXCHANGES = {
    "005930.KS": "XKRX", "035720.kq": "XKRX", "7203.T": "XTKS", "0700.HK": "XHKG",
    "AAPL": "XNYS", "BTC-USD": "XNYS", "02943.UW": None,
}


def test_market_and_exchange(spark):
    df = spark.createDataFrame([(c,) for c in {*MARKETS, *EXCHANGES}], "code string")
    rows = df.select("code", infer_market(F.col("code")).alias("m"), exchange_code(F.col("code")).alias("e")).collect()
    for r in rows:
        assert r["m"] == MARKETS.get(r["code"], r["m"])
        if r["code"] in EXCHANGES:
            assert r["e"] == EXCHANGES[r["code"]]


@pytest.mark.parametrize("period, start", [
    ("1y", date(2023, 2, 28)), ("6mo", date(2023, 8, 29)), ("1mo", date(2024, 1, 29)),
    ("50d", date(2024, 1, 10)), ("1d", date(2024, 2, 28)), ("0y", date(2024, 2, 29)),
    ("ytd", date(2024, 1, 1)), ("max", date(1970, 1, 1)),
])
def test_periods(period, start):
    assert period_range(period, date(2024, 2, 29)) == (start, date(2024, 2, 29))


@pytest.mark.parametrize("period", ["invalid", "1.5y", "-1y", "1w", "1month", "", "y1", "1Y"])
def test_bad_periods(period):
    with pytest.raises(ValueError):
        period_range(period, date(2024, 2, 29))


@pytest.mark.parametrize("args", [
    ("2023-02-03", "2024-01-01", "1y"), (None, "2024-01-01", "1y"), ("2023-02-03", None, "1y"),
    (None, "2024-01-01", None), ("2023-02-03", None, None),
    ("2023.02.03", "2024.01.01", None), ("2023/01/01", "2024/12/01", None),
    ("2025-02-03", "2024-01-01", None), ("2022-02-02", "2022-02-02", None),
])
def test_bad_ranges(args):
    with pytest.raises(ValueError):
        check_range(*args)


def test_period_is_resolved_once():
    assert resolve_range(None, None, "1d", date(2024, 2, 29)) == (date(2024, 2, 28), date(2024, 2, 29))
    assert resolve_range("2024-01-01", "2024-02-01", None) == (date(2024, 1, 1), date(2024, 2, 1))


@pytest.mark.parametrize("names, rows", [
    (["ma_5"], 5), (["ma_200"], 200), (["bb_lower"], 20), (["ma_5", "hv", "macd_hist"], 34),
    (["rsi"], 15), (["stoch_k"], 16), (["stoch_d"], 18), (["obv"], 1), (["unknown"], 0), (None, 200), ([], 0),
])
def test_lookback_and_extension(names, rows):
    assert lookback_rows(names) == rows
    assert (date(2020, 1, 1) - extended_start(date(2020, 1, 1), rows)).days == int(rows * 1.6) + 10


def test_names():
    check_names(["ma_5", "rsi"])
    check_names([])
    with pytest.raises(ValueError):
        check_names(["ma_5", "nope"])


def test_column_names_and_numbers(spark):
    df = spark.createDataFrame([("1.5", "x", float("nan"))], "` Adj Close` string, Open string, V double")
    df = nan_to_null(to_double(normalize_columns(df), ["adj_close", "open"]))
    assert df.first().asDict() == {"adj_close": 1.5, "open": None, "v": None}


def test_scan_is_half_open_and_pushed_down(spark, rising, tmp_path):
    path = str(tmp_path / "bars")
    rising.write.parquet(path)
    stored = spark.read.parquet(path)
    picked = scan_bars(stored, ["005930.KS", "NOPE"], "2020-01-02", "2020-01-05")
    assert [str(r["date"]) for r in picked.orderBy("date").collect()] == ["2020-01-02", "2020-01-03", "2020-01-04"]
    plan = picked._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters")[1]
    assert all(f in pushed for f in ("GreaterThanOrEqual(date", "LessThan(date", "In(ticker_code"))
    with pytest.raises(ValueError):
        scan_bars(stored, ["A"], "2020-01-05", "2020-01-05")


def test_rollup(rising):
    months = {str(r["date"]): r for r in rollup_bars(rising, "1mo").collect()}
    feb = months["2020-02-01"]
    assert (feb["open"], feb["close"], feb["high"], feb["low"]) == (131.0, 159.0, 160.0, 130.0)
    with pytest.raises(ValueError):
        rollup_bars(rising, "1h")
