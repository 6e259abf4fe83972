"""Joins of prices, indicators, tickers and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeline.schemas import INDICATOR_NAMES, KEYS
from tapeline.session import broadcast_if_small

# The columns of the chart view, in order.
VIEW_COLUMNS = [
    "close", "ma_20", "ma_60", "macd", "macd_signal", "macd_hist", "rsi", "bb_upper", "bb_mid",
    "bb_lower", "bb_pct", "atr", "hv", "stoch_k", "stoch_d", "obv",
]


def with_ticker_details(facts: DataFrame, tickers: DataFrame) -> DataFrame:
    """Inner join to the ticker dimension, which is broadcast if its counted size allows.

    Estimates cannot be relied on here: a dimension that is itself a join is guessed at the
    product of its inputs, and an aggregated fact at the size of its files.
    """
    return facts.join(broadcast_if_small(tickers), "ticker_code")


def price_indicator_view(
    prices: DataFrame, tickers: DataFrame, indicators: DataFrame, code: str | None = None
) -> DataFrame:
    """Close and indicators of listed tickers, every price day kept.

    With a ``code`` the filter is put on all three tables, so it reaches each scan,
    and the days come in order.
    """
    if code is not None:
        one = F.col("ticker_code") == code
        prices, tickers, indicators = prices.where(one), tickers.where(one), indicators.where(one)
    have = [c for c in VIEW_COLUMNS if c in indicators.columns and c != "close"]
    listed = broadcast_if_small(tickers.select("ticker_code"))
    days = prices.select(*KEYS, "close").join(listed, "ticker_code", "left_semi")
    view = days.join(indicators.select(*KEYS, *have), KEYS, "left").select(*KEYS, "close", *have)
    return view if code is None else view.drop("ticker_code").orderBy("date")


def prices_with_indicators(prices: DataFrame, indicators: DataFrame) -> DataFrame:
    """Inner join on ticker and date; only indicator columns come from the right."""
    have = [c for c in INDICATOR_NAMES if c in indicators.columns]
    return prices.join(indicators.select(*KEYS, *have), KEYS)


def bars_with_signals(bars: DataFrame, signals: DataFrame) -> DataFrame:
    """All bars of the tickers that have signals; a day without one gets signal 0."""
    marked = signals.select(*KEYS, "signal", F.lit(1).alias("_scored"))
    joined = bars.join(marked, KEYS, "left")
    scored = F.max("_scored").over(Window.partitionBy("ticker_code"))
    return joined.withColumn("_scored", scored).where("_scored = 1").drop("_scored").fillna({"signal": 0})


def without_data(requested: DataFrame, obtained: DataFrame) -> DataFrame:
    """Requested tickers for which nothing was obtained."""
    found = obtained.select("ticker_code").distinct()
    return requested.select("ticker_code").join(found, "ticker_code", "left_anti")
