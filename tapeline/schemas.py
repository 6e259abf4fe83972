"""Canonical table schemas and fixed column lists."""

from __future__ import annotations

from pyspark.sql import types as T

# The indicator columns, in registry order.
INDICATOR_NAMES = [
    "ma_5", "ma_10", "ma_20", "ma_50", "ma_60", "ma_100", "ma_120", "ma_200",
    "macd", "macd_signal", "macd_hist", "rsi",
    "bb_upper", "bb_mid", "bb_lower", "bb_pct",
    "atr", "hv", "stoch_k", "stoch_d", "obv",
]

PRICE_VALUE_COLUMNS = ["open", "high", "low", "close", "volume", "adj_close"]
KEYS = ["ticker_code", "date"]

TICKERS = T.StructType([
    T.StructField("ticker_code", T.StringType(), False),
    T.StructField("name", T.StringType()),
    T.StructField("market", T.StringType()),
    T.StructField("sector", T.StringType()),
])

PRICES = T.StructType([
    T.StructField("ticker_code", T.StringType(), False),
    T.StructField("date", T.DateType(), False),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.LongType()),
    T.StructField("adj_close", T.DoubleType()),
    T.StructField("retrieved_at", T.TimestampType()),
])

INDICATORS = T.StructType(
    [
        T.StructField("ticker_code", T.StringType(), False),
        T.StructField("date", T.DateType(), False),
    ]
    + [T.StructField(name, T.DoubleType()) for name in INDICATOR_NAMES]
    + [
        T.StructField("calculated_version", T.StringType()),
        T.StructField("calculated_at", T.TimestampType()),
    ]
)

SESSIONS = T.StructType([
    T.StructField("exchange", T.StringType(), False),
    T.StructField("date", T.DateType(), False),
])
HOLIDAYS = SESSIONS

SIGNALS = T.StructType([
    T.StructField("ticker_code", T.StringType(), False),
    T.StructField("date", T.DateType(), False),
    T.StructField("signal", T.IntegerType(), False),
])
