"""Bar scans, column names, and resampling of ticks or bars to an interval."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.functions.periods import parse_day
from tapeline.schemas import PRICES
from tapeline.session import broadcast_if_small

# Interval name -> date_trunc unit.
INTERVALS = {"1d": "day", "1wk": "week", "1mo": "month"}


def normalize_columns(df: DataFrame) -> DataFrame:
    """Trimmed, lower-case column names with ``_`` for spaces."""
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def local_day(ts: Column, zone: Column | str) -> Column:
    """Trading day of an instant in the exchange's time zone."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def within(df: DataFrame, start: date | str | None, end: date | str | None) -> DataFrame:
    """Keep dates from ``start`` to ``end``, both inclusive, each optional."""
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    return df


def of_tickers(df: DataFrame, tickers: list[str] | DataFrame) -> DataFrame:
    """Keep the listed tickers; a list becomes a pushed-down filter, a table a semi join."""
    if isinstance(tickers, DataFrame):
        return df.join(broadcast_if_small(tickers.select("ticker_code")), "ticker_code", "left_semi")
    return df.where(F.col("ticker_code").isin(list(tickers)))


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Scan a stored bar table with the canonical schema (parquet, csv, orc or json)."""
    if fmt == "csv":
        options = {"header": "true", **options}
    return spark.read.format(fmt).options(**options).schema(PRICES).load(path)


def scan_bars(
    bars: DataFrame, tickers: list[str] | DataFrame, start: str, end: str, interval: str = "1d"
) -> DataFrame:
    """Bars of the tickers in ``[start, end)``; tickers without rows are simply absent."""
    first, stop = parse_day(start), parse_day(end)
    if first >= stop:
        raise ValueError(f"empty range: {start} to {end}")
    picked = of_tickers(bars, tickers)
    picked = picked.where((F.col("date") >= F.lit(first)) & (F.col("date") < F.lit(stop)))
    return picked if interval == "1d" else rollup_bars(picked, interval)


def _unit(interval: str) -> str:
    if interval not in INTERVALS:
        raise ValueError(f"unknown interval {interval!r}; one of {list(INTERVALS)}")
    return INTERVALS[interval]


def _bucket(c: Column, interval: str) -> Column:
    day = F.to_date(c)
    return day if interval == "1d" else F.trunc(day, _unit(interval))


def resample_ticks(
    ticks: DataFrame, interval: str = "1d", *, key: str = "ticker_code", seq: str = "seq",
    ts: str = "ts", price: str = "price", volume: str = "volume", adj_price: str = "adj_price",
) -> DataFrame:
    """Ticks to bars. ``seq`` orders the ticks of a bucket and must be a number or timestamp.

    With such a key every buffer is fixed width, so Spark aggregates by hash on
    the map side: a hot ticker shrinks to its days before anything is shuffled.
    ``key`` may be a narrower stand-in for the ticker code, such as a numeric id.
    """
    _unit(interval)
    return ticks.groupBy(key, _bucket(F.col(ts), interval).alias("date")).agg(
        F.min_by(price, seq).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, seq).alias("close"),
        F.sum(volume).cast("long").alias("volume"),
        F.max_by(adj_price, seq).alias("adj_close"),
    )


def rollup_bars(bars: DataFrame, interval: str) -> DataFrame:
    """Daily bars to a coarser interval."""
    unit = _unit(interval)
    if interval == "1d":
        return bars
    return bars.groupBy("ticker_code", F.trunc("date", unit).alias("date_")).agg(
        F.min_by("open", "date").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "date").alias("close"),
        F.sum("volume").alias("volume"),
        F.max_by("adj_close", "date").alias("adj_close"),
    ).withColumnRenamed("date_", "date")
