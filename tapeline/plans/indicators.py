"""Indicator runs: widen the range, compute, trim, upsert, join to prices."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.functions.indicators import check_names, lookback_rows, with_indicators
from tapeline.functions.periods import extended_start, resolve_range
from tapeline.operators.quality import null_counts
from tapeline.plans.prices import Paths, fetched_bars, refresh_prices
from tapeline.schemas import INDICATOR_NAMES, KEYS
from tapeline.sources import snapshots, store
from tapeline.sources.bars import within


def trimmed_indicators(
    bars: DataFrame, start: date, end: date, names: list[str] | None = None
) -> DataFrame:
    """Indicators for ``start`` to ``end`` inclusive, computed over a range widened by the look-back.

    The widened range is a literal filter and reaches the scan.
    """
    names = list(INDICATOR_NAMES) if names is None else names
    check_names(names)
    first = extended_start(start, lookback_rows(names))
    wide = within(bars, first, end)
    return within(with_indicators(wide, names), start, None)


def full_table(
    source: DataFrame, sessions: DataFrame, tickers: list[str] | DataFrame,
    start: date, end: date, names: list[str] | None = None, interval: str = "1d",
) -> DataFrame:
    """Bars with indicators from ``start`` up to, not including, ``end``.

    One lazy plan: the source is scanned once and the bars that the indicators were
    computed on are the ones returned, so no join is needed.
    """
    names = list(INDICATOR_NAMES) if names is None else names
    first = extended_start(start, lookback_rows(names))
    bars = fetched_bars(source, sessions, tickers, first, end, interval)
    return trimmed_indicators(bars, start, end - timedelta(days=1), names)


@dataclass
class IndicatorRun:
    """Row counts by ticker, and the NULLs of each column after the warm-up was trimmed."""

    counts: DataFrame
    nulls: DataFrame


def refresh_indicators(
    spark: SparkSession, paths: Paths, tickers: list[str] | DataFrame, first: date, until: date,
    names: list[str] | None = None, version: str = "v1.0",
) -> IndicatorRun:
    """Compute the indicators of stored prices from ``first`` to ``until`` inclusive and store them."""
    names = list(INDICATOR_NAMES) if names is None else names
    check_names(names)
    wide = extended_start(first, lookback_rows(names))
    prices = store.load_prices(spark, paths.prices, tickers, wide, until)
    before = snapshots.current(spark, paths.prices)
    buckets = before.buckets if before else snapshots.LEAST_BUCKETS
    # Read for the NULL report and for the save, and written as the stored bars lie: by ticker, without an exchange.
    computed = snapshots.by_ticker(trimmed_indicators(prices, first, until, names).select(*KEYS, *names), buckets, clustered=True)
    counts = store.save_indicators(spark, paths.indicators, computed, version, buckets, written=True)
    return IndicatorRun(counts, null_counts(computed))


def refresh_all(
    spark: SparkSession, paths: Paths, source: DataFrame, sessions: DataFrame,
    tickers: list[str] | DataFrame, start: str | None = None, end: str | None = None,
    period: str | None = None, names: list[str] | None = None, version: str = "v1.0",
    interval: str = "1d", update_if_exists: bool = True, now: date | None = None,
) -> DataFrame:
    """Store prices, compute indicators from what is stored, store them, return the joined table.

    A period is turned into dates once, here. Prices are fetched with the look-back;
    the result starts at the requested day.
    """
    first, last = resolve_range(start, end, period, now)
    if first is None or last is None:
        raise ValueError("give start and end dates, or a period")
    names = list(INDICATOR_NAMES) if names is None else names
    check_names(names)
    wide = extended_start(first, lookback_rows(names))
    refresh_prices(
        spark, paths, source, sessions, tickers, str(wide), str(last),
        interval=interval, update_if_exists=update_if_exists,
    )
    until = last - timedelta(days=1)
    refresh_indicators(spark, paths, tickers, first, until, names, version)
    stored = store.load_indicators(spark, paths.indicators, tickers, first, until)
    bars = store.load_prices(spark, paths.prices, tickers, first, until)
    return bars.join(stored.select("ticker_code", "date", *names), ["ticker_code", "date"])


def indicator_version_counts(spark: SparkSession, paths: Paths) -> DataFrame:
    """Stored indicator rows per calculation version."""
    rows = store.read_fact(spark, paths.indicators, store.schemas.INDICATORS)
    return rows.groupBy("calculated_version").agg(F.count("*").alias("n_rows"))
