"""Price refresh: scan, fill calendar gaps, upsert."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.functions.markets import exchange_code
from tapeline.functions.periods import resolve_range
from tapeline.operators import keyed
from tapeline.operators.gaps import fill_gaps
from tapeline.sources import store
from tapeline.sources.bars import of_tickers, rollup_bars


@dataclass(frozen=True)
class Paths:
    """Folders of the stored tables."""

    tickers: str
    prices: str
    indicators: str


def fetched_bars(
    source: DataFrame, sessions: DataFrame, tickers: list[str] | DataFrame,
    start: date, end: date, interval: str = "1d",
) -> DataFrame:
    """Bars of the tickers from ``start`` up to, not including, ``end``, gaps filled with NULL rows."""
    rows = of_tickers(source, tickers)
    rows = rows.where((F.col("date") >= F.lit(start)) & (F.col("date") < F.lit(end)))
    if interval != "1d":
        return rollup_bars(rows, interval).where(exchange_code(F.col("ticker_code")).isNotNull())
    return fill_gaps(rows, sessions)


def refresh_prices(
    spark: SparkSession, paths: Paths, source: DataFrame, sessions: DataFrame,
    tickers: list[str] | DataFrame, start: str | None = None, end: str | None = None,
    period: str | None = None, interval: str = "1d", update_if_exists: bool = True,
    now: date | None = None,
) -> DataFrame:
    """Fetch, fill and store; returns per-ticker row counts."""
    first, last = resolve_range(start, end, period, now)
    first = first or date(1970, 1, 1)
    last = last or (now or date.today()) + timedelta(days=1)
    bars = fetched_bars(source, sessions, tickers, first, last, interval)
    counts = store.save_prices(spark, paths.prices, bars, update_if_exists)
    known = keyed.add_tickers(store.read_tickers(spark, paths.tickers), counts)
    store.write_tickers(spark, paths.tickers, known)
    return counts
