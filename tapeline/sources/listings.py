"""Exchange listings and ticker universes."""

from __future__ import annotations

import logging
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.functions.markets import listing_suffix, market_suffix
from tapeline.session import small_table

log = logging.getLogger(__name__)

# Exchanges a universe may name, in default order.
SUPPORTED_EXCHANGES = ["KRX", "KOSPI", "KOSDAQ", "S&P500", "NYSE", "AMEX"]
_KOREAN_MARKETS = ["KOSPI", "KOSDAQ"]
_EMPTY = "ticker_code string, pos long"


def read_listing(spark: SparkSession, path: str, fmt: str = "csv", **options: str) -> DataFrame:
    """Listing table with lower-case column names (``symbol``, ``market``, ...)."""
    if fmt == "csv":
        options = {"header": "true", **options}
    df = spark.read.format(fmt).options(**options).load(path)
    return df.toDF(*[c.strip().lower() for c in df.columns])


def _usable(listing: DataFrame, what: str) -> bool:
    if "symbol" in listing.columns:
        return True
    log.warning("%s listing has no symbol column", what)
    return False


def _nothing(listing: DataFrame) -> DataFrame:
    return small_table(listing.sparkSession, [], _EMPTY)


def korean_symbols(listing: DataFrame, add_suffix: bool = True) -> DataFrame:
    """Trimmed symbols with the suffix of their market; blank and ``nan`` rows go."""
    if not _usable(listing, "KRX"):
        return _nothing(listing)
    code = F.trim(F.col("symbol").cast("string"))
    market = F.col("market") if "market" in listing.columns else F.lit("")
    tail = listing_suffix(market) if add_suffix else F.lit("")
    kept = listing.where((code != "") & (F.lower(code) != "nan"))
    return kept.select(F.concat(code, tail).alias("ticker_code"), "pos")


def plain_symbols(listing: DataFrame) -> DataFrame:
    """Trimmed symbols; NULL and blank rows go."""
    if not _usable(listing, "plain"):
        return _nothing(listing)
    code = F.trim(F.col("symbol").cast("string"))
    return listing.where(code != "").select(code.alias("ticker_code"), "pos")


def of_market(listing: DataFrame, prefix: str) -> DataFrame:
    """Rows whose market starts with ``prefix``, ignoring case."""
    if "market" not in listing.columns:
        return listing
    return listing.where(F.upper("market").startswith(prefix.upper()))


def codes_with_market_suffix(codes: DataFrame) -> DataFrame:
    """Bare codes with a ``market`` column, turned into ticker codes."""
    return codes.select(F.concat("code", market_suffix(F.col("market"))).alias("ticker_code"), "pos")


def chosen_exchanges(exchanges: Iterable[str] | None) -> list[str]:
    """Upper-case supported names in the order asked; others are skipped with a warning."""
    picked = []
    for name in (e.upper() for e in (list(exchanges or []) or SUPPORTED_EXCHANGES)):
        if name in SUPPORTED_EXCHANGES:
            picked.append(name)
        else:
            log.warning("exchange %s is not supported and is skipped", name)
    return picked


def exchange_symbols(listing: DataFrame, part: str, add_suffix: bool = True) -> DataFrame:
    """Symbols of one listing part: a Korean market by its prefix, or an exchange by name."""
    if part in _KOREAN_MARKETS:
        korean = listing.where(F.upper("exchange") == "KRX")
        return korean_symbols(of_market(korean, part), add_suffix)
    return plain_symbols(listing.where(F.upper("exchange") == part))


def symbols_by_exchange(
    listing: DataFrame, exchanges: Iterable[str] | None = None, add_suffix: bool = True
) -> DataFrame:
    """``(exchange, rank, pos, ticker_code)``, one row per listed symbol of each exchange asked.

    ``rank`` is the order of listing: KRX is KOSPI followed by KOSDAQ. Long on purpose:
    an exchange can hold any number of tickers, so they are not gathered into one array.
    """
    named = [
        (name, part) for name in chosen_exchanges(exchanges)
        for part in (_KOREAN_MARKETS if name == "KRX" else [name])
    ]
    parts = [
        exchange_symbols(listing, part, add_suffix).select(
            F.lit(name).alias("exchange"), F.lit(rank).alias("rank"), "pos", "ticker_code"
        )
        for rank, (name, part) in enumerate(named)
    ]
    if not parts:
        empty = "exchange string, rank int, pos long, ticker_code string"
        return small_table(listing.sparkSession, [], empty)
    return reduce(DataFrame.unionByName, parts)


def first_occurrences(rows: DataFrame, order: list[str]) -> DataFrame:
    """Each non-blank ticker once, with the place of its first occurrence.

    A minimum per ticker, combined on the map side, rather than a ranking.
    """
    kept = rows.where(F.col("ticker_code") != "")
    place = F.min(F.struct(*order)).alias("_place")
    return kept.groupBy("ticker_code").agg(place).select(
        "ticker_code", *[F.col(f"_place.{c}").alias(c) for c in order]
    )


def universe(
    listing: DataFrame, exchanges: Iterable[str] | None = None, add_suffix: bool = True
) -> DataFrame:
    """Deduplicated tickers of the exchanges; sort by ``(rank, pos)`` for list order."""
    return first_occurrences(symbols_by_exchange(listing, exchanges, add_suffix), ["rank", "pos"])


def first_tickers(tickers: DataFrame, count: int) -> DataFrame:
    """The first ``count`` tickers in list order (top-k, no full sort)."""
    return tickers.orderBy("rank", "pos", "ticker_code").limit(count)


def pick_universe(
    spark: SparkSession, tickers: list[str] | None, exchanges: list[str] | None, listing: DataFrame | None
) -> DataFrame:
    """Either an explicit ticker list or a universe by exchange, as one table."""
    if tickers and exchanges:
        raise ValueError("give either tickers or exchanges, not both")
    if tickers:
        rows = [(t, i) for i, t in enumerate(tickers)]
        listed = small_table(spark, rows, "ticker_code string, pos long")
        return first_occurrences(listed.withColumn("rank", F.lit(0)), ["rank", "pos"])
    if exchanges and listing is not None:
        return universe(listing, exchanges)
    raise ValueError("give tickers, or exchanges with a listing")
