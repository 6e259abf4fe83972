"""Market and exchange rules on ticker codes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rules are tried top to bottom, first match wins.
MARKET_BY_SUFFIX = [(".KS", "KOSPI"), (".KQ", "KOSDAQ")]
MARKET_BY_LATER_SUFFIX = [(".T", "TOKYO"), (".HK", "HONGKONG")]
CRYPTO_MARK = "-USD"
EXCHANGE_BY_SUFFIX = [(".KS", "XKRX"), (".KQ", "XKRX"), (".T", "XTKS"), (".HK", "XHKG")]
PLAIN_EXCHANGE = "XNYS"
EXCHANGES = sorted({e for _, e in EXCHANGE_BY_SUFFIX} | {PLAIN_EXCHANGE})


def _first_match(cases: list[tuple[Column, str]], otherwise: Column) -> Column:
    return F.coalesce(*[F.when(test, F.lit(value)) for test, value in cases], otherwise)


def infer_market(code: Column) -> Column:
    """Market name of a ticker code, ignoring case."""
    up = F.upper(code)
    cases = [(up.endswith(s), m) for s, m in MARKET_BY_SUFFIX]
    cases.append((up.contains(CRYPTO_MARK), "CRYPTO"))
    cases += [(up.endswith(s), m) for s, m in MARKET_BY_LATER_SUFFIX]
    cases.append((~up.contains("."), "US"))
    return _first_match(cases, F.lit("UNKNOWN"))


def exchange_code(code: Column) -> Column:
    """Exchange calendar code of a ticker code; NULL when it cannot be told."""
    up = F.upper(code)
    cases = [(up.endswith(s), e) for s, e in EXCHANGE_BY_SUFFIX]
    cases.append((~up.contains("."), PLAIN_EXCHANGE))
    return _first_match(cases, F.lit(None).cast("string"))


def listing_suffix(market: Column) -> Column:
    """Suffix of a Korean listing row, by market prefix; empty for other markets."""
    up = F.upper(F.coalesce(market, F.lit("")))
    return _first_match(
        [(up.startswith("KOSPI"), ".KS"), (up.startswith("KOSDAQ"), ".KQ")], F.lit("")
    )


def market_suffix(market: Column) -> Column:
    """Suffix when the market name is exact: KOSPI has its own, all others share one."""
    return F.when(F.upper(market) == "KOSPI", F.lit(".KS")).otherwise(F.lit(".KQ"))
