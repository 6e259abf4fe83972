"""The given order and event tables seen as market data.

Line items are ticks: the supplier is the ticker, the ship date the day, the unit
price the traded price and the discounted unit price the adjusted one. Events are
ticks with the user as ticker. Suppliers form the listing.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.functions.markets import infer_market
from tapeline.session import dealt
from tapeline.sources.bars import resample_ticks

# Ticker suffix by supplier key modulo 6, and the exchange that goes with it.
SUFFIXES = [".KS", ".KQ", ".T", ".HK", "", "-USD"]
SUFFIX_EXCHANGES = ["XKRX", "XKRX", "XTKS", "XHKG", "XNYS", "XNYS"]


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def padded_code(key: Column) -> Column:
    """The key in six digits or more; longer keys stay whole."""
    code = key.cast("string")
    return F.when(F.length(code) >= 6, code).otherwise(F.lpad(code, 6, "0"))


def wide(key: Column, digits: int = 0) -> Column:
    """A whole number shifted left by ``digits`` decimal digits, in a fixed-width decimal."""
    return (key.cast("decimal(19,0)") * F.lit(Decimal(10**digits))).cast("decimal(38,0)")


def order_key(rows: DataFrame, parts: dict[str, Column]) -> Column:
    """One whole number that sorts ``rows`` by the parts, whole numbers themselves, from first to last.

    The ends of all parts are looked up first, in one pass over these columns. Parts whose widths fit into 63 bits share
    one long; wider ones go into a fixed-width decimal, the first part before the others.
    """
    names = list(parts)
    ends = rows.agg(*[f(parts[c].cast("long")).alias(f"{c}_{f.__name__}") for c in names for f in (F.min, F.max)]).first()
    low = {c: ends[f"{c}_min"] or 0 for c in names}
    width = {c: ((ends[f"{c}_max"] or 0) - low[c]).bit_length() for c in names}

    def packed(some: list[str]) -> Column:
        key = F.lit(0).cast("long")
        for c in some:
            key = F.shiftleft(key, width[c]).bitwiseOR(parts[c].cast("long") - F.lit(low[c]).cast("long"))
        return key

    if sum(width.values()) <= 63:
        return packed(names)
    if sum(width[c] for c in names[1:]) <= 62:
        return (wide(parts[names[0]], 19) + packed(names[1:]).cast("decimal(19,0)")).cast("decimal(38,0)")
    raise ValueError(f"order of {names} needs {sum(width.values())} bits")


def supplier_code(key: Column) -> Column:
    return padded_code(key)


def supplier_ticker(key: Column) -> Column:
    return F.concat(supplier_code(key), _by_kind(key, SUFFIXES))


def _by_kind(key: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def trade_ticks(spark: SparkSession, folder: str, sequence: bool = True) -> DataFrame:
    """Line items as ticks; order, line and part give the sequence ``seq`` within a day, when it is asked for."""
    rows = read_table(spark, folder, "lineitem")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    parts = {"order": F.col("l_orderkey"), "line": F.col("l_linenumber"), "part": F.col("l_partkey")}
    return rows.select(
        supplier_ticker(F.col("l_suppkey")).alias("ticker_code"),
        F.col("l_suppkey").alias("ticker_id"),
        F.col("l_shipdate").alias("ts"),
        *([order_key(rows, parts).alias("seq")] if sequence else []),
        F.col("l_orderkey").alias("order_key"),
        price.alias("price"),
        (price * (F.lit(1.0) - F.col("l_discount"))).alias("adj_price"),
        F.col("l_quantity").alias("volume"),
    )


def event_ticks(spark: SparkSession, folder: str, sequence: bool = True) -> DataFrame:
    """Events as ticks, in order of time and event."""
    rows = read_table(spark, folder, "events")
    parts = {"time": F.unix_micros(F.col("ts").cast("timestamp")), "event": F.col("event_id")}
    return rows.select(
        F.concat(F.lit("U"), padded_code(F.col("user_id"))).alias("ticker_code"),
        "ts",
        *([order_key(rows, parts).alias("seq")] if sequence else []),
        F.col("value").alias("price"),
        F.col("value").alias("adj_price"),
        F.lit(1).alias("volume"),
    )


def trade_bars(spark: SparkSession, folder: str, interval: str = "1d") -> DataFrame:
    """Line items as bars, grouped by the numeric supplier key; the code is made per bar."""
    bars = resample_ticks(trade_ticks(spark, folder), interval, key="ticker_id")
    code = supplier_ticker(F.col("ticker_id")).alias("ticker_code")
    return bars.select(code, *[c for c in bars.columns if c != "ticker_id"])


def daily_bars(spark: SparkSession, folder: str) -> DataFrame:
    return trade_bars(spark, folder)


def series_bars(spark: SparkSession, folder: str) -> DataFrame:
    """``daily_bars`` dealt out by ticker for the jobs whose windows run over series; there are no more bars than ticks."""
    return dealt(daily_bars(spark, folder), read_table(spark, folder, "lineitem").count(), "ticker_code")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as listing rows ``(exchange, pos, symbol, market)``, padding included."""
    kind = F.col("s_nationkey") % 5
    padded = F.concat(F.lit(" "), supplier_code(F.col("s_suppkey")), F.lit(" "))
    return read_table(spark, folder, "supplier").select(
        F.when(kind < 3, "KRX").when(kind == 3, "NYSE").otherwise("AMEX").alias("exchange"),
        F.col("s_suppkey").alias("pos"),
        F.when(F.col("s_suppkey") % 11 == 10, F.lit(" nan ")).otherwise(padded).alias("symbol"),
        F.when(kind == 0, "KOSPI").when(kind == 1, "Kosdaq Global").when(kind == 2, "KONEX")
        .when(kind == 3, "NYSE").otherwise("AMEX").alias("market"),
    )


def tickers(spark: SparkSession, folder: str) -> DataFrame:
    """Ticker dimension of the suppliers; the nation stands for the sector."""
    code = supplier_ticker(F.col("s_suppkey"))
    nation = read_table(spark, folder, "nation")
    return (
        read_table(spark, folder, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .select(
            code.alias("ticker_code"), F.col("s_name").alias("name"),
            infer_market(code).alias("market"), F.col("n_name").alias("sector"),
        )
    )


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Trading days per exchange: the days on which any of its tickers traded."""
    exchange = _by_kind(F.col("l_suppkey"), SUFFIX_EXCHANGES).alias("exchange")
    return read_table(spark, folder, "lineitem").select(exchange, F.to_date("l_shipdate").alias("date")).distinct()
