"""Exchange sessions and hand-kept holidays."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.functions.markets import exchange_code
from tapeline.schemas import HOLIDAYS
from tapeline.session import small_table

# Closed days that published calendars miss, by exchange.
EXTRA_HOLIDAYS = {"XKRX": ["2022-01-03", "2022-05-09"], "XNYS": [], "XNAS": []}


def holiday_table(spark: SparkSession, days: dict[str, list[str | date] | None] | None) -> DataFrame:
    """Mapping of exchange to days as a table; an empty or missing list gives no rows."""
    rows = [(exchange, day) for exchange, listed in (days or {}).items() for day in listed or []]
    return small_table(spark, rows, "exchange string, date date")


def read_holidays(spark: SparkSession, path: str) -> DataFrame:
    """Stored holiday table (``exchange, date``); a missing file gives no rows."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], HOLIDAYS)
    return spark.read.schema(HOLIDAYS).option("header", "true").csv(path)


def open_sessions(sessions: DataFrame, holidays: DataFrame) -> DataFrame:
    """Sessions without the holidays of their exchange."""
    return sessions.join(holidays, ["exchange", "date"], "left_anti")


def sessions_of(bars: DataFrame) -> DataFrame:
    """Sessions seen in a bar table: each day on which some ticker of an exchange traded."""
    seen = bars.select(exchange_code(F.col("ticker_code")).alias("exchange"), "date")
    return seen.where(F.col("exchange").isNotNull()).distinct()
