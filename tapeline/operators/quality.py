"""Row counts, NULL profiles, success rates and input checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeline.functions.numeric import ratio


def rows_per_ticker(df: DataFrame, name: str = "n_rows") -> DataFrame:
    return df.groupBy("ticker_code").agg(F.count("*").alias(name))


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """Per ticker, the rows of each stage, in one aggregation over the union."""
    tagged = [
        df.select("ticker_code", F.lit(name).alias("_stage")) for name, df in stages.items()
    ]
    union = reduce(DataFrame.unionByName, tagged)
    return union.groupBy("ticker_code").agg(
        *[F.count_if(F.col("_stage") == name).alias(name) for name in stages]
    )


def stage_totals(counts: DataFrame) -> DataFrame:
    names = [c for c in counts.columns if c != "ticker_code"]
    return counts.agg(*[F.sum(c).alias(c) for c in names])


def success_rate(requested: DataFrame, obtained: DataFrame) -> DataFrame:
    """Requested and obtained tickers and their rate in per cent."""
    asked = requested.select("ticker_code").distinct()
    found = obtained.select("ticker_code").distinct().withColumn("_found", F.lit(1))
    return asked.join(found, "ticker_code", "left").agg(
        F.count("*").alias("requested"),
        F.count("_found").alias("obtained"),
        ratio(F.count("_found") * 100.0, F.count("*")).alias("success_rate"),
    )


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """NULLs per column, as one row."""
    picked = columns or df.columns
    return df.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in picked])


def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per ticker: NULL cells, all cells, and their ratio in per cent."""
    picked = columns or df.columns
    nulls = reduce(Column.__add__, [F.col(c).isNull().cast("int") for c in picked])
    per = df.groupBy("ticker_code").agg(
        F.sum(nulls).alias("null_cells"), (F.count("*") * len(picked)).alias("cells")
    )
    return per.withColumn("null_pct", ratio(F.col("null_cells") * 100.0, F.col("cells")))


def series_check(bars: DataFrame, file_order: str, stretch: Column | int = 65_536) -> DataFrame:
    """Per ticker: rows, distinct days, repeated days and days out of order.

    ``file_order`` numbers the rows as supplied. Unchecked input may repeat days
    without bound, so a ticker is compared in stretches of the file (``stretch`` order
    numbers long, or numbered by a column that rises with the order), their ends in groups
    of 4096 stretches, and only the ends of those groups per ticker.
    """
    if not isinstance(bars.schema["date"].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise ValueError(f"'date' must be a date or timestamp, got {bars.schema['date'].dataType.simpleString()}")
    at = F.col(file_order)
    number = F.floor(at / stretch) if isinstance(stretch, int) else stretch
    rows = bars.select("ticker_code", "date", at.alias("_at"), number.cast("long").alias("_stretch"))
    # Rows with one order number are taken in date order.
    level = rows.select(
        "ticker_code", "_stretch", F.struct("_at", "date").alias("_place"), F.lit(0).cast("long").alias("_late"),
        F.col("date").alias("_first"), F.col("date").alias("_last"),
    )
    for parent in (F.col("_stretch"), F.floor(F.col("_stretch") / 4096), F.lit(0)):
        level = _joined_ends(level.withColumn("_group", parent.cast("long")))
    order = level.select("ticker_code", F.col("_late").alias("out_of_order"))
    days = rows.groupBy("ticker_code", "date").agg(F.count("*").alias("_n"))
    counts = days.groupBy("ticker_code").agg(
        F.sum("_n").alias("n_rows"), F.count("*").alias("n_days"),
        F.sum(F.col("_n") - 1).alias("repeated"),
    )
    return counts.join(order, "ticker_code")


def _joined_ends(parts: DataFrame) -> DataFrame:
    """One row per ticker and group: late days inside and between its parts, first and last day."""
    previous = F.lag("_last").over(Window.partitionBy("ticker_code", "_group").orderBy("_place"))
    turned = F.coalesce((F.col("_first") < previous).cast("long"), F.lit(0))
    ends = F.struct("_place", "_first", "_last")
    return parts.withColumn("_turned", turned).groupBy("ticker_code", "_group").agg(
        F.sum(F.col("_late") + F.col("_turned")).alias("_late"), F.min(ends).alias("_low"), F.max(ends).alias("_high"),
    ).select(
        "ticker_code", F.col("_group").alias("_stretch"), "_late", F.col("_low._place").alias("_place"),
        F.col("_low._first").alias("_first"), F.col("_high._last").alias("_last"),
    )


def require_rows(df: DataFrame) -> DataFrame:
    """``df`` unchanged, or ValueError when it is empty."""
    if df.isEmpty():
        raise ValueError("no rows to compute on")
    return df


def bad_signals(signals: DataFrame) -> DataFrame:
    """Signals other than 0 and 1."""
    return signals.where(F.col("signal").isNull() | ~F.col("signal").isin(0, 1))


def signal_density(signals: DataFrame) -> DataFrame:
    """Per ticker: buy signals, days, and their ratio."""
    per = signals.groupBy("ticker_code").agg(
        F.count_if(F.col("signal") == 1).alias("buys"), F.count("*").alias("days")
    )
    return per.withColumn("density", F.col("buys") / F.col("days"))
