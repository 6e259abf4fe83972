"""Trading-calendar gaps: fill, report, coverage.

Gaps are found between neighbouring bars of a ticker, so the bars are shuffled once
(by ticker, the layout every indicator needs). A calendar holds the sessions of an exchange in order and, for
each calendar day, the number of sessions up to it. The sessions between two bars are then a slice between two
ordinals: only missing sessions become rows, and no calendar day is looked up one by one.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions.indicators import repeated_day
from tapeline.functions.markets import EXCHANGES, exchange_code


def session_calendar(sessions: DataFrame) -> DataFrame:
    """One row per exchange: ``first`` session, ``sessions`` in order, and ``upto``.

    ``upto`` has one number per calendar day from the first session to the last: the sessions up to that day.
    There are as many rows as known exchanges, and a row is as long as the calendar, whatever the number of bars.
    """
    w = Window.partitionBy("exchange").orderBy("date")
    known = sessions.where(F.col("exchange").isin(EXCHANGES) & F.col("date").isNotNull()).select("exchange", "date").distinct()
    spans = known.select(
        "exchange", "date", F.row_number().over(w).alias("ordinal"),
        F.coalesce(F.datediff(F.lead("date").over(w), "date"), F.lit(1)).alias("span"),
    )
    listed = spans.groupBy("exchange").agg(F.array_sort(F.collect_list(F.struct("ordinal", "date", "span"))).alias("days"))
    return listed.select(
        "exchange", F.col("days.date").alias("sessions"), F.col("days.date")[0].alias("first"),
        F.flatten(F.transform("days", lambda d: F.array_repeat(d["ordinal"], d["span"]))).alias("upto"),
    )


def sessions_upto(day: Column) -> Column:
    """Number of sessions up to ``day``, from the columns of ``session_calendar``; 0 without a calendar."""
    at = F.datediff(day, "first")
    inside = F.get("upto", at)
    return F.coalesce(inside, F.when(at > 0, F.size("sessions")), F.lit(0))


def _with_missing(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Bars of known exchanges with ``_missing``, the sessions up to the ticker's next bar, and ``_session``, whether theirs is one."""
    w = Window.partitionBy("ticker_code").orderBy("date")
    known = bars.withColumn("exchange", exchange_code(F.col("ticker_code")))
    known = known.where(F.col("exchange").isNotNull())
    stop = F.raise_error(F.concat(F.lit("repeated day for ticker "), F.col("ticker_code")))
    spaced = known.withColumn("_next", F.when(repeated_day(w), stop.cast("date")).otherwise(F.lead("date").over(w)))
    # One row per known exchange.
    placed = spaced.join(F.broadcast(session_calendar(sessions)), "exchange", "left")
    own = sessions_upto(F.col("date"))
    until = F.when(F.col("_next").isNull(), own).otherwise(sessions_upto(F.date_sub("_next", 1)))
    none = F.array().cast("array<date>")
    missing = F.when(until > own, F.slice("sessions", own + 1, until - own)).otherwise(none)
    on = F.coalesce(F.get("sessions", own - 1) == F.col("date"), F.lit(False))
    return placed.select(*bars.columns, missing.alias("_missing"), on.alias("_session"))


def fill_gaps(
    bars: DataFrame, sessions: DataFrame, drop_non_sessions: bool = False, carry: tuple[str, ...] = ("tz",)
) -> DataFrame:
    """Add a NULL row for each session missing between a ticker's first and last bar.

    Bars on days that are no session stay unless ``drop_non_sessions`` is set. Columns
    in ``carry``, such as the time zone, are taken over from the bar before the gap.
    """
    found = _with_missing(bars, sessions)
    own = F.array("date")
    if drop_non_sessions:
        own = F.when(F.col("_session"), own).otherwise(F.array().cast("array<date>"))
    days = found.select(*bars.columns, F.explode(F.concat(own, "_missing")).alias("_day"))
    values = [c for c in bars.columns if c not in ("ticker_code", "date", *carry)]
    filled = {c: F.when(F.col("_day") == F.col("date"), F.col(c)).alias(c) for c in values}
    return days.select(*[F.col("_day").alias("date") if c == "date" else filled.get(c, F.col(c)) for c in bars.columns])


def missing_sessions(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """The sessions that ``fill_gaps`` would add: ``(ticker_code, date)``."""
    found = _with_missing(bars.select("ticker_code", "date"), sessions)
    return found.select("ticker_code", F.explode("_missing").alias("date"))


def coverage(bars: DataFrame, sessions: DataFrame, start: date | str, end: date | str) -> DataFrame:
    """Per ticker: its first and last bar beside the first and last session of the range."""
    spans = bars.groupBy("ticker_code").agg(
        F.min("date").alias("first_bar"), F.max("date").alias("last_bar"), F.count("*").alias("n_bars")
    ).withColumn("exchange", exchange_code(F.col("ticker_code")))
    in_range = sessions.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    # One row per exchange, of which there are four.
    wanted = in_range.groupBy("exchange").agg(
        F.min("date").alias("first_session"), F.max("date").alias("last_session")
    )
    return spans.join(F.broadcast(wanted), "exchange", "left")


def short_coverage(bars: DataFrame, sessions: DataFrame, start: date | str, end: date | str) -> DataFrame:
    """Tickers whose bars start or end on another day than the range's sessions."""
    differs = (F.col("first_bar") != F.col("first_session")) | (F.col("last_bar") != F.col("last_session"))
    return coverage(bars, sessions, start, end).where(differs)
