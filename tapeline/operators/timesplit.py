"""Chronological cuts: train/test split and expanding-window folds.

Rows are ordered by (date, ticker). A cut at a given rank is found from the number of
rows per day (one small row per calendar day) and, on the day it falls in, from the
tickers of that day alone. The split then is a plain comparison with literals, which
needs no global sort, no join, and can be pushed into a scan.

``with_sketched_split`` cuts between days instead, at a quantile of the dates from a mergeable sketch: one pass with
buffers of a fixed size, for tables where even a count per day is too much.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from dataclasses import dataclass
from datetime import date
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.session import materialize, small_table


@dataclass(frozen=True)
class Cut:
    """Rows up to and including (day, ticker_code) lie before the cut."""

    day: date
    ticker_code: str

    def before(self) -> Column:
        on_day = (F.col("date") == F.lit(self.day)) & (F.col("ticker_code") <= self.ticker_code)
        return (F.col("date") < F.lit(self.day)) | on_day


def _tickers_at(df: DataFrame, places: list[tuple[date, int]]) -> list[str]:
    """For each (day, k), the ``k``-th ticker (from 1) of that day, in two jobs for all.

    No day is put into one task: rows of the cut days are dealt out by range, counts per
    range give each its offset, and only the ranges that are hit get their rows numbered.
    """
    spark = df.sparkSession
    wanted = small_table(spark, [(i, d, k) for i, (d, k) in enumerate(places)], "cut int, date date, k long")
    days = sorted({d for d, _ in places})
    ranged = df.where(F.col("date").isin(days)).select("date", "ticker_code").repartitionByRange("date", "ticker_code")
    rows = materialize(ranged.withColumn("part", F.spark_partition_id()))
    # One row per day and range: few, whatever the number of tickers.
    up_to = Window.partitionBy("date").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("date", "part").agg(F.count("*").alias("size"))
    placed = sizes.withColumn("offset", F.coalesce(F.sum("size").over(up_to), F.lit(0)))
    # ``wanted`` has one row per cut.
    hit = placed.join(F.broadcast(wanted), "date").where(
        (F.col("offset") < F.col("k")) & (F.col("offset") + F.col("size") >= F.col("k"))
    ).select("cut", "date", "part", (F.col("k") - F.col("offset")).alias("rank")).collect()
    groups = F.broadcast(small_table(spark, hit, "cut int, date date, part int, rank long"))
    w = Window.partitionBy("date", "part").orderBy("ticker_code")
    inside = rows.join(groups.select("date", "part").distinct(), ["date", "part"], "left_semi")
    numbered = inside.withColumn("rank", F.row_number().over(w))
    found = numbered.join(groups, ["date", "part", "rank"]).select("cut", "ticker_code").collect()
    by_cut = {r["cut"]: r["ticker_code"] for r in found}
    return [by_cut[i] for i in range(len(places))]


def row_counts_by_day(df: DataFrame) -> list[tuple[date, int]]:
    """Rows per day in date order; one entry per calendar day reaches the driver."""
    counts = df.groupBy("date").agg(F.count("*").alias("n_rows")).collect()
    return sorted((r["date"], r["n_rows"]) for r in counts)


def cuts_at(df: DataFrame, ranks: list[int], by_day: list[tuple[date, int]]) -> list[Cut]:
    """One cut per rank, placed after the row of that rank in (date, ticker) order."""
    ends = list(accumulate(n for _, n in by_day))
    places = []
    for rank in ranks:
        at = bisect_left(ends, rank)
        day, rows = by_day[at]
        places.append((day, rank - (ends[at] - rows)))
    tickers = _tickers_at(df, places)
    return [Cut(day, code) for (day, _), code in zip(places, tickers)]


def with_split(df: DataFrame, test_share: float = 0.2) -> DataFrame:
    """Add ``split``: the last ``ceil(test_share n)`` rows are ``test``, the others ``train``."""
    keys = materialize(df.select("date", "ticker_code"))  # counts and cuts then read two columns
    by_day = row_counts_by_day(keys)
    total = sum(n for _, n in by_day)
    n_train = total - math.ceil(test_share * total)
    if n_train <= 0:
        return df.withColumn("split", F.lit("test"))
    (cut,) = cuts_at(keys, [n_train], by_day)
    return df.withColumn("split", F.when(cut.before(), "train").otherwise("test"))


@dataclass(frozen=True)
class SketchedCut:
    """Rows up to and including ``day`` are for training; how many were wanted, and how far off the cut may be."""

    day: date
    n_rows: int
    wanted: int
    rank_error: float

    def allowed(self) -> float:
        """Rows by which the rank of the day may differ from the wanted one: before the day, or after it ends."""
        return self.rank_error * self.n_rows + 1


def sketched_cut(df: DataFrame, test_share: float = 0.2, rank_error: float = 1e-3) -> SketchedCut | None:
    """The day that holds the last training row, by a quantile sketch; None for an empty table.

    Some row of the day has a rank within ``rank_error`` times the rows of the wanted one.
    """
    if not 0 < rank_error < 1:
        raise ValueError("the rank error lies between 0 and 1")
    total, day = df.agg(
        F.count("date"), F.approx_percentile("date", 1.0 - test_share, math.ceil(1 / rank_error)),
    ).first()
    return SketchedCut(day, total, total - math.ceil(test_share * total), rank_error) if total else None


def with_sketched_split(df: DataFrame, test_share: float = 0.2, rank_error: float = 1e-3) -> DataFrame:
    """``with_split`` at day borders: days up to the sketched cut are ``train``, later ones ``test``.

    The training part ends within ``rank_error`` times the rows of the exact cut, plus what the cut's day holds after it.
    """
    cut = sketched_cut(df, test_share, rank_error)
    if cut is None:
        return df.withColumn("split", F.lit("test"))
    return df.withColumn("split", F.when(F.col("date") <= F.lit(cut.day), "train").otherwise("test"))


def with_folds(df: DataFrame, n_splits: int = 5) -> DataFrame:
    """Add ``fold`` from 0 to ``n_splits`` in time order; fold 0 takes the remainder.

    Split ``i`` trains on folds below ``i`` and tests on fold ``i``.
    """
    keys = materialize(df.select("date", "ticker_code"))
    by_day = row_counts_by_day(keys)
    total = sum(n for _, n in by_day)
    size = total // (n_splits + 1)
    if size == 0:
        raise ValueError(f"{total} rows are too few for {n_splits} splits")
    ranks = [total - size * (n_splits - i) for i in range(n_splits)]
    cuts = cuts_at(keys, ranks, by_day)
    fold = F.lit(n_splits)
    for number in reversed(range(n_splits)):
        fold = F.when(cuts[number].before(), number).otherwise(fold)
    return df.withColumn("fold", fold.cast("int"))
