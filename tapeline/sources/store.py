"""Stored tables: prices and indicators in versioned cells, the ticker dimension, the metrics file.

Facts are snapshots of cells by month and ticker bucket (``tapeline.sources.snapshots``). A merge reads and
rewrites only the cells that hold keys of the batch. One join finds the merged rows, repeated keys and
what happened to each row; stored rows need no exchange for it, the batch needs one, or none when it was
computed from stored rows. The new cells become valid in one step or not at all.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeline import schemas
from tapeline.operators import keyed
from tapeline.session import materialize
from tapeline.sources import snapshots
from tapeline.sources.bars import of_tickers, within

Merge = Callable[[DataFrame, DataFrame, str], DataFrame]
MARK = "_outcome"  # what the write that made a row did to it


def _marked(schema: T.StructType) -> T.StructType:
    return T.StructType(schema.fields + [T.StructField(MARK, T.ByteType())])


def read_fact(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Stored fact, ``month`` and ``cell`` included for pruning; empty when nothing is stored yet."""
    return snapshots.read(spark, path.rstrip("/"), schema, snapshots.current(spark, path.rstrip("/")))


def _in_months(df: DataFrame, start: date | str | None, end: date | str | None) -> DataFrame:
    if start is not None:
        df = df.where(F.col("month") >= str(start)[:7])
    if end is not None:
        df = df.where(F.col("month") <= str(end)[:7])
    return df


def merge_fact(
    spark: SparkSession, path: str, schema: T.StructType, incoming: DataFrame, merge: Merge,
    buckets: int | None = None, written: bool = False,
) -> DataFrame:
    """Merge into a stored fact and return per-ticker row counts.

    The incoming rows are written once to the shared folder first, by ticker, unless ``written`` says that
    ``snapshots.by_ticker`` has done so. ``buckets`` counts when the table is new; without it the tickers, rows and
    days of the first batch decide.
    """
    path = path.rstrip("/")
    before = snapshots.current(spark, path)
    buckets = before.buckets if before else buckets
    if buckets is None:
        plain = materialize(incoming)
        found = plain.agg(F.approx_count_distinct("ticker_code"), F.count("*"), F.approx_count_distinct("date")).first()
        buckets = snapshots.buckets_for(*found)
        batch = plain.repartition(buckets, "ticker_code")
    else:
        batch = plain = incoming if written else snapshots.by_ticker(incoming, buckets)
    named = snapshots.placed(plain.select(*schemas.KEYS), buckets)
    touched = {(r["month"], r["cell"]) for r in named.select("month", "cell").distinct().collect()}
    stored = snapshots.read(spark, path, schema, before)
    existing = snapshots.in_cells(stored, touched).select(*schema.fieldNames())
    made = snapshots.replace_cells(
        spark, path, _marked(schema), before, buckets, touched,
        merge(existing, batch, MARK).select(*schema.fieldNames(), MARK), F.col(MARK) == keyed.REPEATED,
    )
    return keyed.counts_by_mark(made, MARK)


def save_prices(
    spark: SparkSession, path: str, incoming: DataFrame, update_if_exists: bool = True, buckets: int | None = None
) -> DataFrame:
    """Upsert bars (or insert only new keys) and return per-ticker row counts."""
    if "retrieved_at" not in incoming.columns:
        incoming = incoming.withColumn("retrieved_at", F.current_timestamp())
    missing = [c for c in [*schemas.KEYS, *schemas.PRICE_VALUE_COLUMNS] if c not in incoming.columns]
    if missing:
        raise ValueError(f"price rows lack columns {missing}")
    fresh = incoming.select(*[F.col(f.name).cast(f.dataType) for f in schemas.PRICES.fields])
    merge = keyed.upsert_prices if update_if_exists else keyed.add_prices
    return merge_fact(spark, path, schemas.PRICES, fresh, merge, buckets)


def save_indicators(
    spark: SparkSession, path: str, incoming: DataFrame, version: str = "v1.0", buckets: int | None = None,
    written: bool = False,
) -> DataFrame:
    """Upsert the indicator columns that are present and return per-ticker row counts."""
    given = [c for c in schemas.INDICATOR_NAMES if c in incoming.columns]
    fresh = incoming.select(*schemas.KEYS, *given).withColumn("calculated_at", F.current_timestamp())

    def merge(old: DataFrame, new: DataFrame, mark: str) -> DataFrame:
        return keyed.upsert_indicators(old, new, version, mark)

    return merge_fact(spark, path, schemas.INDICATORS, fresh, merge, buckets, written)


def load_prices(
    spark: SparkSession, path: str, tickers: list[str] | DataFrame,
    start: date | str | None = None, end: date | str | None = None, ordered: bool = False,
) -> DataFrame:
    """Seven price columns of the tickers, both range ends inclusive and optional.

    ``ordered`` sorts by ticker and date, which costs a range shuffle; series jobs do not need it.
    """
    rows = _in_months(read_fact(spark, path, schemas.PRICES), start, end)
    found = within(of_tickers(rows, tickers), start, end).select(
        *schemas.KEYS, *schemas.PRICE_VALUE_COLUMNS
    )
    return found.orderBy(*schemas.KEYS) if ordered else found


def load_indicators(
    spark: SparkSession, path: str, tickers: list[str] | DataFrame,
    start: date | str | None = None, end: date | str | None = None, ordered: bool = False,
) -> DataFrame:
    """The 21 indicator columns, with the contract of ``load_prices``."""
    rows = _in_months(read_fact(spark, path, schemas.INDICATORS), start, end)
    found = within(of_tickers(rows, tickers), start, end).select(
        *schemas.KEYS, *schemas.INDICATOR_NAMES
    )
    return found.orderBy(*schemas.KEYS) if ordered else found


def load_tickers(tickers: DataFrame, codes: list[str] | None = None) -> DataFrame:
    """Ticker details; no codes means all tickers."""
    rows = tickers.select(*schemas.TICKERS.fieldNames())
    return rows.where(F.col("ticker_code").isin(codes)) if codes else rows


def read_tickers(spark: SparkSession, path: str) -> DataFrame:
    if not snapshots.exists(spark, path):
        return spark.createDataFrame([], schemas.TICKERS)
    return spark.read.schema(schemas.TICKERS).parquet(path)


def write_tickers(spark: SparkSession, path: str, tickers: DataFrame) -> None:
    """Replace the ticker dimension, staged in the shared folder since it may read itself."""
    materialize(tickers).write.mode("overwrite").parquet(path)


def delete_tickers(spark: SparkSession, removed: DataFrame, tickers_path: str, fact_paths: dict[str, T.StructType]) -> None:
    """Cascade delete from the dimension and from every fact, each in one step; only cells with rows to delete are rewritten."""
    codes = materialize(removed.select("ticker_code").distinct())
    for path, schema in fact_paths.items():
        path = path.rstrip("/")
        before = snapshots.current(spark, path)
        if before is None:
            continue
        stored = snapshots.read(spark, path, schema, before)
        hit = keyed.only_tickers(stored.select("ticker_code", "month", "cell"), codes)
        touched = {(r["month"], r["cell"]) for r in hit.select("month", "cell").distinct().collect()}
        if touched:
            kept = keyed.without_tickers(snapshots.in_cells(stored, touched), codes)
            kept = kept.select(*schema.fieldNames(), F.lit(keyed.KEPT).cast("byte").alias(MARK))
            snapshots.replace_cells(spark, path, _marked(schema), before, before.buckets, touched, kept)
    write_tickers(spark, tickers_path, keyed.without_tickers(read_tickers(spark, tickers_path), codes))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One-row metrics record as a single CSV file with a header."""
    metrics.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)
