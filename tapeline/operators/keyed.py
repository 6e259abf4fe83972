"""Keyed merges of incoming rows into a table: upsert, ignore, delete, key checks.

Each takes and returns DataFrames; ``tapeline.sources.store`` writes the results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions.markets import infer_market
from tapeline.functions.numeric import nan_to_null
from tapeline.schemas import INDICATOR_NAMES, KEYS, PRICE_VALUE_COLUMNS
from tapeline.session import broadcast_if_small


def repeated_keys(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Keys that occur more than once, with their count; empty for a valid table."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def require_unique(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """``df`` unchanged, or ValueError when a key repeats."""
    sample = repeated_keys(df, keys).limit(5).collect()
    if sample:
        raise ValueError(f"repeated keys {[tuple(r) for r in sample]}")
    return df


def latest_per_key(df: DataFrame, tie_break: str, keys: list[str] = KEYS, keep: str = "last") -> DataFrame:
    """One row per key: the last (for updates) or first (for ignores) by ``tie_break``."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if keep == "last" else F.min_by
    chosen = pick(F.struct(*rest), tie_break).alias("_row")
    return df.groupBy(*keys).agg(chosen).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


# What a merge did to a row: its key repeats in the batch, or it was left alone, added, changed, or written with the same values.
REPEATED, KEPT, ADDED, CHANGED, SAME = -1, 0, 1, 2, 3


def _merge(
    existing: DataFrame, incoming: DataFrame, keys: list[str], merged: dict[str, tuple[Column, Column]],
    mark: str | None = None, values: list[str] | None = None,
) -> DataFrame:
    """Full outer join; ``merged`` maps each column to its values with and without an incoming row.

    ``mark`` names a further column that says what happened to the row, judged by ``values``; repeated keys
    of the batch are then found in the order that the join needs anyway.
    """
    new = incoming.withColumn("_hit", F.lit(True))
    if mark:
        w = Window.partitionBy(keys[0]).orderBy(*keys[1:])
        new = new.withColumn("_again", reduce(Column.__and__, [F.lag(k).over(w) == F.col(k) for k in keys[1:]]))
    old, new = existing.alias("old"), new.alias("new")
    same = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys]
    joined = old.join(new, same, "full_outer")
    hit = F.col("new._hit")
    return joined.select(
        *[F.coalesce(f"new.{k}", f"old.{k}").alias(k) for k in keys],
        *[F.when(hit, a).otherwise(b).alias(c) for c, (a, b) in merged.items()],
        *([_outcome(keys, values or []).alias(mark)] if mark else []),
    )


def _outcome(keys: list[str], values: list[str]) -> Column:
    alike = reduce(Column.__and__, [F.col(f"new.{c}").eqNullSafe(F.col(f"old.{c}")) for c in values], F.lit(True))
    return (
        F.when(F.col("new._again"), REPEATED).when(F.col("new._hit").isNull(), KEPT)
        .when(F.col(f"old.{keys[0]}").isNull(), ADDED).when(~alike, CHANGED).otherwise(SAME).cast("byte")
    )


def upsert_prices(existing: DataFrame, incoming: DataFrame, mark: str | None = None) -> DataFrame:
    """Incoming bars replace the value columns; ``retrieved_at`` of a stored row stays."""
    fresh = nan_to_null(incoming.select(*KEYS, *PRICE_VALUE_COLUMNS, "retrieved_at"))
    merged = {c: (F.col(f"new.{c}"), F.col(f"old.{c}")) for c in PRICE_VALUE_COLUMNS}
    first_seen = F.coalesce("old.retrieved_at", "new.retrieved_at")
    merged["retrieved_at"] = (first_seen, F.col("old.retrieved_at"))
    return _merge(existing, fresh, KEYS, merged, mark, PRICE_VALUE_COLUMNS)


def insert_missing(existing: DataFrame, incoming: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Add only rows whose key is new; stored rows win."""
    fresh = nan_to_null(incoming.select(*existing.columns))
    return existing.unionByName(fresh.join(existing.select(*keys), keys, "left_anti"))


def add_prices(existing: DataFrame, incoming: DataFrame, mark: str | None = None) -> DataFrame:
    """``insert_missing`` of bars in the same join as an upsert: stored rows win."""
    fresh = nan_to_null(incoming.select(*KEYS, *PRICE_VALUE_COLUMNS, "retrieved_at"))
    is_new = F.col("old.ticker_code").isNull()
    merged = {
        c: (F.when(is_new, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")), F.col(f"old.{c}"))
        for c in (*PRICE_VALUE_COLUMNS, "retrieved_at")
    }
    return _merge(existing, fresh, KEYS, merged, mark)


def upsert_indicators(
    existing: DataFrame, incoming: DataFrame, version: str = "v1.0", mark: str | None = None
) -> DataFrame:
    """Overwrite just the indicator columns that ``incoming`` has.

    Other columns keep their stored value, and are NULL on new keys. A NULL that is
    present overwrites. ``calculated_version`` and ``calculated_at`` are set on insert.
    """
    given = [c for c in INDICATOR_NAMES if c in incoming.columns]
    stamped = "calculated_at" in incoming.columns
    fresh = nan_to_null(incoming.select(*KEYS, *given, *(["calculated_at"] if stamped else [])))
    is_new = F.col("old.ticker_code").isNull()
    merged = {}
    for c in INDICATOR_NAMES:
        before = F.col(f"old.{c}")
        merged[c] = (F.col(f"new.{c}") if c in given else before, before)
    at = F.col("new.calculated_at") if stamped else F.current_timestamp()
    for c, value in (("calculated_version", F.lit(version)), ("calculated_at", at)):
        before = F.col(f"old.{c}")
        merged[c] = (F.when(is_new, value).otherwise(before), before)
    return _merge(existing, fresh, KEYS, merged, mark, given)


def add_tickers(tickers: DataFrame, codes: DataFrame, market: str | None = None) -> DataFrame:
    """Get-or-create: codes not yet in the dimension are added with their market."""
    fresh = codes.select("ticker_code").distinct().join(tickers, "ticker_code", "left_anti")
    named = F.lit(market) if market else infer_market(F.col("ticker_code"))
    rows = fresh.select(
        "ticker_code", F.lit(None).cast("string").alias("name"),
        named.alias("market"), F.lit(None).cast("string").alias("sector"),
    )
    return tickers.unionByName(rows)


def update_ticker_details(tickers: DataFrame, updates: DataFrame) -> DataFrame:
    """Set ``name`` and/or ``sector`` of tickers that exist; other codes are ignored.

    Only columns that ``updates`` has are touched, and a NULL there is written.
    """
    given = [c for c in ("name", "sector") if c in updates.columns]
    new = updates.select("ticker_code", *given).withColumn("_hit", F.lit(True)).alias("new")
    joined = tickers.alias("old").join(new, "ticker_code", "left")
    changed = {
        c: F.when(F.col("new._hit"), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")) for c in given
    }
    return joined.select(*[
        changed[c].alias(c) if c in changed else
        (F.col(c) if c == "ticker_code" else F.col(f"old.{c}"))
        for c in tickers.columns
    ])


def changed_tickers(tickers: DataFrame, updates: DataFrame) -> DataFrame:
    """Codes whose ``name`` or ``sector`` an update really changes."""
    given = [c for c in ("name", "sector") if c in updates.columns]
    new = updates.select("ticker_code", *[F.col(c).alias(f"_new_{c}") for c in given])
    differs = [~F.col(c).eqNullSafe(F.col(f"_new_{c}")) for c in given]
    test = F.lit(False)
    for d in differs:
        test = test | d
    return tickers.join(new, "ticker_code").where(test).select("ticker_code")


def without_tickers(df: DataFrame, removed: DataFrame) -> DataFrame:
    """Cascade delete: drop every row of the removed tickers from a dimension or fact."""
    gone = broadcast_if_small(removed.select("ticker_code"))
    return df.join(gone, "ticker_code", "left_anti")


def only_tickers(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of the wanted tickers."""
    return df.join(broadcast_if_small(wanted.select("ticker_code")), "ticker_code", "left_semi")


def merge_counts(existing: DataFrame, incoming: DataFrame, values: list[str] = PRICE_VALUE_COLUMNS) -> DataFrame:
    """Per ticker: incoming rows, rows inserted, and stored rows whose values change."""
    old = existing.select(*KEYS, F.struct(*values).alias("_old"), F.lit(True).alias("_stored"))
    new = nan_to_null(incoming).select(*KEYS, F.struct(*values).alias("_new"))
    both = new.join(old, KEYS, "left")
    stored = F.col("_stored").isNotNull()
    return both.groupBy("ticker_code").agg(
        F.count("*").alias("rows_in"),
        F.count_if(~stored).alias("rows_inserted"),
        F.count_if(stored & ~F.col("_new").eqNullSafe(F.col("_old"))).alias("rows_changed"),
    )


def counts_by_mark(merged: DataFrame, mark: str) -> DataFrame:
    """``merge_counts`` of rows that a merge has marked."""
    return merged.where(F.col(mark) != KEPT).groupBy("ticker_code").agg(
        F.count("*").alias("rows_in"),
        F.count_if(F.col(mark) == ADDED).alias("rows_inserted"),
        F.count_if(F.col(mark) == CHANGED).alias("rows_changed"),
    )
