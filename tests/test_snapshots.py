"""Stored facts as snapshots of cells: what a write touches, what a failure leaves, what needs no exchange."""

from __future__ import annotations

import os
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tapeline import schemas
from tapeline.functions.indicators import with_indicators
from tapeline.operators import keyed
from tapeline.plans.indicators import refresh_indicators
from tapeline.plans.prices import Paths
from tapeline.sources import snapshots, store

AT = datetime(2024, 1, 1)
CODES = [f"{i:06d}.KS" for i in range(40)]


def bars(spark, days, codes=CODES, close=1.0):
    rows = [(c, d, close, close, close, close + i, 100, close + i, AT) for i, c in enumerate(codes) for d in days]
    return spark.createDataFrame(rows, schemas.PRICES)


def files(path):
    """Data files by cell: path below ``data`` of every parquet file."""
    return {
        os.path.relpath(os.path.join(folder, f), f"{path}/data")
        for folder, _, found in os.walk(f"{path}/data") for f in found if f.endswith(".parquet") and not f.startswith(".")
    }


def cells(spark, path):
    return snapshots.current(spark, path).cells


def rows_of(df):
    return {(r["ticker_code"], r["date"]): r["close"] for r in df.collect()}


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "prices")
    days = [date(2023, 1, 2), date(2023, 2, 1), date(2023, 3, 1)]
    store.save_prices(spark, path, bars(spark, days), buckets=4)
    return path


def test_a_new_day_rewrites_one_month(spark, stored):
    before, old_files = cells(spark, stored), files(stored)
    assert len(before) == 12 and len(old_files) == 12
    counts = store.save_prices(spark, stored, bars(spark, [date(2023, 2, 2)]))
    assert counts.count() == 40 and counts.where("rows_inserted != 1 OR rows_changed != 0").count() == 0
    after = cells(spark, stored)
    changed = {c for c in after if after[c] != before.get(c)}
    assert changed == {c for c in before if c[0] == "2023-02"}
    new = files(stored) - old_files
    assert old_files <= files(stored) and len(new) == 4 and all("month=2023-02" in f for f in new)
    assert store.read_fact(spark, stored, schemas.PRICES).count() == 160


def test_one_ticker_rewrites_its_own_bucket(spark, stored):
    before = cells(spark, stored)
    store.save_prices(spark, stored, bars(spark, [date(2023, 1, 2)], CODES[:1], 9.0))
    after = cells(spark, stored)
    (changed,) = {c for c in after if after[c] != before[c]}
    (bucket,) = spark.createDataFrame([(CODES[0],)], "c string").select(snapshots.cell_of(F.col("c"), 4)).first()
    assert changed == ("2023-01", bucket)
    assert rows_of(store.load_prices(spark, stored, CODES))[CODES[0], date(2023, 1, 2)] == 9.0


def test_a_failed_merge_leaves_the_old_state(spark, stored, monkeypatch):
    old = rows_of(store.load_prices(spark, stored, CODES))
    batch = bars(spark, [date(2023, 1, 2), date(2023, 2, 1), date(2023, 4, 3)], close=5.0)
    late = F.when(F.col("date") == date(2023, 4, 3), F.raise_error(F.lit("bad bar")).cast("double")).otherwise(F.col("close"))
    with pytest.raises(Exception, match="bad bar"):
        store.save_prices(spark, stored, batch.withColumn("close", late))
    assert rows_of(store.load_prices(spark, stored, CODES)) == old

    def stop(*_):
        raise RuntimeError("stopped before the switch")

    with monkeypatch.context() as m:
        m.setattr(snapshots, "_switch", stop)
        with pytest.raises(RuntimeError):
            store.save_prices(spark, stored, batch)
        with pytest.raises(RuntimeError):
            store.delete_tickers(spark, batch.limit(1), stored + "-dim", {stored: schemas.PRICES})
    assert rows_of(store.load_prices(spark, stored, CODES)) == old
    store.save_prices(spark, stored, batch)
    assert len(rows_of(store.load_prices(spark, stored, CODES))) == 160


def test_repeated_keys_are_refused(spark, stored):
    old = cells(spark, stored)
    twice = bars(spark, [date(2023, 2, 1), date(2023, 5, 1)]).unionByName(bars(spark, [date(2023, 5, 1)], CODES[:2], 3.0))
    with pytest.raises(ValueError, match="repeated keys"):
        store.save_prices(spark, stored, twice)
    assert cells(spark, stored) == old


def test_two_writers_do_not_overwrite_each_other(spark, stored, monkeypatch):
    real, inner = snapshots._write, bars(spark, [date(2023, 6, 1)], CODES[:3])

    def meanwhile(*args):
        monkeypatch.setattr(snapshots, "_write", real)
        store.save_prices(spark, stored, inner)
        return real(*args)

    monkeypatch.setattr(snapshots, "_write", meanwhile)
    with pytest.raises(RuntimeError, match="another writer"):
        store.save_prices(spark, stored, bars(spark, [date(2023, 7, 3)]))
    found = rows_of(store.load_prices(spark, stored, CODES))
    assert (CODES[0], date(2023, 6, 1)) in found and (CODES[0], date(2023, 7, 3)) not in found


def test_readers_keep_their_snapshot_and_vacuum_clears_the_rest(spark, stored):
    reader = store.load_prices(spark, stored, CODES)
    old = rows_of(reader)
    store.save_prices(spark, stored, bars(spark, [date(2023, 2, 1)], close=7.0))
    assert rows_of(reader) == old
    snapshots.vacuum(spark, stored)
    new = rows_of(store.load_prices(spark, stored, CODES))
    assert len(new) == 120 and new[CODES[0], date(2023, 2, 1)] == 7.0
    assert len(os.listdir(f"{stored}/snapshots")) == 1


def test_delete_rewrites_only_cells_with_such_rows(spark, stored, tmp_path):
    before = cells(spark, stored)
    gone = spark.createDataFrame([(CODES[3],), ("none",)], "ticker_code string")
    store.delete_tickers(spark, gone, str(tmp_path / "dim"), {stored: schemas.PRICES})
    after = cells(spark, stored)
    assert len({c[1] for c in after if after[c] != before[c]}) == 1
    assert {k[0] for k in rows_of(store.load_prices(spark, stored, CODES))} == set(CODES) - {CODES[3]}
    everyone = spark.createDataFrame([(c,) for c in CODES], "ticker_code string")
    store.delete_tickers(spark, everyone, str(tmp_path / "dim"), {stored: schemas.PRICES})
    assert cells(spark, stored) == {} and store.read_fact(spark, stored, schemas.PRICES).isEmpty()


def test_months_and_buckets_are_pruned(spark, stored):
    found = store.load_prices(spark, stored, CODES[:1], "2023-02-01", "2023-02-28")
    assert "PartitionFilters: [isnotnull(month" in plan_of(found)
    assert "SelectedBucketsCount: 1 out of 4" in plan_of(with_indicators(found, ["bb_mid"]))
    assert found.count() == 1


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_exchange_from_stored_bars_to_indicators_and_merge(spark, tmp_path):
    days = [date(2023, 1, 1) + timedelta(days=i) for i in range(60)]
    paths = Paths(tickers=str(tmp_path / "t"), prices=str(tmp_path / "p"), indicators=str(tmp_path / "i"))
    store.save_prices(spark, paths.prices, bars(spark, days), buckets=4)
    listed = spark.createDataFrame([(c,) for c in CODES], "ticker_code string")
    prices = store.load_prices(spark, paths.prices, listed, days[0], days[-1])
    computed = with_indicators(prices, ["ma_5", "rsi", "bb_mid"])
    assert "Exchange hash" not in plan_of(computed)
    refresh_indicators(spark, paths, listed, days[30], days[-1], ["ma_5", "rsi", "bb_mid"])
    stored = store.read_fact(spark, paths.indicators, schemas.INDICATORS).drop("month", "cell")
    batch = snapshots.by_ticker(computed.select("ticker_code", "date", "ma_5"), 4, clustered=True)
    with snapshots.joined_in_place(spark):
        merged = keyed.upsert_indicators(stored, batch, mark="m")
        assert "Exchange" not in plan_of(merged)
    got = store.load_indicators(spark, paths.indicators, listed, days[40], days[40]).select("ticker_code", "ma_5", "rsi", "bb_mid")
    want = computed.where(F.col("date") == days[40]).select("ticker_code", "ma_5", "rsi", "bb_mid")
    assert got.exceptAll(want).isEmpty() and got.count() == 40
    assert snapshots.current(spark, paths.indicators).buckets == 4


def test_marks_tell_what_a_merge_did(spark):
    old = bars(spark, [date(2023, 1, 2), date(2023, 1, 3)], CODES[:2])
    new = bars(spark, [date(2023, 1, 3)], CODES[:1], 8.0).unionByName(bars(spark, [date(2023, 1, 3)], CODES[1:2], 1.0).withColumn("close", F.lit(2.0)).withColumn("adj_close", F.lit(2.0)))
    new = new.unionByName(bars(spark, [date(2023, 1, 4)], CODES[:1]))
    marked = {(r["ticker_code"], r["date"].day): r["m"] for r in keyed.upsert_prices(old, new, "m").collect()}
    a, b = CODES[:2]
    assert marked == {(a, 2): keyed.KEPT, (b, 2): keyed.KEPT, (a, 3): keyed.CHANGED, (b, 3): keyed.SAME, (a, 4): keyed.ADDED}
    added = keyed.add_prices(old, new, "m").where(F.col("m") != keyed.KEPT)
    assert {(r["ticker_code"], r["date"].day): r["m"] for r in added.collect()} == {(a, 3): keyed.SAME, (b, 3): keyed.SAME, (a, 4): keyed.ADDED}
    assert rows_of(keyed.add_prices(old, new)) == rows_of(keyed.insert_missing(old, new))


def test_buckets_grow_with_the_tickers(spark, tmp_path):
    counts = [snapshots.bucket_count(n) for n in (0, 1, 1000, 1025, 10_000, 1_000_000)]
    assert counts == [4, 4, 4, 8, 64, 4096]
    store.save_prices(spark, str(tmp_path / "p"), bars(spark, [date(2023, 1, 2)]))
    assert snapshots.current(spark, str(tmp_path / "p")).buckets == 4


def test_new_tables_get_cells_that_fill(spark, tmp_path):
    """Sixty thousand tickers with six bars a month are no reason for cells of a few rows."""
    assert snapshots.buckets_for(60_000, 32_000_000, 2_500) == 32
    assert snapshots.buckets_for(60_000, 60_000, 1) == 128  # one day of daily bars
    assert snapshots.buckets_for(1_000_000, 20_000_000, 1) == 4096 and snapshots.buckets_for(0, 0, 0) == 4
    codes = F.lpad(F.col("id").cast("string"), 6, "0")
    value = F.lit(1.0)
    thin = spark.range(2000).select(
        codes.alias("ticker_code"), F.date_add(F.lit("2023-01-01").cast("date"), (F.col("id") % 50).cast("int")).alias("date"),
        *[value.alias(c) for c in ("open", "high", "low", "close", "adj_close")], F.lit(1).cast("long").alias("volume"),
    )
    store.save_prices(spark, str(tmp_path / "p"), thin)
    now = snapshots.current(spark, str(tmp_path / "p"))
    assert now.buckets == 4 and len(now.cells) == 8
    assert store.read_fact(spark, str(tmp_path / "p"), schemas.PRICES).count() == 2000
