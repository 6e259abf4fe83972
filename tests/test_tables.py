"""Keyed merges, stored tables, listings, gaps and profiles."""

from __future__ import annotations

import random
from datetime import date, timedelta, datetime

import pytest
from pyspark.sql import functions as F

from tapeline import schemas
from tapeline.functions.indicators import with_indicators
from tapeline.functions.markets import exchange_code
from tapeline.operators import gaps, keyed, quality, views
from tapeline.session import broadcast_if_small, drop_materialized, materialize
from tapeline.sources import calendars, listings, store
from tapeline.sources.bars import local_day

D1, D2, D3 = date(2024, 1, 2), date(2024, 1, 3), date(2024, 1, 4)
T1, T2 = datetime(2024, 1, 5), datetime(2024, 2, 5)


def prices(spark, rows):
    full = [(t, d, c, c, c, c, 10, c, at) for t, d, c, at in rows]
    return spark.createDataFrame(full, schemas.PRICES)


def closes(df):
    return {(r["ticker_code"], r["date"]): r["close"] for r in df.collect()}


def test_upsert_and_ignore(spark):
    old = prices(spark, [("A", D1, 1.0, T1), ("A", D2, 2.0, T1)])
    new = prices(spark, [("A", D2, 9.0, T2), ("A", D3, float("nan"), T2)])
    merged = keyed.upsert_prices(old, new)
    assert closes(merged) == {("A", D1): 1.0, ("A", D2): 9.0, ("A", D3): None}
    seen = {r["date"]: r["retrieved_at"] for r in merged.collect()}
    assert seen == {D1: T1, D2: T1, D3: T2}
    assert closes(keyed.insert_missing(old, new)) == {("A", D1): 1.0, ("A", D2): 2.0, ("A", D3): None}
    counts = keyed.merge_counts(old, new).first()
    assert (counts["rows_in"], counts["rows_inserted"], counts["rows_changed"]) == (2, 1, 1)


def test_partial_indicators(spark):
    blank = dict.fromkeys(schemas.INDICATOR_NAMES)
    def row(d, **kw):
        values = {**blank, **kw}
        return ("A", d, *[values[c] for c in schemas.INDICATOR_NAMES], "v0", T1)
    old = spark.createDataFrame([row(D1, ma_5=1.0, rsi=50.0), row(D2, ma_5=2.0, rsi=60.0)], schemas.INDICATORS)
    new = spark.createDataFrame([("A", D2, None), ("A", D3, 70.0)], "ticker_code string, date date, rsi double")
    got = {r["date"]: r for r in keyed.upsert_indicators(old, new, "v1").collect()}
    assert (got[D1]["ma_5"], got[D1]["rsi"], got[D1]["calculated_version"]) == (1.0, 50.0, "v0")
    assert (got[D2]["ma_5"], got[D2]["rsi"], got[D2]["calculated_version"]) == (2.0, None, "v0")
    assert (got[D3]["ma_5"], got[D3]["rsi"], got[D3]["calculated_version"]) == (None, 70.0, "v1")


def test_keys_and_ties(spark):
    twice = prices(spark, [("A", D1, 1.0, T1), ("A", D1, 2.0, T2)])
    assert keyed.repeated_keys(twice).count() == 1
    with pytest.raises(ValueError):
        keyed.require_unique(twice)
    assert closes(keyed.latest_per_key(twice, "retrieved_at")) == {("A", D1): 2.0}
    assert closes(keyed.latest_per_key(twice, "retrieved_at", keep="first")) == {("A", D1): 1.0}


def test_tickers(spark):
    dim = spark.createDataFrame([("A.KS", "Old", "KOSPI", "Tech"), ("B", None, "US", None)], schemas.TICKERS)
    codes = spark.createDataFrame([("B",), ("C.T",), ("C.T",)], "ticker_code string")
    added = {r["ticker_code"]: r["market"] for r in keyed.add_tickers(dim, codes).collect()}
    assert added == {"A.KS": "KOSPI", "B": "US", "C.T": "TOKYO"}
    updates = spark.createDataFrame([("A.KS", "New"), ("B", None), ("Z", "Zed")], "ticker_code string, name string")
    got = {r["ticker_code"]: (r["name"], r["sector"]) for r in keyed.update_ticker_details(dim, updates).collect()}
    assert got == {"A.KS": ("New", "Tech"), "B": (None, None)}
    assert [r[0] for r in keyed.changed_tickers(dim, updates).collect()] == ["A.KS"]
    assert store.load_tickers(dim).count() == 2 and store.load_tickers(dim, []).count() == 2
    assert store.load_tickers(dim, ["B", "Q"]).count() == 1


def test_store_round_trip(spark, tmp_path):
    path = str(tmp_path / "prices")
    first = prices(spark, [("A", date(2022, 12, 30), 1.0, T1), ("A", D1, 2.0, T1), ("B", D1, 5.0, T1)])
    counts = {r["ticker_code"]: r["rows_inserted"] for r in store.save_prices(spark, path, first).collect()}
    assert counts == {"A": 2, "B": 1}
    second = prices(spark, [("A", D1, 7.0, T2), ("A", D2, 8.0, T2)])
    changed = store.save_prices(spark, path, second).first()
    assert (changed["rows_in"], changed["rows_inserted"], changed["rows_changed"]) == (2, 1, 1)
    assert closes(store.load_prices(spark, path, ["A"])) == {
        ("A", date(2022, 12, 30)): 1.0, ("A", D1): 7.0, ("A", D2): 8.0,
    }
    store.save_prices(spark, path, prices(spark, [("A", D2, 99.0, T2)]), update_if_exists=False)
    got = store.load_prices(spark, path, ["A", "NONE"], start=D2, end=D2)
    assert closes(got) == {("A", D2): 8.0}
    assert got.columns == ["ticker_code", "date", *schemas.PRICE_VALUE_COLUMNS]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    assert store.load_prices(spark, path, ["NONE"]).isEmpty()
    assert store.load_prices(spark, str(tmp_path / "none"), ["A"]).isEmpty()
    with pytest.raises(ValueError):
        store.save_prices(spark, path, spark.createDataFrame([("A", D1)], "ticker_code string, date date"))


def test_cascade_delete(spark, tmp_path):
    facts, dim = str(tmp_path / "prices"), str(tmp_path / "tickers")
    store.save_prices(spark, facts, prices(spark, [("A", date(2021, 5, 5), 1.0, T1), ("A", D1, 2.0, T1), ("B", D1, 5.0, T1)]))
    store.write_tickers(spark, dim, keyed.add_tickers(store.read_tickers(spark, dim), store.load_prices(spark, facts, ["A", "B"])))
    gone = spark.createDataFrame([("A",)], "ticker_code string")
    store.delete_tickers(spark, gone, dim, {facts: schemas.PRICES})
    assert closes(store.read_fact(spark, facts, schemas.PRICES)) == {("B", D1): 5.0}
    assert [r["ticker_code"] for r in store.read_tickers(spark, dim).collect()] == ["B"]


def sessions(spark, days, exchange="XKRX"):
    return spark.createDataFrame([(exchange, d) for d in days], schemas.SESSIONS)


def test_gap_fill(spark, make_bars):
    days = [date(2020, 1, d) for d in (1, 2, 3, 4)]
    bars = make_bars({"005930.KS": [100.0, None, None, 102.0], "02943.UW": [1.0, 2.0]}).where("close is not null")
    got = gaps.fill_gaps(bars, sessions(spark, days)).orderBy("date").collect()
    assert [r["date"] for r in got] == days and [r["close"] for r in got] == [100.0, None, None, 102.0]
    assert got[1]["volume"] is None and got[0].asDict().keys() == set(bars.columns)
    assert [r["date"] for r in gaps.missing_sessions(bars, sessions(spark, days)).orderBy("date").collect()] == days[1:3]
    # A bar on a closed day stays unless asked otherwise; sessions outside the span add nothing.
    some = sessions(spark, [days[1], days[3], date(2020, 1, 9)])
    kept = gaps.fill_gaps(bars, some).orderBy("date")
    assert [r["date"] for r in kept.collect()] == [days[0], days[1], days[3]]
    dropped = gaps.fill_gaps(bars, some, drop_non_sessions=True).orderBy("date")
    assert [r["date"] for r in dropped.collect()] == [days[1], days[3]]
    zoned = gaps.fill_gaps(bars.withColumn("tz", F.lit("Asia/Seoul")), sessions(spark, days))
    assert [r["tz"] for r in zoned.collect()] == ["Asia/Seoul"] * 4
    with pytest.raises(Exception, match="repeated day"):
        gaps.fill_gaps(bars.unionByName(bars), some).collect()


def test_gaps_by_ordinals_match_a_plain_loop(spark):
    rng = random.Random(9)
    first = date(2021, 1, 1)
    days = [first + timedelta(days=i) for i in range(120)]
    open_days = {e: sorted(rng.sample(days, rng.choice([1, 5, 60, 119]))) for e in ("XKRX", "XTKS", "XHKG")}
    kinds = {".KS": "XKRX", ".T": "XTKS", ".HK": "XHKG", "": "XNYS"}
    held = {f"{i:03d}{s}": sorted(rng.sample(days, rng.randint(1, 40))) for i in range(12) for s in kinds}
    rows = [(c, d, float(i)) for c, own in held.items() for i, d in enumerate(own)] + [("A.UW", first, 1.0)]
    bars = spark.createDataFrame(rows, "ticker_code string, date date, close double")
    table = spark.createDataFrame([(e, d) for e, own in open_days.items() for d in own] * 2 + [("XXXX", first), ("XKRX", None)], "exchange string, date date")
    missing, filled, only = set(), set(), set()
    for code, own in held.items():
        sessions_ = open_days.get(kinds[code.lstrip("0123456789")], [])
        gone = {d for d in sessions_ if own[0] < d < own[-1] and d not in own}
        missing |= {(code, d) for d in gone}
        filled |= {(code, d) for d in gone | set(own)}
        only |= {(code, d) for d in gone | (set(own) & set(sessions_))}
    keys = lambda df: sorted((r["ticker_code"], r["date"]) for r in df.collect())
    assert keys(gaps.missing_sessions(bars, table)) == sorted(missing)
    got = gaps.fill_gaps(bars, table)
    assert keys(got) == sorted(filled) and got.where("close IS NOT NULL").count() == len(rows) - 1
    assert keys(gaps.fill_gaps(bars, table, drop_non_sessions=True)) == sorted(only)
    # Only missing sessions become rows: no calendar day is generated and looked up.
    (generate,) = [x for x in gaps.fill_gaps(bars, table)._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate" in x]
    assert "sequence(" not in generate and "_missing" in generate


def test_calendar(spark, tmp_path):
    open_days = calendars.open_sessions(sessions(spark, [D1, D2]), calendars.holiday_table(spark, {"XKRX": [str(D2)], "XNYS": [], "XNAS": None}))
    assert [r["date"] for r in open_days.collect()] == [D1]
    assert calendars.holiday_table(spark, None).isEmpty()
    assert calendars.read_holidays(spark, str(tmp_path / "no.csv")).isEmpty()
    assert calendars.holiday_table(spark, calendars.EXTRA_HOLIDAYS).count() == 2


def test_coverage(spark, make_bars):
    bars = make_bars({"A.KS": [1.0, 2.0, 3.0], "B.KS": [1.0]})
    days = sessions(spark, [date(2020, 1, d) for d in (1, 2, 3)])
    short = gaps.short_coverage(bars, days, "2020-01-01", "2020-01-31")
    assert [r["ticker_code"] for r in short.collect()] == ["B.KS"]


LISTING = "exchange string, pos long, symbol string, market string"


def test_listings(spark):
    rows = [
        ("KRX", 0, " 005930 ", "KOSPI"), ("KRX", 1, "035720", "kosdaq global"), ("KRX", 2, "nan", "KOSPI"),
        ("KRX", 3, " ", "KOSPI"), ("KRX", 4, None, "KOSPI"), ("KRX", 5, "000001", "KONEX"),
        ("NYSE", 0, " IBM", None), ("NYSE", 1, None, None), ("AMEX", 0, "IBM", None), ("AMEX", 1, "XYZ", None),
    ]
    listing = spark.createDataFrame(rows, LISTING)
    krx = listing.where("exchange = 'KRX'")
    codes = lambda df: [r["ticker_code"] for r in df.orderBy("pos").collect()]
    assert codes(listings.korean_symbols(krx)) == ["005930.KS", "035720.KQ", "000001"]
    assert codes(listings.korean_symbols(krx, add_suffix=False)) == ["005930", "035720", "000001"]
    assert codes(listings.plain_symbols(listing.where("exchange = 'NYSE'"))) == ["IBM"]
    everything = listings.universe(listing).orderBy("rank", "pos")
    assert [r["ticker_code"] for r in everything.collect()] == ["005930.KS", "035720.KQ", "IBM", "XYZ"]
    some = listings.universe(listing, ["amex", "nasdaq", "Kospi", "mars"]).orderBy("rank", "pos")
    assert [r["ticker_code"] for r in some.collect()] == ["IBM", "XYZ", "005930.KS"]
    assert [r["ticker_code"] for r in listings.first_tickers(listings.universe(listing), 1).collect()] == ["005930.KS"]
    assert listings.universe(listing, ["NASDAQ"]).isEmpty()
    assert listings.plain_symbols(spark.createDataFrame([(1,)], "pos long")).isEmpty()
    bare = spark.createDataFrame([("1", "kospi", 0), ("2", "KOSDAQ", 1)], "code string, market string, pos long")
    assert codes(listings.codes_with_market_suffix(bare)) == ["1.KS", "2.KQ"]


def test_pick_universe(spark):
    picked = listings.pick_universe(spark, ["Z", "A", "Z", "", "B", "A"], None, None).orderBy("pos")
    assert [r["ticker_code"] for r in picked.collect()] == ["Z", "A", "B"]
    for tickers, exchanges in ((["A"], ["KRX"]), (None, None)):
        with pytest.raises(ValueError):
            listings.pick_universe(spark, tickers, exchanges, None)


def test_views(spark, make_bars):
    bars = make_bars({"A.KS": [1.0, 2.0], "B": [3.0]})
    dim = spark.createDataFrame([("A.KS", "n", "KOSPI", None)], schemas.TICKERS)
    ind = spark.createDataFrame([("A.KS", date(2020, 1, 2), 5.0)], "ticker_code string, date date, ma_20 double")
    view = views.price_indicator_view(bars, dim, ind, "A.KS").collect()
    assert [(r["close"], r["ma_20"]) for r in view] == [(1.0, None), (2.0, 5.0)]
    assert views.prices_with_indicators(bars, ind).columns.count("close") == 1
    signals = spark.createDataFrame([("A.KS", date(2020, 1, 1), 1)], schemas.SIGNALS)
    joined = views.bars_with_signals(bars, signals).orderBy("date").collect()
    assert [(r["ticker_code"], r["signal"]) for r in joined] == [("A.KS", 1), ("A.KS", 0)]
    assert [r[0] for r in views.without_data(bars, ind).distinct().collect()] == ["B"]


def test_profiles(spark, make_bars):
    bars = make_bars({"A": [1.0, None], "B": [2.0]})
    rate = quality.success_rate(bars, bars.where("ticker_code = 'A'")).first()
    assert (rate["requested"], rate["obtained"], rate["success_rate"]) == (2, 1, 50.0)
    profile = {r["ticker_code"]: (r["null_cells"], r["cells"]) for r in quality.null_profile(bars).collect()}
    assert profile == {"A": (6, 16), "B": (0, 8)}
    assert quality.null_counts(bars).first()["close"] == 1
    stages = quality.stage_counts({"a": bars, "b": bars.where("close > 1")})
    assert quality.stage_totals(stages).first().asDict() == {"a": 3, "b": 1}
    with pytest.raises(ValueError):
        quality.require_rows(bars.limit(0))


@pytest.mark.parametrize("stretch", [1, 2, 3, 65_536])
def test_series_check(spark, stretch):
    days = [1, 3, 2, 2, 5, 4]
    rows = spark.createDataFrame([("A", date(2020, 1, d), i) for i, d in enumerate(days)], "ticker_code string, date date, at long")
    r = quality.series_check(rows, "at", stretch).first()
    assert (r["n_rows"], r["n_days"], r["repeated"], r["out_of_order"]) == (6, 5, 1, 2)
    with pytest.raises(ValueError):
        quality.series_check(rows.withColumn("date", F.col("date").cast("string")), "at")


def test_local_day(spark):
    ts = F.lit("2020-01-01 16:00:00").cast("timestamp")
    days = spark.range(1).select(local_day(ts, "Asia/Seoul"), local_day(ts, "America/New_York")).first()
    assert days == (date(2020, 1, 2), date(2020, 1, 1))


def test_materialized_tables_go(spark):
    kept = materialize(spark.range(3))
    assert kept.count() == 3
    drop_materialized(spark)
    with pytest.raises(Exception):
        spark.read.parquet(kept.inputFiles()[0])


def test_broadcast_only_when_small(spark):
    small, large = spark.range(5), spark.range(1000)
    plan = lambda n: large.join(broadcast_if_small(small, n), "id")._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(5) and "broadcast" not in plan(4)


def test_listing_scan(spark, tmp_path):
    path = str(tmp_path / "listing")
    spark.createDataFrame([("1", "KOSPI")], "Symbol string, Market string").write.option("header", True).csv(path)
    assert listings.read_listing(spark, path).columns == ["symbol", "market"]


def test_exchange_for_nulls(spark):
    df = spark.createDataFrame([(None,)], "c string")
    assert df.select(exchange_code(F.col("c"))).first()[0] is None
