"""The registered queries: every operator run over the given tables.

Published numbers are rounded to four decimals.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeline import schemas
from tapeline.functions import indicators as ind
from tapeline.functions.markets import exchange_code, infer_market
from tapeline.functions.numeric import nan_to_null, rounded, to_double
from tapeline.functions.periods import period_range
from tapeline.operators import equity, gaps, keyed, labels, learn, positions, quality, timesplit, views
from tapeline.plans import evaluation, training
from tapeline.plans.indicators import IndicatorRun, full_table, indicator_version_counts, refresh_indicators, trimmed_indicators
from tapeline.plans.prices import Paths, fetched_bars
from tapeline.session import materialize, new_folder
from tapeline.sources import bars as barsrc
from tapeline.sources import calendars, listings, store
from tapeline.sources import market_tables as market

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

# Dates of the range queries, inside the ship dates of the tables.
RANGE_START, RANGE_END = date(1998, 1, 1), date(1999, 12, 31)
OLD_END, NEW_START = date(2000, 6, 30), date(1999, 1, 1)
NOW = date(2001, 6, 30)
HOLIDAYS = {"XKRX": ["1999-01-04", "1999-05-05", "2000-02-04"], "XNYS": ["1999-07-05"], "XNAS": []}
RULES = evaluation.DEFAULT_RULES
TAKE_RULES = positions.Rules(10, False, 0.05, True, 0.10, 0.02)
ACCOUNT = positions.Account()


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


# Digits of the columns that hold cash; totals in whole units, means to the cent.
PLACES = {
    "value": 0, "peak": 0, "final_value": 0, "initial_value": 0,
    "avg_trade_pnl": 2, "avg_winning_pnl": 2, "avg_losing_pnl": 2,
}


def published(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round the double columns and drop the sign of zero."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    places = {c: PLACES.get(c, digits) for c in doubles}
    return df.withColumns({c: rounded(F.col(c), n) for c, n in places.items()}) if doubles else df


def _bars(spark: SparkSession, d: str) -> DataFrame:
    return market.daily_bars(spark, d)


def _indicators(spark: SparkSession, d: str, names: list[str] | None = None) -> DataFrame:
    return ind.with_indicators(market.series_bars(spark, d), names)


def _only(df: DataFrame, names: list[str]) -> DataFrame:
    return published(df.select("ticker_code", "date", *names))


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    holidays = calendars.holiday_table(spark, HOLIDAYS)
    return calendars.open_sessions(market.sessions(spark, d), F.broadcast(holidays))


def _rule_table(spark: SparkSession, d: str) -> DataFrame:
    """Bars with the crossing rule as signal: 1 where the fast average is above the slow one."""
    table = _indicators(spark, d, ["ma_5", "ma_20"])
    above = rounded(F.col("ma_5")) > rounded(F.col("ma_20"))
    return table.withColumn("signal", above.cast("int"))


def _closes(spark: SparkSession, d: str) -> DataFrame:
    """Written once: position sizes and curves both read it."""
    return materialize(_bars(spark, d).select("ticker_code", "date", "close"))


def _filled_rule(spark: SparkSession, d: str) -> DataFrame:
    return _rule_table(spark, d).fillna({"signal": 0}).select("ticker_code", "date", "close", "signal")


def _signalled(spark: SparkSession, d: str) -> DataFrame:
    """Written once: sizes, folds and curves then read the narrow bars instead of the ticks."""
    return materialize(_filled_rule(spark, d))


# ---------------------------------------------------------------- scans and sources

@query
def bars_daily(spark, d):
    return published(_bars(spark, d))


@query
def bars_weekly(spark, d):
    return published(market.trade_bars(spark, d, "1wk"))


@query
def bars_monthly(spark, d):
    return published(market.trade_bars(spark, d, "1mo"))


@query
def bars_rolled_up(spark, d):
    return published(barsrc.rollup_bars(_bars(spark, d), "1wk"))


@query
def event_bars(spark, d):
    return published(barsrc.resample_ticks(market.event_ticks(spark, d)))


@query
def normalized_columns(spark, d):
    raw = market.read_table(spark, d, "orders").select(
        F.col("o_orderkey").alias(" Order Key"), F.col("o_orderstatus").alias("Order Status "),
        F.col("o_totalprice").alias("TOTAL Price"),
    )
    return published(barsrc.normalize_columns(raw))


@query
def bar_scan(spark, d):
    korean = market.tickers(spark, d).where(F.col("market").isin("KOSPI", "KOSDAQ"))
    return published(barsrc.scan_bars(_bars(spark, d), korean, str(RANGE_START), str(RANGE_END)))


@query
def price_range_scan(spark, d):
    rows = barsrc.within(_bars(spark, d), RANGE_START, RANGE_END)
    listed = market.tickers(spark, d).where(F.col("market") != "UNKNOWN")
    return published(barsrc.of_tickers(rows, listed))


@query
def indicator_range_scan(spark, d):
    rows = barsrc.within(_indicators(spark, d, ["ma_20", "rsi", "obv"]), RANGE_START, None)
    return _only(rows, ["ma_20", "rsi", "obv"])


@query
def period_scan(spark, d):
    return published(barsrc.within(_bars(spark, d), *period_range("18mo", NOW)))


@query
def ticker_metadata(spark, d):
    return store.load_tickers(market.tickers(spark, d))


@query
def listing_scan(spark, d):
    return market.listing(spark, d)


@query
def local_days(spark, d):
    """Events per trading day in an exchange's own time zone."""
    ticks = market.event_ticks(spark, d, sequence=False).select(barsrc.local_day(F.col("ts"), "Asia/Seoul").alias("date"))
    return ticks.groupBy("date").agg(F.count("*").alias("n_rows"))


@query
def bar_file(spark, d):
    """The bars written as a CSV file and scanned again."""
    path = new_folder(spark)
    fetched = F.lit("2024-06-01").cast("timestamp").alias("retrieved_at")
    _bars(spark, d).select(*schemas.KEYS, *schemas.PRICE_VALUE_COLUMNS, fetched).write.option("header", "true").csv(path)
    return published(barsrc.read_bars(spark, path, "csv").drop("retrieved_at"))


@query
def listing_file(spark, d):
    """Korean symbols of a listing that is read from a file."""
    path = new_folder(spark)
    rows = market.listing(spark, d).where(F.col("exchange") == "KRX")
    rows.select(F.col("pos"), F.col("symbol").alias("Symbol"), F.col("market").alias("Market")).write.option("header", "true").csv(path)
    read = listings.read_listing(spark, path).withColumn("pos", F.col("pos").cast("long"))
    return listings.korean_symbols(read)


@query
def holiday_file(spark, d):
    """Holidays read from a file that are sessions of the tables."""
    path = new_folder(spark)
    calendars.holiday_table(spark, HOLIDAYS).write.option("header", "true").csv(path)
    days = calendars.read_holidays(spark, path)
    return market.sessions(spark, d).join(F.broadcast(days), ["exchange", "date"], "left_semi")


# ---------------------------------------------------------------- markets and universes

@query
def market_inference(spark, d):
    codes = market.trade_ticks(spark, d, sequence=False).select("ticker_code").distinct()
    variants = codes.select(F.explode(F.array(
        "ticker_code", F.lower("ticker_code"), F.concat("ticker_code", F.lit(".UW"))
    )).alias("code"))
    return variants.select("code", infer_market(F.col("code")).alias("market"))


@query
def exchange_inference(spark, d):
    codes = market.trade_ticks(spark, d, sequence=False).select("ticker_code").distinct()
    variants = codes.select(F.explode(F.array(
        "ticker_code", F.lower("ticker_code"), F.concat("ticker_code", F.lit(".UW"))
    )).alias("code"))
    return variants.select("code", exchange_code(F.col("code")).alias("exchange"))


@query
def korean_listing(spark, d):
    rows = market.listing(spark, d).where(F.col("exchange") == "KRX")
    return listings.korean_symbols(rows)


@query
def korean_listing_plain(spark, d):
    rows = market.listing(spark, d).where(F.col("exchange") == "KRX")
    return listings.korean_symbols(rows, add_suffix=False)


@query
def plain_listing(spark, d):
    return listings.plain_symbols(market.listing(spark, d).where(F.col("exchange") != "KRX"))


@query
def market_prefix_listing(spark, d):
    return listings.of_market(market.listing(spark, d), "kosdaq")


@query
def market_suffix_codes(spark, d):
    rows = market.listing(spark, d).select(F.trim("symbol").alias("code"), "market", "pos")
    return listings.codes_with_market_suffix(rows)


@query
def universe(spark, d):
    return listings.universe(market.listing(spark, d), ["kospi", "KRX", "NASDAQ", "nyse", "amex"])


@query
def universe_head(spark, d):
    return listings.first_tickers(listings.universe(market.listing(spark, d)), 20)


@query
def tickers_by_exchange(spark, d):
    rows = listings.symbols_by_exchange(market.listing(spark, d))
    return rows.select("exchange", "pos", "ticker_code")


@query
def explicit_universe(spark, d):
    """A universe by named exchanges, as a run's settings pick it."""
    return listings.pick_universe(spark, None, ["NYSE", "kospi"], market.listing(spark, d))


# ---------------------------------------------------------------- keyed merges

def _old_prices(spark: SparkSession, d: str) -> DataFrame:
    rows = barsrc.within(_bars(spark, d), None, OLD_END)
    return rows.withColumn("retrieved_at", F.lit("2020-06-01").cast("timestamp"))


def _new_prices(spark: SparkSession, d: str) -> DataFrame:
    """Later bars, overlapping the old ones: prices moved, and some adjusted closes lost."""
    rows = barsrc.within(_bars(spark, d), NEW_START, None)
    lost = F.col("volume") % 7 == 0
    return rows.withColumns({
        "close": F.col("close") * 1.01,
        "adj_close": F.when(~lost, F.col("adj_close")).otherwise(F.lit(float("nan"))),
        "retrieved_at": F.lit("2024-06-01").cast("timestamp"),
    })


def _with_year(df: DataFrame) -> DataFrame:
    return published(df.withColumn("retrieved_year", F.year("retrieved_at")).drop("retrieved_at"))


@query
def upsert_prices(spark, d):
    return _with_year(keyed.upsert_prices(_old_prices(spark, d), _new_prices(spark, d)))


@query
def insert_ignore_prices(spark, d):
    return _with_year(keyed.insert_missing(_old_prices(spark, d), _new_prices(spark, d)))


@query
def upsert_counts(spark, d):
    return keyed.merge_counts(_old_prices(spark, d), _new_prices(spark, d))


@query
def upsert_partial_indicators(spark, d):
    """Stored rows hold two indicators; the batch brings one of them and a third, over later days."""
    table = _indicators(spark, d, ["ma_5", "bb_mid", "obv"])
    blank = [F.lit(None).cast("double").alias(c) for c in ind.INDICATOR_NAMES if c not in ("ma_5", "bb_mid")]
    old = barsrc.within(table, None, OLD_END).select(
        "ticker_code", "date", "ma_5", "bb_mid", *blank,
        F.lit("v0.9").alias("calculated_version"), F.lit(None).cast("timestamp").alias("calculated_at"),
    )
    new = barsrc.within(table, NEW_START, None).select(
        "ticker_code", "date", (F.col("bb_mid") * 2.0).alias("bb_mid"), "obv"
    )
    merged = keyed.upsert_indicators(old, new, "v1.0")
    return published(merged.select("ticker_code", "date", "ma_5", "bb_mid", "obv", "calculated_version"))


def _stored_prices(spark: SparkSession, d: str, update_if_exists: bool = True) -> str:
    """The old bars saved, then the new ones over them; the path of the stored table."""
    path = new_folder(spark)
    store.save_prices(spark, path, _old_prices(spark, d))
    store.save_prices(spark, path, _new_prices(spark, d), update_if_exists)
    return path


@query
def stored_prices(spark, d):
    """Two saves read back in order."""
    return published(store.load_prices(spark, _stored_prices(spark, d), market.tickers(spark, d), ordered=True))


@query
def stored_new_prices(spark, d):
    """The second save only adds keys that are not stored yet."""
    path = _stored_prices(spark, d, update_if_exists=False)
    return published(store.load_prices(spark, path, market.tickers(spark, d), ordered=True))


@query
def stored_indicators(spark, d):
    """Two saves of different indicators, read back in order."""
    path, table = new_folder(spark), materialize(_indicators(spark, d, ["ma_5", "bb_mid", "obv"]))
    store.save_indicators(spark, path, barsrc.within(table, None, OLD_END).select("ticker_code", "date", "ma_5", "bb_mid"), "v0.9")
    doubled = (F.col("bb_mid") * 2.0).alias("bb_mid")
    store.save_indicators(spark, path, barsrc.within(table, NEW_START, None).select("ticker_code", "date", doubled, "obv"))
    rows = store.load_indicators(spark, path, market.tickers(spark, d), ordered=True)
    return _only(rows, ["ma_5", "bb_mid", "obv"])


@query
def stored_delete(spark, d):
    """Bars left after the tickers of a market were deleted from the stored tables."""
    prices, tickers = _stored_prices(spark, d), new_folder(spark)
    store.write_tickers(spark, tickers, store.load_tickers(market.tickers(spark, d)))
    gone = market.tickers(spark, d).where(F.col("market") == "TOKYO")
    store.delete_tickers(spark, gone, tickers, {prices: schemas.PRICES})
    return published(store.load_prices(spark, prices, store.read_tickers(spark, tickers)))


def _indicator_run(spark: SparkSession, d: str) -> tuple[Paths, IndicatorRun]:
    """Indicators of a date range computed from stored prices and stored."""
    paths = Paths(tickers=new_folder(spark), prices=new_folder(spark), indicators=new_folder(spark))
    store.save_prices(spark, paths.prices, _bars(spark, d))
    names = ["ma_5", "macd_hist", "bb_mid"]
    return paths, refresh_indicators(spark, paths, market.tickers(spark, d), RANGE_START, RANGE_END, names)


@query
def indicator_refresh(spark, d):
    paths, _ = _indicator_run(spark, d)
    rows = store.load_indicators(spark, paths.indicators, market.tickers(spark, d), RANGE_START, RANGE_END)
    return _only(rows, ["ma_5", "macd_hist", "bb_mid"])


@query
def indicator_refresh_nulls(spark, d):
    return _indicator_run(spark, d)[1].nulls


@query
def indicator_versions(spark, d):
    """Stored rows by the version that first calculated them, after two saves."""
    paths = Paths(tickers=new_folder(spark), prices=new_folder(spark), indicators=new_folder(spark))
    table = materialize(_indicators(spark, d, ["bb_mid"]).select("ticker_code", "date", "bb_mid"))
    store.save_indicators(spark, paths.indicators, barsrc.within(table, None, OLD_END), "v0.9")
    store.save_indicators(spark, paths.indicators, barsrc.within(table, NEW_START, None))
    return indicator_version_counts(spark, paths)


@query
def latest_price_per_key(spark, d):
    """A batch with repeated keys, resolved to the last row by a tie-break column."""
    old, new = _old_prices(spark, d), _new_prices(spark, d)
    batch = old.withColumn("seq", F.lit(1)).unionByName(new.withColumn("seq", F.lit(2)))
    picked = keyed.latest_per_key(batch.drop("retrieved_at"), "seq")
    return published(nan_to_null(picked).drop("seq"))


@query
def repeated_keys(spark, d):
    ticks = market.trade_ticks(spark, d, sequence=False).select("ticker_code", F.to_date("ts").alias("date"))
    return keyed.repeated_keys(ticks)


@query
def ticker_get_or_create(spark, d):
    codes = market.trade_ticks(spark, d, sequence=False).select("ticker_code").unionByName(
        market.event_ticks(spark, d, sequence=False).select("ticker_code")
    )
    return keyed.add_tickers(market.tickers(spark, d), codes)


def _renames(spark: SparkSession, d: str) -> DataFrame:
    """New names for all tickers seen in trades or events; only listed ones can take them."""
    seen = market.trade_ticks(spark, d, sequence=False).select("ticker_code").unionByName(
        market.event_ticks(spark, d, sequence=False).select("ticker_code")
    ).distinct()
    longer = F.concat(F.lit("Name of "), F.col("ticker_code"))
    listed = market.tickers(spark, d).select("ticker_code", F.col("name").alias("_old"))
    keeps = F.col("ticker_code").endswith(".KS")
    return seen.join(listed, "ticker_code", "left").select(
        "ticker_code", F.when(keeps, F.col("_old")).otherwise(longer).alias("name")
    )


@query
def ticker_update(spark, d):
    return keyed.update_ticker_details(market.tickers(spark, d), _renames(spark, d))


@query
def ticker_changes(spark, d):
    return keyed.changed_tickers(market.tickers(spark, d), _renames(spark, d))


@query
def cascade_delete(spark, d):
    gone = market.tickers(spark, d).where(F.col("market") == "TOKYO")
    return published(keyed.without_tickers(_bars(spark, d), gone))


@query
def numeric_clean(spark, d):
    """Figures found in event properties and types, cast where they are numbers."""
    text = F.regexp_extract("props", r": (\d+)", 1)
    rows = market.read_table(spark, d, "events").select(
        "event_id", text.alias("k"), F.when(F.col("event_id") % 2 == 0, F.col("event_type"))
        .otherwise(F.col("value").cast("string")).alias("v"),
    )
    return published(to_double(rows, ["k", "v"]))


# ---------------------------------------------------------------- joins and gaps

@query
def price_ticker_join(spark, d):
    return published(views.with_ticker_details(_bars(spark, d), market.tickers(spark, d)))


@query
def price_indicator_join(spark, d):
    table = _indicators(spark, d, ["ma_20", "bb_pct"])
    later = barsrc.within(table, NEW_START, None).select("ticker_code", "date", "ma_20", "bb_pct")
    return published(views.prices_with_indicators(_bars(spark, d), later))


@query
def price_indicator_view(spark, d):
    table = _indicators(spark, d, ["ma_20", "ma_60", "bb_mid", "obv"])
    later = barsrc.within(table, NEW_START, None)
    listed = market.tickers(spark, d).where(F.col("market") != "CRYPTO")
    return published(views.price_indicator_view(_bars(spark, d), listed, later))


@query
def exchange_sessions(spark, d):
    return _sessions(spark, d).where(F.col("exchange").isNotNull())


@query
def holiday_list(spark, d):
    """Holidays that are sessions of the tables."""
    days = calendars.holiday_table(spark, HOLIDAYS)
    return market.sessions(spark, d).join(F.broadcast(days), ["exchange", "date"], "left_semi")


@query
def gap_fill(spark, d):
    return published(gaps.fill_gaps(_bars(spark, d), _sessions(spark, d)))


@query
def gap_fill_sessions_only(spark, d):
    return published(gaps.fill_gaps(_bars(spark, d), _sessions(spark, d), drop_non_sessions=True))


@query
def traded_sessions(spark, d):
    """Sessions as the bars themselves show them."""
    return calendars.sessions_of(_bars(spark, d))


@query
def missing_sessions(spark, d):
    return gaps.missing_sessions(_bars(spark, d), _sessions(spark, d))


@query
def short_coverage(spark, d):
    rows = barsrc.within(_bars(spark, d), RANGE_START, RANGE_END)
    return gaps.short_coverage(rows, _sessions(spark, d), RANGE_START, RANGE_END)


@query
def failed_tickers(spark, d):
    asked = keyed.add_tickers(market.tickers(spark, d), market.event_ticks(spark, d, sequence=False))
    return views.without_data(asked, market.trade_ticks(spark, d, sequence=False))


@query
def unknown_exchange_tickers(spark, d):
    """Tickers left after those of no known exchange are dropped."""
    codes = market.trade_ticks(spark, d, sequence=False).select("ticker_code").distinct()
    odd = codes.select(F.concat("ticker_code", F.lit(".UW")).alias("ticker_code"))
    both = codes.unionByName(odd).withColumn("exchange", exchange_code(F.col("ticker_code")))
    return both.where(F.col("exchange").isNotNull())


# ---------------------------------------------------------------- counts and profiles

@query
def stage_counts(spark, d):
    rows = _bars(spark, d)
    return quality.stage_counts({
        "fetched": market.trade_ticks(spark, d, sequence=False), "saved": rows,
        "recent": barsrc.within(rows, NEW_START, None),
    })


@query
def stage_totals(spark, d):
    return quality.stage_totals(stage_counts(spark, d))


@query
def success_rate(spark, d):
    asked = keyed.add_tickers(market.tickers(spark, d), market.event_ticks(spark, d, sequence=False))
    return published(quality.success_rate(asked, market.trade_ticks(spark, d, sequence=False)))


@query
def null_counts(spark, d):
    return quality.null_counts(gaps.fill_gaps(_bars(spark, d), _sessions(spark, d)))


@query
def null_profile(spark, d):
    filled = gaps.fill_gaps(_bars(spark, d), _sessions(spark, d))
    return published(quality.null_profile(filled))


@query
def series_check(spark, d):
    """Ticks by order key: tickers repeat days and go back in time."""
    ticks = market.trade_ticks(spark, d).withColumn("date", F.to_date("ts"))
    # Four thousand orders per stretch.
    return quality.series_check(ticks, "seq", F.floor(F.col("order_key") / 4096))


@query
def rows_per_ticker(spark, d):
    return quality.rows_per_ticker(quality.require_rows(market.trade_ticks(spark, d, sequence=False)))


@query
def adjusted_bars(spark, d):
    rows = ind.adjusted_bars(_bars(spark, d))
    return _only(rows, ["adj_high", "adj_low", "adj_volume"])


# ---------------------------------------------------------------- indicators

_AVERAGES = [n for n in ind.INDICATOR_NAMES if n.startswith("ma_")]


@query
def ema_all(spark, d):
    return _only(_indicators(spark, d, _AVERAGES), _AVERAGES)


@query
def sma(spark, d):
    rows = ind.sma(_bars(spark, d), "adj_close", 20, "sma_20")
    return _only(rows, ["sma_20"])


@query
def macd(spark, d):
    names = ["macd", "macd_signal", "macd_hist"]
    return _only(_indicators(spark, d, names), names)


@query
def rsi(spark, d):
    return _only(_indicators(spark, d, ["rsi"]), ["rsi"])


@query
def bollinger(spark, d):
    names = ["bb_upper", "bb_mid", "bb_lower", "bb_pct"]
    return _only(_indicators(spark, d, names), names)


@query
def true_range(spark, d):
    return _only(ind.true_range(ind.adjusted_bars(_bars(spark, d))), ["true_range"])


@query
def atr(spark, d):
    return _only(_indicators(spark, d, ["atr"]), ["atr"])


@query
def log_return(spark, d):
    return _only(ind.log_return(_bars(spark, d), "adj_close", "log_ret"), ["log_ret"])


@query
def hv(spark, d):
    return _only(_indicators(spark, d, ["hv"]), ["hv"])


@query
def stochastic(spark, d):
    names = ["stoch_k", "stoch_d"]
    return _only(_indicators(spark, d, names), names)


@query
def obv(spark, d):
    return _only(_indicators(spark, d, ["obv"]), ["obv"])


@query
def all_indicators(spark, d):
    return _only(_indicators(spark, d), ind.INDICATOR_NAMES)


@query
def all_indicators_blocked(spark, d):
    """The same table through the block form of the exponential means."""
    return _only(ind.with_indicators(market.series_bars(spark, d)), ind.INDICATOR_NAMES)


@query
def trimmed_range_indicators(spark, d):
    names = ["ma_5", "macd_hist", "bb_mid"]
    return _only(trimmed_indicators(_bars(spark, d), RANGE_START, RANGE_END, names), names)


# ---------------------------------------------------------------- labels and learning

@query
def forward_label(spark, d):
    return _only(labels.forward_label(_bars(spark, d)), ["label"])


@query
def label_balance(spark, d):
    return published(labels.label_balance(labels.forward_label(_bars(spark, d))))


@query
def class_weights(spark, d):
    return published(labels.class_weights(labels.forward_label(_bars(spark, d))))


@query
def training_rows(spark, d):
    rows = labels.forward_label(_indicators(spark, d, ["ma_5", "ma_50"]))
    return _only(labels.training_rows(rows, ["ma_5", "ma_50"]), ["ma_5", "ma_50", "label"])


@query
def chrono_split(spark, d):
    rows = _bars(spark, d).select("ticker_code", "date")
    return timesplit.with_split(rows)


@query
def chrono_split_sketched(spark, d):
    """The cut day of the sketch against the ranks of its rows: whether it keeps its stated error."""
    keys = materialize(_bars(spark, d).select("ticker_code", "date"))
    cut = timesplit.sketched_cut(keys, 0.2, 0.005)
    day, slack = F.lit(cut.day), cut.allowed()
    within = (F.count_if(F.col("date") < day) <= cut.wanted + slack) & (F.count_if(F.col("date") <= day) >= cut.wanted - slack)
    return keys.agg(F.count("*").alias("n_rows"), F.lit(cut.wanted).cast("long").alias("wanted"), within.alias("within"))


@query
def ts_folds(spark, d):
    rows = _bars(spark, d).select("ticker_code", "date")
    return timesplit.with_folds(rows)


@query
def standardized_features(spark, d):
    names = ["ma_5", "ma_20", "bb_mid"]
    # Read twice, for the statistics and for the scaling.
    table = materialize(_indicators(spark, d, names).dropna(subset=names).select("ticker_code", "date", *names))
    out = learn.scaler(table, names).transform(table)
    return _only(out, [f"z_{n}" for n in names])


@query
def fold_statistics(spark, d):
    """Mean and deviation of the features over what each expanding fold trains on."""
    names = ["ma_5", "ma_20", "bb_mid"]
    table = materialize(_indicators(spark, d, names).dropna(subset=names).select("ticker_code", "date", *names))
    return published(learn.fold_statistics(timesplit.with_folds(table), names))


@query
def rule_report(spark, d):
    """Classification report of the crossing rule against the forward label."""
    rows = labels.forward_label(_rule_table(spark, d).withColumn("prediction", F.col("signal").cast("double")))
    return published(learn.classification_report(labels.training_rows(rows, ["prediction"])))


@query
def rule_accuracy(spark, d):
    rows = labels.forward_label(_rule_table(spark, d).withColumn("prediction", F.col("signal").cast("double")))
    return published(learn.accuracy(labels.training_rows(rows, ["prediction"])))


def _training_table(spark: SparkSession, d: str) -> DataFrame:
    return _indicators(spark, d, training.FEATURES)


@query
def train_report(spark, d):
    """Full training: split, scaling, grid search over folds, report on the test part."""
    return published(training.train_signals(_training_table(spark, d)).report)


@query
def train_certificate(spark, d):
    """The slope of the chosen model's loss on the training part: zero, as only the best coefficients have it."""
    done = training.train_signals(_training_table(spark, d))
    return published(learn.certificate(done.model, done.train).drop("coefficient"))


@query
def train_folds(spark, d):
    """Rows and rises of each fold of the training part."""
    rows = labels.training_rows(labels.forward_label(_training_table(spark, d)), training.FEATURES)
    rows = materialize(rows.select("ticker_code", "date", "label"))
    train = timesplit.with_split(rows).where(F.col("split") == "train")
    return timesplit.with_folds(train).groupBy("fold").agg(F.count("*").alias("n_rows"), F.sum("label").cast("long").alias("n_up"))


def _labelled(table: DataFrame, beside: list[str], features: list[str]) -> DataFrame:
    """Scorable bars with their label, written once: labels need the layout that the indicators have, every pass of a fit a few columns."""
    rows = labels.forward_label(table).dropna(subset=features)
    return materialize(rows.select("ticker_code", "date", *beside, *features, "label"))


def _plain_model(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, learn.SignalModel]:
    """Scorable bars with features, the labelled ones among them, and one fitted candidate."""
    table = _labelled(_training_table(spark, d), ["close"], training.FEATURES)
    rows = labels.training_rows(table, training.FEATURES)
    return table.drop("label"), rows, learn.fit_model(rows, training.FEATURES, learn.Candidate(1.0, None, 1000))


@query
def model_certificate(spark, d):
    """The slope of the fitted model's loss: zero, as only the best coefficients have it."""
    _, rows, model = _plain_model(spark, d)
    return published(learn.certificate(model, rows).drop("coefficient"))


@query
def model_scores(spark, d):
    table, _, model = _plain_model(spark, d)
    return published(model.predict(table).select("ticker_code", "date", "p1", "prediction"))


@query
def model_signals(spark, d):
    table, _, model = _plain_model(spark, d)
    return learn.model_signals(table, model)


@query
def model_metrics(spark, d):
    table, _, model = _plain_model(spark, d)
    return published(evaluation.evaluate_model(table, model).metrics)


PAIR = ["rsi", "stoch_k"]


def _pair_model(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, learn.SignalModel]:
    """Scorable bars, the labelled ones among them, and a model of two features."""
    table = _labelled(_indicators(spark, d, PAIR).dropna(subset=PAIR), ["close"], PAIR)
    rows = labels.training_rows(table, PAIR)
    return table.drop("label"), rows, learn.fit_model(rows, PAIR, learn.Candidate(1.0, None, 1000))


def _pair_scores(table: DataFrame, model: learn.SignalModel) -> DataFrame:
    return published(model.predict(table).select("ticker_code", "date", "p1", "prediction"), 3)


@query
def pair_model_scores(spark, d):
    table, _, model = _pair_model(spark, d)
    return _pair_scores(table, model)


@query
def saved_model_scores(spark, d):
    """The model saved and loaded before it scores."""
    table, _, model = _pair_model(spark, d)
    path = new_folder(spark)
    model.save(path)
    return _pair_scores(table, learn.SignalModel.load(spark, path))


@query
def pair_model_signals(spark, d):
    table, _, model = _pair_model(spark, d)
    return learn.model_signals(table, model)


@query
def pair_model_report(spark, d):
    _, rows, model = _pair_model(spark, d)
    return published(learn.classification_report(model.predict(rows)))


@query
def pair_model_metrics(spark, d):
    table, _, model = _pair_model(spark, d)
    return published(evaluation.evaluate_model(table, model).metrics)


# ---------------------------------------------------------------- signals and positions

@query
def rule_signal_density(spark, d):
    return published(quality.signal_density(_filled_rule(spark, d)))


@query
def signal_join(spark, d):
    signals = _rule_table(spark, d).where(F.col("signal").isNotNull())
    signals = barsrc.within(signals, NEW_START, None).select("ticker_code", "date", "signal")
    return published(views.bars_with_signals(_bars(spark, d), signals))


@query
def bad_signals(spark, d):
    """The crossing rule before missing signals are filled: NULLs are not valid signals."""
    return quality.bad_signals(_rule_table(spark, d)).select("ticker_code", "date")


@query
def trade_log(spark, d):
    """The trade log by a walk over sorted partitions."""
    held = positions.streamed_positions(_signalled(spark, d), RULES, ACCOUNT)
    return published(positions.closed_trades(held, ACCOUNT))


@query
def trade_log_folded(spark, d):
    """The trade log by the other engine, a fold of each ticker's bars."""
    held = positions.positions(_signalled(spark, d), RULES, ACCOUNT)
    return published(positions.closed_trades(held, ACCOUNT))


@query
def trade_log_take_profit(spark, d):
    held = positions.positions(_signalled(spark, d), TAKE_RULES, ACCOUNT)
    return published(positions.closed_trades(held, ACCOUNT))


@query
def open_positions(spark, d):
    held = positions.positions(_signalled(spark, d), RULES, ACCOUNT)
    still = held.where(F.col("exit_date").isNull())
    return published(still.select("ticker_code", "entry_date", "buy_price", "size", "holding_days"))


@query
def trade_stats(spark, d):
    held = positions.positions(_signalled(spark, d), RULES, ACCOUNT)
    return published(positions.trade_statistics(positions.closed_trades(held, ACCOUNT)))


@query
def transactions(spark, d):
    return published(positions.transactions(positions.positions(_signalled(spark, d), RULES, ACCOUNT)))


@query
def equal_weight_sizes(spark, d):
    rows = _bars(spark, d)
    cash = positions.notional(rows, ACCOUNT, None)
    return rows.select("ticker_code", "date", positions.share_count(cash, F.col("close")).alias("shares"))


@query
def strategy_equity(spark, d):
    return published(evaluation.evaluate_signals(_signalled(spark, d)).curve)


@query
def buy_and_hold_equity(spark, d):
    return published(evaluation.evaluate_hold(_closes(spark, d)).curve)


@query
def daily_returns(spark, d):
    return published(equity.daily_returns(evaluation.evaluate_hold(_closes(spark, d)).curve), 8)


@query
def drawdown(spark, d):
    return published(equity.drawdowns(evaluation.evaluate_hold(_closes(spark, d)).curve))


@query
def curve_metrics(spark, d):
    return published(equity.curve_metrics(evaluation.evaluate_hold(_closes(spark, d)).curve))


@query
def trade_metrics(spark, d):
    held = positions.positions(_signalled(spark, d), RULES, ACCOUNT)
    return published(equity.trade_metrics(positions.closed_trades(held, ACCOUNT)))


@query
def perf_metrics(spark, d):
    return published(evaluation.evaluate_signals(_signalled(spark, d)).metrics)


@query
def metrics_file(spark, d):
    """The metrics record written as CSV and read back."""
    record, path = evaluation.evaluate_signals(_signalled(spark, d)).metrics, new_folder(spark)
    store.write_metrics(record, path)
    return published(spark.read.schema(record.schema).option("header", "true").csv(path))


@query
def strategy_comparison(spark, d):
    return published(equity.compare_strategies([evaluation.evaluate_both(_signalled(spark, d)).metrics]))


@query
def strategy_vs_benchmark(spark, d):
    return published(equity.versus_of_records(evaluation.evaluate_both(_signalled(spark, d)).metrics))


# ---------------------------------------------------------------- composite jobs

@query
def price_refresh(spark, d):
    """Scan, gap fill and merge into what is stored."""
    bars = _bars(spark, d)
    listed = market.tickers(spark, d)
    fresh = fetched_bars(bars, _sessions(spark, d), listed, NEW_START, RANGE_END)
    fresh = fresh.withColumn("retrieved_at", F.lit("2024-06-01").cast("timestamp"))
    return _with_year(keyed.upsert_prices(_old_prices(spark, d), fresh))


@query
def full_refresh(spark, d):
    """Bars with indicators of a date range, gaps filled, warm-up trimmed."""
    names = ["ma_5", "ma_20", "bb_mid"]
    table = full_table(
        market.series_bars(spark, d), _sessions(spark, d), market.tickers(spark, d), RANGE_START, RANGE_END, names
    )
    return published(table)
