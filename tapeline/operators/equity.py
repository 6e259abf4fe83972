"""Equity curves and portfolio metrics.

Daily profit is summed per day with map-side combining; everything after that works on
one row per (strategy, calendar day), which is small whatever the number of tickers.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions.numeric import ratio, rounded
from tapeline.operators.positions import Account, buy_fill, notional, share_count

TRADING_DAYS = 252
RISK_FREE = 0.03
_FAR = "9999-12-31"

# The metrics record and the comparison columns, in order.
METRIC_COLUMNS = [
    "total_return", "annual_return", "volatility", "sharpe_ratio", "sortino_ratio", "max_drawdown",
    "max_drawdown_duration", "calmar_ratio", "total_trades", "winning_trades", "losing_trades",
    "win_rate", "avg_trade_pnl", "avg_winning_pnl", "avg_losing_pnl", "profit_factor", "expectancy",
    "initial_value", "final_value", "start_date", "end_date", "trading_days",
]
KEY_METRICS = [
    "total_return", "annual_return", "volatility", "sharpe_ratio", "max_drawdown", "calmar_ratio",
    "total_trades", "win_rate", "profit_factor",
]
VERSUS_METRICS = [
    "total_return", "annual_return", "volatility", "sharpe_ratio", "max_drawdown", "win_rate",
    "total_trades",
]


def _carried_positions(bars: DataFrame, held: DataFrame) -> tuple[DataFrame, Window]:
    """Bars (``_kind`` 1) and entries (0) of each ticker in date order, with the latest entry carried forward."""
    none = F.lit(None)
    entries = held.select(
        "ticker_code", F.col("entry_date").alias("date"), F.lit(0).alias("_kind"), none.cast("double").alias("close"),
        F.col("entry_date").alias("_in"),
        F.coalesce("exit_date", F.lit(_FAR).cast("date")).alias("_out"),
        "size", F.col("buy_price").alias("_buy"), F.coalesce("sell_price", F.lit(0.0)).alias("_sell"),
    )
    marks = bars.select(
        "ticker_code", "date", F.lit(1).alias("_kind"), F.col("close").cast("double").alias("close"),
        none.cast("date").alias("_in"), none.cast("date").alias("_out"), none.cast("long").alias("size"),
        none.cast("double").alias("_buy"), none.cast("double").alias("_sell"),
    )
    w = Window.partitionBy("ticker_code").orderBy("date", "_kind")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    carried = {c: F.last(c, ignorenulls=True).over(so_far) for c in ("_in", "_out", "size", "_buy", "_sell")}
    carried["_last"] = F.last("close", ignorenulls=True).over(before)
    return marks.unionByName(entries).withColumns(carried), w


def _position_profit(account: Account) -> Column:
    size, day, fee = F.col("size"), F.col("date"), account.commission
    close = F.coalesce("close", "_last")
    return (
        F.when(day == F.col("_in"), size * (close - F.col("_buy")) - size * F.col("_buy") * fee)
        .when(day == F.col("_out"), size * (F.col("_sell") - F.col("_last")) - size * F.col("_sell") * fee)
        .when((day > F.col("_in")) & (day < F.col("_out")), size * (close - F.col("_last")))
        .otherwise(0.0)
    )


def position_profit(bars: DataFrame, held: DataFrame, account: Account = Account()) -> DataFrame:
    """Profit of each ticker on each of its bars: ``(ticker_code, date, profit)``.

    Entries are put among the bars and carried forward in date order, so a bar meets
    only its own position: one shuffle by ticker, no range join. Open positions are
    marked to the close.
    """
    rows, _ = _carried_positions(bars, held)
    return rows.where(F.col("_kind") == 1).select("ticker_code", "date", _position_profit(account).alias("profit"))


def _held_profit(close: Column, last: Column, size: Column, account: Account) -> Column:
    fill = buy_fill(close, account)
    return F.when(last.isNull(), size * (close - fill) - size * fill * account.commission).otherwise(size * (close - last))


def hold_profit(
    bars: DataFrame, account: Account = Account(), weight: float | None = None
) -> DataFrame:
    """Buy and hold: whole shares of each ticker at its first bar, marked to the close."""
    w = Window.partitionBy("ticker_code").orderBy("date")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    priced = bars.where(F.col("close") > 0).select("ticker_code", "date", F.col("close").cast("double").alias("close"))
    cash = notional(bars, account, weight)
    rows = priced.withColumns({
        "_first": F.first("close").over(so_far), "_last": F.last("close").over(before),
    }).withColumn("_size", share_count(cash, F.col("_first")))
    profit = _held_profit(F.col("close"), F.col("_last"), F.col("_size"), account)
    return rows.select("ticker_code", "date", profit.alias("profit"))


def both_profits(bars: DataFrame, held: DataFrame, account: Account = Account(), weight: float | None = None) -> DataFrame:
    """``position_profit`` and ``hold_profit`` of the same bars side by side, in one pass: ``profit`` and ``held_profit``."""
    rows, w = _carried_positions(bars, held)
    priced = F.when((F.col("_kind") == 1) & (F.col("close") > 0), F.col("close"))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "_first_price": F.first(priced, ignorenulls=True).over(so_far),
        "_last_price": F.last(priced, ignorenulls=True).over(before),
    }).where(F.col("_kind") == 1)
    size = share_count(notional(bars, account, weight), F.col("_first_price"))
    hold = F.when(priced.isNotNull(), _held_profit(priced, F.col("_last_price"), size, account))
    return rows.select("ticker_code", "date", _position_profit(account).alias("profit"), hold.alias("held_profit"))


def equity_curve(profit: DataFrame, account: Account = Account(), strategy: str = "strategy") -> DataFrame:
    """``(strategy, date, value)``: starting cash plus profit to date."""
    daily = profit.groupBy("date").agg(F.sum("profit").alias("profit"))
    return _summed_curve(daily.select(F.lit(strategy).alias("strategy"), "date", "profit"), account)


def both_curves(
    profits: DataFrame, account: Account = Account(), strategy: str = "strategy", benchmark: str = "benchmark"
) -> DataFrame:
    """The curves of ``both_profits`` under one another, from one sum per day."""
    daily = profits.groupBy("date").agg(
        F.sum("profit").alias("profit"), F.sum("held_profit").alias("held_profit"), F.count("held_profit").alias("_n"),
    )
    rows = F.explode(F.array(
        F.struct(F.lit(strategy).alias("strategy"), F.col("date"), F.col("profit"), F.lit(True).alias("_shown")),
        F.struct(F.lit(benchmark).alias("strategy"), F.col("date"), F.col("held_profit").alias("profit"), (F.col("_n") > 0).alias("_shown")),
    ))
    return _summed_curve(daily.select(rows.alias("r")).select("r.*").where("_shown").drop("_shown"), account)


def _summed_curve(daily: DataFrame, account: Account) -> DataFrame:
    w = Window.partitionBy("strategy").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    value = F.sum("profit").over(w) + account.initial_cash
    return daily.select("strategy", "date", value.alias("value"))


def daily_returns(curve: DataFrame, account: Account = Account()) -> DataFrame:
    """Add ``ret``, the first day being measured against the starting cash."""
    w = Window.partitionBy("strategy").orderBy("date")
    before = F.coalesce(F.lag("value").over(w), F.lit(account.initial_cash))
    return curve.withColumn("ret", ratio(F.col("value"), before) - 1.0)


def drawdowns(curve: DataFrame) -> DataFrame:
    """Add ``drawdown`` (share below the peak so far) and ``dd_length`` (days below it)."""
    w = Window.partitionBy("strategy").orderBy("date")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    peaked = curve.withColumn("peak", F.max("value").over(so_far))
    marked = peaked.withColumn("drawdown", ratio(F.col("peak") - F.col("value"), F.col("peak")))
    # Each day at the peak starts an island; its length counts the days below.
    island = marked.withColumn("_island", F.sum((F.col("drawdown") == 0).cast("int")).over(so_far))
    inside = Window.partitionBy("strategy", "_island").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    below = F.sum((F.col("drawdown") > 0).cast("int")).over(inside)
    return island.withColumn("dd_length", below).drop("_island")


def curve_metrics(curve: DataFrame, account: Account = Account()) -> DataFrame:
    """Return, risk and drawdown figures, one row per strategy."""
    cash = account.initial_cash
    daily = drawdowns(daily_returns(curve, account))
    rf_day = (1.0 + RISK_FREE) ** (1.0 / TRADING_DAYS) - 1.0
    year = math.sqrt(TRADING_DAYS)
    zero = F.lit(0.0)
    base = daily.groupBy("strategy").agg(
        F.lit(cash).alias("initial_value"),
        F.max_by("value", "date").alias("final_value"),
        F.min("date").alias("start_date"), F.max("date").alias("end_date"),
        F.count("*").alias("trading_days"),
        (F.stddev_samp("ret") * year).alias("volatility"),
        ((F.avg("ret") - rf_day) * year).alias("_excess"), F.stddev_pop("ret").alias("_sd"),
        (F.stddev_samp(F.when(rounded(F.col("ret")) < 0, F.col("ret"))) * year).alias("_down"),
        F.max("drawdown").alias("max_drawdown"), F.max("dd_length").alias("max_drawdown_duration"),
        F.avg(F.log(F.lit(1.0) + F.col("ret"))).alias("avg_log_return"),
    )
    base = base.withColumn("total_return", (F.col("final_value") - cash) / cash)
    # More than everything can be lost with a fixed sum per ticker; that is -100 % a year.
    left = F.greatest(F.lit(1.0) + F.col("total_return"), F.lit(0.0))
    grown = F.pow(left, F.lit(float(TRADING_DAYS)) / F.col("trading_days"))
    base = base.withColumn("annual_return", grown - 1.0)
    return base.withColumns({
        "sharpe_ratio": F.coalesce(ratio(F.col("_excess"), F.col("_sd")), zero),
        "sortino_ratio": F.coalesce(ratio(F.col("annual_return") - RISK_FREE, F.col("_down")), zero),
        "calmar_ratio": F.coalesce(ratio(F.col("annual_return"), F.abs("max_drawdown")), zero),
    }).drop("_excess", "_sd", "_down")


def trade_metrics(trades: DataFrame, account: Account = Account()) -> DataFrame:
    """Counts, means, profit factor, expectancy and SQN of a trade log, as one row."""
    pnl, zero = F.col("pnl_net"), F.lit(0.0)
    won, lost = F.when(pnl >= 0, pnl), F.when(pnl < 0, pnl)
    base = trades.agg(
        F.count("*").alias("total_trades"),
        F.count(won).alias("winning_trades"), F.count(lost).alias("losing_trades"),
        F.coalesce(F.avg(pnl), zero).alias("avg_trade_pnl"),
        F.coalesce(F.avg(won), zero).alias("avg_winning_pnl"),
        F.coalesce(F.avg(lost), zero).alias("avg_losing_pnl"),
        F.coalesce(ratio(F.sum(won), F.abs(F.sum(lost))), zero).alias("profit_factor"),
        F.coalesce(ratio(F.avg(pnl) * F.sqrt(F.count("*")), F.stddev_pop(pnl)), zero).alias("sqn"),
    )
    rate = F.coalesce(ratio(F.col("winning_trades"), F.col("total_trades")), zero)
    cash = account.initial_cash
    gain, loss = F.col("avg_winning_pnl") / cash, F.abs("avg_losing_pnl") / cash
    return base.withColumns({"win_rate": rate, "expectancy": rate * gain - (F.lit(1.0) - rate) * loss})


def _as_value(record: DataFrame) -> Column:
    """A one-row record as a scalar subquery: read beside other rows without a join."""
    return record.select(F.struct(*record.columns).alias("record")).scalar()


def performance(
    curve: DataFrame, trades: DataFrame, strategy: str = "strategy", account: Account = Account()
) -> DataFrame:
    """The full metrics record: 22 fields and the strategy name, one row."""
    record = curve_metrics(curve, account).where(F.col("strategy") == strategy)
    return _with_trades(record, _as_value(trade_metrics(trades, account)))


def both_performances(
    curves: DataFrame, trades: DataFrame, strategy: str = "strategy", benchmark: str = "benchmark", account: Account = Account()
) -> DataFrame:
    """The metrics records of a strategy and of a benchmark that closes no trade, from curves under one another."""
    found = trade_metrics(trades, account)
    idle = {c: F.lit(0).cast(found.schema[c].dataType) for c in found.columns}  # figures of no trades
    none = F.struct(*[value.alias(c) for c, value in idle.items()])
    records = curve_metrics(curves, account).where(F.col("strategy").isin(strategy, benchmark))
    return _with_trades(records, F.when(F.col("strategy") == strategy, _as_value(found)).otherwise(none))


def _with_trades(records: DataFrame, trades: Column) -> DataFrame:
    named = records.withColumn("_trades", trades)
    own = set(records.columns)
    return named.select("strategy", *[c if c in own else F.col(f"_trades.{c}").alias(c) for c in METRIC_COLUMNS])


def compare_strategies(records: list[DataFrame]) -> DataFrame:
    """Nine key metrics, one row per strategy."""
    return reduce(DataFrame.unionByName, records).select("strategy", *KEY_METRICS)


def versus_benchmark(strategy: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Seven metrics of both, their difference, and alpha (difference of total return)."""
    wanted = [F.col(m).cast("double").alias(m) for m in VERSUS_METRICS]
    return _versus(strategy.select(F.struct(*wanted).alias("a"), _as_value(benchmark.select(*wanted)).alias("b")))


def versus_of_records(records: DataFrame, strategy: str = "strategy", benchmark: str = "benchmark") -> DataFrame:
    """``versus_benchmark`` of two records under one another."""
    wanted = F.struct(*[F.col(m).cast("double").alias(m) for m in VERSUS_METRICS])
    of = lambda name: F.max(F.when(F.col("strategy") == name, wanted))
    return _versus(records.agg(of(strategy).alias("a"), of(benchmark).alias("b")))


def _versus(pair: DataFrame) -> DataFrame:
    """One row per metric from the structs ``a`` and ``b``."""
    named = [(m, m) for m in VERSUS_METRICS] + [("alpha", "total_return")]
    rows = F.explode(F.array(*[
        F.struct(
            F.lit(name).alias("metric"), F.col(f"a.{m}").alias("strategy"), F.col(f"b.{m}").alias("benchmark"),
            (F.col(f"a.{m}") - F.col(f"b.{m}")).alias("difference"),
        ) for name, m in named
    ]))
    return pair.select(rows.alias("r")).select("r.*")
