"""Signals to positions: trade log by rule, sizing, fills, costs, statistics.

Positions depend on their own past, so each ticker's bars are walked in date order, by one of two engines
that agree bar by bar. ``positions`` folds an array of each ticker's bars with the SQL ``aggregate`` function; a ticker
has at most one bar per calendar day (repeats raise), which bounds the array. ``streamed_positions`` reads
sorted partitions as a stream and holds one open position, whatever the length of a series.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions.indicators import repeated_day, stop_on
from tapeline.functions.numeric import ratio

HOLDING_PERIOD, STOP_LOSS, TAKE_PROFIT = "HOLDING_PERIOD", "STOP_LOSS", "TAKE_PROFIT"


@dataclass(frozen=True)
class Rules:
    """Exit rules. All are required; ``position_weight`` None means equal weight."""

    holding_period: int
    use_stop_loss: bool
    stop_loss_pct: float
    use_take_profit: bool
    take_profit_pct: float
    position_weight: float | None


@dataclass(frozen=True)
class Account:
    """Cash and trading costs."""

    initial_cash: float = 100_000_000.0
    commission: float = 0.00015
    slippage: float = 0.0025


def equal_weight(bars: DataFrame) -> Column:
    """``1 / number of tickers`` as a scalar subquery."""
    return F.lit(1.0) / bars.select("ticker_code").distinct().agg(F.count("*")).scalar()


def notional(bars: DataFrame, account: Account, weight: float | None) -> Column:
    """Cash per position: the same fixed share for every ticker."""
    share = equal_weight(bars) if weight is None else F.lit(float(weight))
    return share * account.initial_cash


def share_count(cash: Column, price: Column) -> Column:
    """Whole shares that ``cash`` buys; NULL or zero means no position."""
    return F.floor(ratio(cash, price)).cast("long")


def buy_fill(close: Column, account: Account) -> Column:
    return close * (1.0 + account.slippage)


def sell_fill(close: Column, account: Account) -> Column:
    return close * (1.0 - account.slippage)


_TRADE = (
    "array<struct<entry_date: date, exit_date: date, buy_price: double, sell_price: double, "
    "size: bigint, holding_days: int, exit_reason: string>>"
)


def _fold_sql(rules: Rules, account: Account) -> str:
    """State machine over ``_bars`` (date, close, signal), sorted by date.

    State: entry day (NULL while flat), fill price, size, bars held, finished trades.
    A bar without a price counts as a bar held but can neither open nor close.
    """
    # Thresholds compare values rounded to 8 places.
    move = "round(b.close / s.fill - 1D, 8)"
    if rules.use_stop_loss:
        price_rule = f"WHEN {move} <= {-rules.stop_loss_pct!r}D THEN '{STOP_LOSS}'"
    elif rules.use_take_profit:
        price_rule = f"WHEN {move} >= {rules.take_profit_pct!r}D THEN '{TAKE_PROFIT}'"
    else:
        price_rule = ""
    hold = rules.holding_period
    exit_reason = f"""CASE
        WHEN b.close IS NULL THEN NULL
        WHEN s.days + 1 >= {hold} THEN IF(b.signal = 1, NULL, '{HOLDING_PERIOD}')
        {price_rule} END"""
    extended = f"s.days + 1 >= {hold} AND b.signal = 1"
    shares = "CAST(floor(try_divide(_notional, b.close)) AS BIGINT)"
    flat = """named_struct('entry', CAST(NULL AS DATE), 'fill', CAST(NULL AS DOUBLE),
        'size', CAST(NULL AS BIGINT), 'days', 0, 'done', {done})"""
    sold = f"""concat(s.done, array(named_struct(
        'entry_date', s.entry, 'exit_date', b.date, 'buy_price', s.fill,
        'sell_price', b.close * {1.0 - account.slippage!r}D, 'size', s.size,
        'holding_days', s.days + 1, 'exit_reason', {exit_reason})))"""
    return f"""aggregate(_bars, {flat.format(done=f"CAST(array() AS {_TRADE})")}, (s, b) -> CASE
        WHEN s.entry IS NULL AND b.signal NOT IN (0, 1) THEN raise_error(concat(
            'signal must be 0 or 1 for ticker ', ticker_code, ' on ', CAST(b.date AS STRING)))
        WHEN s.entry IS NULL AND b.signal = 1 AND b.close > 0 AND {shares} > 0 THEN
            named_struct('entry', b.date, 'fill', b.close * {1.0 + account.slippage!r}D,
                'size', {shares}, 'days', 0, 'done', s.done)
        WHEN s.entry IS NULL THEN s
        WHEN {exit_reason} IS NOT NULL THEN {flat.format(done=sold)}
        ELSE named_struct('entry', s.entry, 'fill', s.fill, 'size', s.size,
            'days', IF({extended}, 0, s.days + 1), 'done', s.done) END)"""


def positions(bars: DataFrame, rules: Rules, account: Account = Account()) -> DataFrame:
    """Closed trades, plus the last open position of a ticker with NULL exit columns.

    ``bars`` needs ``ticker_code, date, close, signal``. Exit rules in order: holding
    period (a fresh signal extends instead), else stop loss, else take profit; with a
    stop loss on, take profit is not reached. There is no entry on the exit bar.
    """
    w = Window.partitionBy("ticker_code").orderBy("date")
    checked = bars.select("ticker_code", "date", "close", "signal").withColumn("_again", repeated_day(w))
    checked = checked.withColumn("close", stop_on(F.col("_again"), "close", "repeated day"))
    series = checked.groupBy("ticker_code").agg(
        F.array_sort(F.collect_list(F.struct("date", "close", "signal"))).alias("_bars")
    )
    sized = series.withColumn("_notional", notional(bars, account, rules.position_weight))
    folded = sized.select("ticker_code", F.expr(_fold_sql(rules, account)).alias("_end"))
    open_trade = """IF(_end.entry IS NULL, array(), array(named_struct(
        'entry_date', _end.entry, 'exit_date', CAST(NULL AS DATE), 'buy_price', _end.fill,
        'sell_price', CAST(NULL AS DOUBLE), 'size', _end.size, 'holding_days', _end.days,
        'exit_reason', CAST(NULL AS STRING))))"""
    return folded.select(
        "ticker_code", F.expr(f"inline(concat(_end.done, CAST({open_trade} AS {_TRADE})))")
    )


_STREAMED = (
    "ticker_code string, entry_date date, exit_date date, buy_price double, sell_price double, "
    "size bigint, holding_days int, exit_reason string"
)


@dataclass
class _Walk:
    """One ticker's walk: the open position, if any, and the bars it was held."""

    rules: Rules
    account: Account
    ticker_code: str | None = None
    last_day: int | None = None
    entry: int | None = None
    fill: float = 0.0
    size: int = 0
    days: int = 0

    def begin(self, ticker_code: str) -> tuple | None:
        """Start a ticker; the position that the last one left open."""
        left = None if self.entry is None else (self.ticker_code, self.entry, None, self.fill, None, self.size, self.days, None)
        self.ticker_code, self.last_day, self.entry = ticker_code, None, None
        return left

    def bar(self, day: int, close: float | None, signal: int | None, cash: float) -> tuple | None:
        """The trade that a bar closes, if any."""
        if day == self.last_day:
            raise ValueError(f"repeated day for ticker {self.ticker_code}")
        self.last_day = day
        if self.entry is None:
            if signal is not None and signal not in (0, 1):
                raise ValueError(f"signal must be 0 or 1 for ticker {self.ticker_code}")
            shares = math.floor(cash / close) if signal == 1 and close is not None and close > 0 else 0
            if shares > 0:
                self.entry, self.fill, self.size, self.days = day, close * (1.0 + self.account.slippage), shares, 0
            return None
        self.days += 1
        reason = None
        if self.days >= self.rules.holding_period:
            if signal == 1:
                self.days = 0  # a fresh signal extends
            elif close is not None:
                reason = HOLDING_PERIOD
        elif close is not None:
            reason = self._price_rule(close)
        if reason is None:
            return None
        done = (self.ticker_code, self.entry, day, self.fill, close * (1.0 - self.account.slippage), self.size, self.days, reason)
        self.entry = None
        return done

    def _price_rule(self, close: float) -> str | None:
        rules, move = self.rules, close / self.fill - 1.0
        if rules.use_stop_loss:
            return STOP_LOSS if _eight_places(move, -rules.stop_loss_pct) <= -rules.stop_loss_pct else None
        if rules.use_take_profit:
            return TAKE_PROFIT if _eight_places(move, rules.take_profit_pct) >= rules.take_profit_pct else None
        return None


def _eight_places(move: float, limit: float) -> float:
    """``move`` rounded half up to 8 places as Spark does; the digits matter only next to the limit."""
    if abs(move - limit) > 1e-6 or not math.isfinite(move):
        return move
    return float(Decimal(repr(move)).quantize(Decimal("1e-8"), ROUND_HALF_UP))


def streamed_positions(bars: DataFrame, rules: Rules, account: Account = Account()) -> DataFrame:
    """``positions`` by a walk over sorted partitions: one exchange, no array of bars, no copy of finished trades."""
    rows = bars.select("ticker_code", "date", F.col("close").cast("double").alias("close"), F.col("signal").cast("int").alias("signal"))
    rows = rows.withColumn("_cash", notional(bars, account, rules.position_weight))
    ordered = rows.repartition("ticker_code").sortWithinPartitions("ticker_code", "date")

    def batch_of(trades: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*trades)) if trades else [[]] * 8
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.int32(), pa.string())
        arrays = [pa.array(list(c), kind) for c, kind in zip(columns, kinds)]
        arrays[1], arrays[2] = arrays[1].cast(pa.date32()), arrays[2].cast(pa.date32())
        return pa.RecordBatch.from_arrays(arrays, ["ticker_code", "entry_date", "exit_date", "buy_price", "sell_price", "size", "holding_days", "exit_reason"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = _Walk(rules, account)
        for batch in batches:
            trades = []
            days = batch.column(1).cast(pa.int32()).to_pylist()
            codes, closes, signals, cash = (batch.column(i).to_pylist() for i in (0, 2, 3, 4))
            for code, day, close, signal, share in zip(codes, days, closes, signals, cash):
                if code != walk.ticker_code:
                    trades.append(walk.begin(code))
                trades.append(walk.bar(day, close, signal, share))
            yield batch_of([t for t in trades if t is not None])
        yield batch_of([t for t in [walk.begin("")] if t is not None])

    return ordered.mapInArrow(run, _STREAMED)


def with_profit(trades: DataFrame, account: Account = Account()) -> DataFrame:
    """Add ``pnl_pct`` (price move) and ``pnl_net`` (cash, after commission on both sides)."""
    buy, sell, size = F.col("buy_price"), F.col("sell_price"), F.col("size")
    return trades.withColumns({
        "pnl_pct": (sell - buy) / buy,
        "pnl_net": size * (sell - buy) - (sell + buy) * size * account.commission,
    })


def closed_trades(held: DataFrame, account: Account = Account()) -> DataFrame:
    """The trade log: finished positions with their profit."""
    done = held.where(F.col("exit_date").isNotNull())
    return with_profit(done, account).select(
        "ticker_code", "entry_date", "exit_date", "buy_price", "sell_price", "size",
        "pnl_pct", "pnl_net", "holding_days", "exit_reason",
    )


def trade_statistics(trades: DataFrame) -> DataFrame:
    """Trades, share with a gain, mean gain and mean bars held."""
    return trades.agg(
        F.count("*").alias("total_trades"),
        F.avg((F.col("pnl_pct") > 0).cast("double")).alias("win_rate"),
        F.avg("pnl_pct").alias("avg_pnl_pct"),
        F.avg("holding_days").alias("avg_holding_days"),
    )


def transactions(held: DataFrame) -> DataFrame:
    """Positions as single buy and sell rows: signed amount, price and value."""
    rows = held.selectExpr(
        "ticker_code",
        "stack(2, entry_date, size, buy_price, exit_date, -size, sell_price) AS (date, amount, price)",
    )
    return rows.where(F.col("date").isNotNull()).withColumn("value", -F.col("amount") * F.col("price"))
