"""Trade rules against a plain loop, equity against numpy."""

from __future__ import annotations

import math
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeline.operators import equity, positions, quality
from tapeline.plans.evaluation import evaluate_both, evaluate_hold, evaluate_signals
from tapeline.operators.positions import Account, Rules

ACCOUNT = Account(initial_cash=10_000.0, commission=0.001, slippage=0.01)
START = date(2021, 1, 1)


def walk(n_tickers=4, days=150, seed=5):
    """Random prices and signals; a few prices are missing."""
    rng = np.random.default_rng(seed)
    rows = []
    for t in range(n_tickers):
        close = 50 * np.exp(np.cumsum(rng.normal(0, 0.03, days)))
        for i, c in enumerate(close):
            if rng.uniform() < 0.9:
                rows.append((f"T{t}", START + timedelta(days=i), None if rng.uniform() < 0.03 else float(c), int(rng.uniform() < 0.3)))
    return rows


def loop_trades(rows, rules, account, weight):
    """The rules as a plain loop: closed trades and open positions per ticker."""
    closed, still = [], []
    cash = account.initial_cash * weight
    for code in sorted({r[0] for r in rows}):
        held = None
        for _, day, close, signal in sorted(r for r in rows if r[0] == code):
            if held is None:
                size = math.floor(cash / close) if close else 0
                if signal == 1 and size > 0:
                    held = [day, close * (1 + account.slippage), size, 0]
                continue
            held[3] += 1
            why = None
            if held[3] >= rules.holding_period:
                if signal == 1:
                    held[3] = 0
                elif close is not None:
                    why = "HOLDING_PERIOD"
            elif close is not None:
                move = round(close / held[1] - 1, 8)
                if rules.use_stop_loss:
                    why = "STOP_LOSS" if move <= -rules.stop_loss_pct else None
                elif rules.use_take_profit:
                    why = "TAKE_PROFIT" if move >= rules.take_profit_pct else None
            if why:
                closed.append((code, held[0], day, held[1], close * (1 - account.slippage), held[2], held[3], why))
                held = None
        if held:
            still.append((code, held[0], held[2]))
    return closed, still


ALL_RULES = [
    Rules(5, True, 0.05, False, 0.10, None), Rules(5, True, 0.05, True, 0.02, 0.3),
    Rules(8, False, 0.05, True, 0.04, None), Rules(3, False, 0.05, False, 0.10, 0.2),
    Rules(1, True, 0.01, False, 0.10, None),
]


@pytest.mark.parametrize("rules", ALL_RULES)
@pytest.mark.parametrize("engine", [positions.positions, positions.streamed_positions])
def test_fold_agrees_with_a_loop(spark, rules, engine):
    rows = walk()
    bars = spark.createDataFrame(rows, "ticker_code string, date date, close double, signal int").repartition(3)
    held = engine(bars, rules, ACCOUNT).cache()
    weight = rules.position_weight or 1 / 4
    closed, still = loop_trades(rows, rules, ACCOUNT, weight)
    got = [tuple(r) for r in positions.closed_trades(held, ACCOUNT).select(
        "ticker_code", "entry_date", "exit_date", "buy_price", "sell_price", "size", "holding_days", "exit_reason"
    ).orderBy("ticker_code", "entry_date").collect()]
    assert len(got) == len(closed) > 20
    for a, b in zip(got, closed):
        assert a[:3] == b[:3] and a[5:] == b[5:] and a[3:5] == pytest.approx(b[3:5])
    left = held.where("exit_date is null").orderBy("ticker_code").collect()
    assert [(r["ticker_code"], r["entry_date"], r["size"]) for r in left] == still


@pytest.mark.parametrize("rules", ALL_RULES[:3])
def test_equity_agrees_with_a_loop(spark, rules):
    rows = walk()
    bars = spark.createDataFrame(rows, "ticker_code string, date date, close double, signal int")
    result = evaluate_signals(bars, rules, ACCOUNT)
    got = [(r["date"], r["value"]) for r in result.curve.orderBy("date").collect()]
    held = positions.positions(bars, rules, ACCOUNT).collect()
    # Value per day: cash from all fills so far plus open shares at the last known price.
    prices = {}
    for code, day, close, _ in sorted(rows, key=lambda r: r[1]):
        prices.setdefault(code, {})[day] = close
    for day, value in got:
        total = ACCOUNT.initial_cash
        for p in held:
            if p["entry_date"] <= day:
                total -= p["size"] * p["buy_price"] * (1 + ACCOUNT.commission)
                if p["exit_date"] and p["exit_date"] <= day:
                    total += p["size"] * p["sell_price"] * (1 - ACCOUNT.commission)
                else:
                    known = [c for d, c in sorted(prices[p["ticker_code"]].items()) if d <= day and c is not None]
                    total += p["size"] * known[-1]
        assert value == pytest.approx(total, abs=1e-6)
    assert got[-1][1] == pytest.approx(result.metrics.first()["final_value"])


def test_stop_loss_hides_take_profit(spark):
    rows = [("A", START + timedelta(days=i), c, int(i == 0)) for i, c in enumerate([10.0, 20.0, 30.0, 5.0])]
    bars = spark.createDataFrame(rows, "ticker_code string, date date, close double, signal int")
    both = positions.positions(bars, Rules(9, True, 0.05, True, 0.10, 0.5), ACCOUNT).first()
    assert both["exit_reason"] == "STOP_LOSS" and both["holding_days"] == 3
    only = positions.positions(bars, Rules(9, False, 0.05, True, 0.10, 0.5), ACCOUNT).first()
    assert only["exit_reason"] == "TAKE_PROFIT" and only["holding_days"] == 1


def test_signal_domain_and_repeats(spark):
    rows = [("A", START, 10.0, 0), ("A", START + timedelta(days=1), 10.0, 2)]
    bars = spark.createDataFrame(rows, "ticker_code string, date date, close double, signal int")
    with pytest.raises(Exception, match="signal must be 0 or 1"):
        positions.positions(bars, ALL_RULES[0], ACCOUNT).collect()
    assert quality.bad_signals(bars).count() == 1
    ok = bars.withColumn("signal", F.lit(0))
    with pytest.raises(Exception, match="repeated day"):
        positions.positions(ok.unionByName(ok), ALL_RULES[0], ACCOUNT).collect()


def test_small_cash_buys_nothing(spark):
    bars = spark.createDataFrame([("A", START, 1e9, 1), ("B", START, 0.0, 1)], "ticker_code string, date date, close double, signal int")
    assert positions.positions(bars, ALL_RULES[0], ACCOUNT).isEmpty()


def curve_of(spark, values):
    rows = [("s", START + timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "strategy string, date date, value double")


def test_curve_metrics(spark):
    values = [100.0, 104.0, 101.0, 99.0, 103.0, 108.0, 107.0, 107.5, 110.0]
    account = Account(initial_cash=100.0)
    r = equity.curve_metrics(curve_of(spark, values), account).first()
    v = pd.Series(values)
    ret = v / v.shift().fillna(100.0) - 1
    total, years = 0.10, len(v) / 252
    cagr = (1 + total) ** (1 / years) - 1
    draw = (v.cummax() - v) / v.cummax()
    assert r["total_return"] == pytest.approx(total) and r["annual_return"] == pytest.approx(cagr)
    assert r["volatility"] == pytest.approx(ret.std() * 252**0.5)
    rf = 1.03 ** (1 / 252) - 1
    assert r["sharpe_ratio"] == pytest.approx((ret.mean() - rf) / ret.std(ddof=0) * 252**0.5)
    assert r["sortino_ratio"] == pytest.approx((cagr - 0.03) / (ret[ret < 0].std() * 252**0.5))
    assert r["max_drawdown"] == pytest.approx(draw.max()) and r["max_drawdown_duration"] == 3
    assert r["calmar_ratio"] == pytest.approx(cagr / draw.max())
    assert (r["trading_days"], r["start_date"]) == (9, START)


def test_undefined_ratios_are_zero(spark):
    r = equity.curve_metrics(curve_of(spark, [100.0] * 5), Account(initial_cash=100.0)).first()
    assert (r["sharpe_ratio"], r["sortino_ratio"], r["calmar_ratio"], r["max_drawdown"]) == (0, 0, 0, 0)
    none = spark.createDataFrame([], "pnl_net double")
    t = equity.trade_metrics(none).first()
    assert (t["total_trades"], t["win_rate"], t["profit_factor"], t["expectancy"]) == (0, 0, 0, 0)


def test_trade_metrics(spark):
    pnl = [10.0, -4.0, 6.0, -2.0]
    t = equity.trade_metrics(spark.createDataFrame([(p,) for p in pnl], "pnl_net double"), Account(initial_cash=100.0)).first()
    assert (t["total_trades"], t["winning_trades"], t["losing_trades"], t["win_rate"]) == (4, 2, 2, 0.5)
    assert (t["avg_winning_pnl"], t["avg_losing_pnl"], t["profit_factor"]) == (8.0, -3.0, 16 / 6)
    assert t["expectancy"] == pytest.approx(0.5 * 0.08 - 0.5 * 0.03)
    assert t["sqn"] == pytest.approx(2 * np.mean(pnl) / np.std(pnl))


def test_hold_and_comparison(spark):
    rows = [("A", START + timedelta(days=i), c, 0) for i, c in enumerate([10.0, 12.0, 9.0])] + [("B", START + timedelta(days=1), 20.0, 0)]
    bars = spark.createDataFrame(rows, "ticker_code string, date date, close double, signal int")
    hold = evaluate_hold(bars, ACCOUNT)
    a, b = math.floor(5000 / 10), math.floor(5000 / 20)
    cost = lambda n, p: n * p * 1.01 * 1.001
    want = [10_000 - cost(a, 10) + a * 10, 10_000 - cost(a, 10) - cost(b, 20) + a * 12 + b * 20, 10_000 - cost(a, 10) - cost(b, 20) + a * 9 + b * 20]
    assert [r["value"] for r in hold.curve.orderBy("date").collect()] == pytest.approx(want)
    mine = evaluate_signals(bars, ALL_RULES[0], ACCOUNT)
    table = equity.compare_strategies([mine.metrics, hold.metrics])
    assert table.columns == ["strategy", *equity.KEY_METRICS] and table.count() == 2
    versus = {r["metric"]: r for r in equity.versus_benchmark(mine.metrics, hold.metrics).collect()}
    assert versus["alpha"]["difference"] == pytest.approx(0 - (want[-1] / 10_000 - 1)) and len(versus) == 8


def test_transactions(spark):
    bars = spark.createDataFrame(walk(), "ticker_code string, date date, close double, signal int")
    held = positions.positions(bars, ALL_RULES[0], ACCOUNT)
    moves = positions.transactions(held).collect()
    closed = held.where("exit_date is not null").count()
    assert len(moves) == held.count() + closed and all(m["value"] == -m["amount"] * m["price"] for m in moves)


@pytest.mark.parametrize("seed", range(4))
def test_both_engines_agree_on_random_rules(spark, seed):
    rng = np.random.default_rng(100 + seed)
    rules = Rules(int(rng.integers(1, 12)), bool(rng.integers(2)), float(rng.uniform(0.01, 0.08)), bool(rng.integers(2)), float(rng.uniform(0.01, 0.08)), None)
    rows = walk(n_tickers=30, days=200, seed=seed) + [("NONE", START, None, None), ("ZERO", START, 0.0, 1), ("ONE", START, 5.0, 1)]
    bars = spark.createDataFrame(rows, "ticker_code string, date date, close double, signal int")
    a, b = positions.positions(bars, rules, ACCOUNT), positions.streamed_positions(bars, rules, ACCOUNT)
    assert a.count() > 100 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_streamed_walk_carries_state_across_batches(spark):
    days = 500
    rows = [("A", START + timedelta(days=i), 10.0 + i % 7, int(i % 9 == 0)) for i in range(days)]
    bars = spark.createDataFrame(rows, "ticker_code string, date date, close double, signal int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        got = positions.streamed_positions(bars, ALL_RULES[0], ACCOUNT).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(got) == sorted(positions.positions(bars, ALL_RULES[0], ACCOUNT).collect()) and len(got) > 20


def test_limits_are_met_to_eight_places(spark):
    # A fall of exactly five hundredths, up to the last bits of the division.
    account = Account(initial_cash=1000.0, commission=0.0, slippage=0.0)
    rows = [(f"T{i}", START + timedelta(days=d), c, int(d == 0)) for i in range(1, 60) for d, c in enumerate([i / 7, i / 7 * 0.95, i / 7])]
    rows += [(f"U{i}", START + timedelta(days=d), c, int(d == 0)) for i in range(1, 60) for d, c in enumerate([1.0, 0.95 + i * 1e-9 - 3e-8, 1.0])]
    bars = spark.createDataFrame(rows, "ticker_code string, date date, close double, signal int")
    rules = Rules(9, True, 0.05, False, 0.1, 0.5)
    a, b = positions.positions(bars, rules, account), positions.streamed_positions(bars, rules, account)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and a.where("exit_reason = 'STOP_LOSS'").count() > 59


def test_streamed_walk_refuses_repeated_days_and_odd_signals(spark):
    rows = [("A", START, 1.0, 0), ("A", START, 2.0, 0)]
    schema = "ticker_code string, date date, close double, signal int"
    with pytest.raises(Exception, match="repeated day"):
        positions.streamed_positions(spark.createDataFrame(rows, schema), ALL_RULES[0], ACCOUNT).collect()
    with pytest.raises(Exception, match="signal must be 0 or 1"):
        positions.streamed_positions(spark.createDataFrame([("A", START, 1.0, 3)], schema), ALL_RULES[0], ACCOUNT).collect()


@pytest.mark.parametrize("rules", ALL_RULES[:3])
def test_both_curves_in_one_pass(spark, rules):
    """The comparison's curves and records equal those of separate evaluations, and need no nested loops."""
    rows = walk(n_tickers=6) + [("LATE", START + timedelta(days=400), 3.0, 0), ("NONE", START + timedelta(days=500), None, 0)]
    bars = spark.createDataFrame(rows, "ticker_code string, date date, close double, signal int")
    both = evaluate_both(bars, rules, ACCOUNT)
    apart = [evaluate_signals(bars, rules, ACCOUNT), evaluate_hold(bars, ACCOUNT)]
    for e, name in zip(apart, ("strategy", "benchmark")):
        want = {r["date"]: r["value"] for r in e.curve.collect()}
        got = {r["date"]: r["value"] for r in both.curves.where(F.col("strategy") == name).collect()}
        assert got.keys() == want.keys() and all(got[d] == pytest.approx(v, abs=1e-6) for d, v in want.items())
        mine, theirs = e.metrics.first().asDict(), both.metrics.where(F.col("strategy") == name).first().asDict()
        assert mine.keys() == theirs.keys()
        for c, v in mine.items():
            assert theirs[c] == (pytest.approx(v, abs=1e-9) if isinstance(v, float) else v)
    table = equity.versus_of_records(both.metrics)
    assert {r["metric"] for r in table.collect()} == {*equity.VERSUS_METRICS, "alpha"}
    old = {r["metric"]: r["difference"] for r in equity.versus_benchmark(apart[0].metrics, apart[1].metrics).collect()}
    assert all(r["difference"] == pytest.approx(old[r["metric"]], abs=1e-9) for r in table.collect())
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
