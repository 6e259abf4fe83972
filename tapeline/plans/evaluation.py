"""Signal evaluation: signals to positions, equity, metrics, benchmark."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tapeline.operators import equity
from tapeline.operators.learn import BACKTEST_THRESHOLD, SignalModel, model_signals
from tapeline.operators.positions import Account, Rules, closed_trades, streamed_positions
from tapeline.session import materialize, small_table
from tapeline.sources.store import write_metrics

# The default rule parameters.
DEFAULT_RULES = Rules(
    holding_period=5, use_stop_loss=True, stop_loss_pct=0.05,
    use_take_profit=False, take_profit_pct=0.10, position_weight=None,
)


@dataclass
class Evaluation:
    trades: DataFrame
    curve: DataFrame
    metrics: DataFrame


def evaluate_signals(
    signalled: DataFrame, rules: Rules = DEFAULT_RULES, account: Account = Account(),
    name: str = "strategy",
) -> Evaluation:
    """Positions, equity curve and metrics of bars that carry a signal.

    The positions are written once: the trade log, the curve and the metrics read them.
    """
    held = materialize(streamed_positions(signalled, rules, account))
    trades = closed_trades(held, account)
    profit = equity.position_profit(signalled, held, account)
    curve = equity.equity_curve(profit, account, name)
    return Evaluation(trades, curve, equity.performance(curve, trades, name, account))


def evaluate_hold(bars: DataFrame, account: Account = Account(), name: str = "benchmark") -> Evaluation:
    """Buy and hold of the same bars; it closes no trade."""
    curve = equity.equity_curve(equity.hold_profit(bars, account), account, name)
    none = small_table(bars.sparkSession, [], "pnl_net double")
    return Evaluation(none, curve, equity.performance(curve, none, name, account))


@dataclass
class Comparison:
    """A strategy beside buy and hold of the same bars: both curves and both metrics records under one another."""

    trades: DataFrame
    curves: DataFrame
    metrics: DataFrame


def evaluate_both(
    signalled: DataFrame, rules: Rules = DEFAULT_RULES, account: Account = Account(),
    name: str = "strategy", benchmark: str = "benchmark",
) -> Comparison:
    """``evaluate_signals`` and ``evaluate_hold`` in one pass over the bars and one over the days."""
    held = materialize(streamed_positions(signalled, rules, account))
    trades = closed_trades(held, account)
    curves = equity.both_curves(equity.both_profits(signalled, held, account), account, name, benchmark)
    return Comparison(trades, curves, equity.both_performances(curves, trades, name, benchmark, account))


def evaluate_model(
    table: DataFrame, model: SignalModel, rules: Rules = DEFAULT_RULES, account: Account = Account(),
    threshold: float = BACKTEST_THRESHOLD, csv_path: str | None = None,
) -> Evaluation:
    """Score a table of bars and indicators, replay the signals, optionally write the metrics CSV."""
    # Scored in place, so bars and signals need no join; sizes, folds and curves read what is written here.
    result = evaluate_signals(materialize(model_signals(table, model, threshold, ["close"])), rules, account)
    if csv_path:
        write_metrics(result.metrics, csv_path)
    return result
