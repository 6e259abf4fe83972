"""Training: label, drop incomplete rows, split in time, search, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.operators.labels import forward_label, training_rows
from tapeline.operators.learn import SignalModel, accuracy, classification_report, grid_search
from tapeline.operators.timesplit import with_folds, with_split
from tapeline.session import materialize

# The model's feature columns.
FEATURES = [
    "ma_5", "ma_10", "ma_20", "ma_50", "ma_60", "ma_100", "ma_120", "ma_200",
    "macd", "macd_signal", "macd_hist",
]


@dataclass
class Training:
    model: SignalModel
    accuracy: DataFrame
    report: DataFrame
    scores: list
    train: DataFrame


def train_signals(
    table: DataFrame, features: list[str] | None = None, horizon: int = 5, threshold: float = 0.02,
    test_share: float = 0.2, n_splits: int = 5, scale_per_fold: bool = False,
) -> Training:
    """Train on a table of bars and indicators.

    The labelled rows are written once to the shared folder: the splits, the scaler and
    every fit read them again, and a lost executor must not recompute the indicators.
    """
    features = list(FEATURES) if features is None else features
    complete = training_rows(forward_label(table, horizon, threshold), features)
    rows = materialize(complete.select("ticker_code", "date", *features, "label"))
    if rows.isEmpty():
        raise ValueError("no complete rows; widen the date range")
    split = with_split(rows, test_share)
    train = with_folds(split.where(F.col("split") == "train").drop("split"), n_splits)
    model, scores = grid_search(train, features, scale_per_fold=scale_per_fold)
    held_out = split.where(F.col("split") == "test").drop("split")
    scored = model.score(held_out, beside=["ticker_code", "date", "label"])
    return Training(model, accuracy(scored), classification_report(scored), scores, train)
