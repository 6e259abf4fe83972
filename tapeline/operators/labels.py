"""Forward-return labels, class balance and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions.numeric import ratio, rounded


def forward_label(
    bars: DataFrame, horizon: int = 5, threshold: float = 0.02, price: str = "adj_close"
) -> DataFrame:
    """Add ``label``: 1 when the price rises by ``threshold`` or more in ``horizon`` rows.

    A missing price on either end gives 0; the last ``horizon`` rows of a ticker are NULL.
    """
    for c in (price, "date"):
        if c not in bars.columns:
            raise ValueError(f"no column {c!r} to label from")
    w = Window.partitionBy("ticker_code").orderBy("date")
    later = F.lead(price, horizon).over(w)
    has_future = F.lead(F.lit(1), horizon).over(w).isNotNull()
    gain = rounded(ratio(later - F.col(price), F.col(price)))
    up = F.coalesce(gain >= threshold, F.lit(False)).cast("double")
    return bars.withColumn("label", F.when(has_future, up))


def label_balance(labelled: DataFrame) -> DataFrame:
    """Labelled rows and the shares of both classes."""
    known = labelled.where(F.col("label").isNotNull())
    return known.agg(
        F.count("*").alias("n_rows"),
        F.avg("label").alias("up_share"),
        (F.lit(1.0) - F.avg("label")).alias("down_share"),
    )


def class_weights(labelled: DataFrame) -> DataFrame:
    """``n / (2 n_c)`` per class, from a map-side combined count of two groups."""
    counts = labelled.where(F.col("label").isNotNull()).groupBy("label").agg(F.count("*").alias("n_rows"))
    total = F.sum("n_rows").over(Window.partitionBy())
    return counts.withColumn("weight", total / (F.col("n_rows") * 2.0))


def training_rows(labelled: DataFrame, features: list[str]) -> DataFrame:
    """Rows with every feature and a label."""
    return labelled.dropna(subset=[*features, "label"])
