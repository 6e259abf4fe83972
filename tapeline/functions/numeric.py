"""Numeric edge handling: NaN, bad text, rounding, safe division."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Replace NaN by NULL in the float columns (all of them by default)."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    picked = floats if columns is None else [c for c in columns if c in floats]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in picked}) if picked else df


def to_double(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cast to double; text that is not a number becomes NULL."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: F.col(c).try_cast("double") for c in present})


def rounded(c: Column, digits: int = 8) -> Column:
    """Round half up in double arithmetic, without a negative zero.

    For values that are compared or published: plain arithmetic gives the same result
    in every engine, also for values that lie just halfway. NaN becomes NULL.
    """
    scale = float(10 ** digits)
    return F.when(~F.isnan(c), F.floor(c * scale + 0.5) / scale + 0.0)


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, NULL when ``b`` is zero."""
    return F.try_divide(a, b)
