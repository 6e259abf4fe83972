"""The 21 indicators as ordered window expressions on one long table.

A ticker's windows are bounded: (``ticker_code``, ``date``) is unique, so a ticker
has at most one row per calendar day. A repeated day raises at run time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeline.functions import ewm
from tapeline.functions.numeric import nan_to_null, ratio
from tapeline.schemas import INDICATOR_NAMES

REQUIRED_COLUMNS = ["date", "high", "low", "close", "adj_close", "volume"]

# Rows needed for the first valid value of each indicator.
LOOKBACK = {
    "ma_5": 5, "ma_10": 10, "ma_20": 20, "ma_50": 50,
    "ma_60": 60, "ma_100": 100, "ma_120": 120, "ma_200": 200,
    "macd": 26, "macd_signal": 34, "macd_hist": 34, "rsi": 15,
    "bb_upper": 20, "bb_mid": 20, "bb_lower": 20, "bb_pct": 20,
    "atr": 15, "hv": 21, "stoch_k": 16, "stoch_d": 18, "obv": 1,
}

MACD_FAST, MACD_SLOW, MACD_SIGNAL = 12, 26, 9
WILDER = 14
BAND_ROWS, BAND_WIDTH = 20, 2.0
HV_ROWS, TRADING_DAYS = 20, 252
STOCH_ROWS, STOCH_SMOOTH = 14, 3

_MACD = {"macd", "macd_signal", "macd_hist"}
_BANDS = {"bb_upper", "bb_mid", "bb_lower", "bb_pct"}
_STOCH = {"stoch_k", "stoch_d"}


def lookback_rows(names: list[str] | None = None) -> int:
    """Largest look-back of the named indicators; unknown names need none."""
    picked = INDICATOR_NAMES if names is None else names
    return max((LOOKBACK.get(n, 0) for n in picked), default=0)


def check_names(names: list[str]) -> None:
    unknown = [n for n in names if n not in LOOKBACK]
    if unknown:
        raise ValueError(f"unknown indicators {unknown}; available: {INDICATOR_NAMES}")


def check_columns(bars: DataFrame) -> None:
    missing = [c for c in ["ticker_code", *REQUIRED_COLUMNS] if c not in bars.columns]
    if missing:
        raise ValueError(f"required columns {missing} not found; available: {bars.columns}")
    kind = bars.schema["date"].dataType
    if not isinstance(kind, T.DateType):
        raise ValueError(f"'date' must be a date, got {kind.simpleString()}")


def full_frame(agg: Column, counted: Column | str, window, rows: int) -> Column:
    """Aggregate over the last ``rows`` rows, NULL unless all of them have a value."""
    frame = window.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(counted).over(frame) == rows, agg.over(frame))


def sma(df: DataFrame, column: str, length: int, name: str) -> DataFrame:
    """Simple mean of the last ``length`` rows per ticker."""
    w = Window.partitionBy("ticker_code").orderBy("date")
    return df.withColumn(name, full_frame(F.avg(column), column, w, length))


def log_return(df: DataFrame, column: str, name: str) -> DataFrame:
    """``ln x_t - ln x_(t-1)`` per ticker."""
    w = Window.partitionBy("ticker_code").orderBy("date")
    logged = F.when(F.col(column) > 0, F.log(F.col(column)))
    return df.withColumn(name, logged - F.lag(logged).over(w))


def adjusted_bars(bars: DataFrame) -> DataFrame:
    """Add ``adj_high``, ``adj_low`` and ``adj_volume`` from ``adj_close / close``."""
    factor = ratio(F.col("adj_close"), F.col("close"))
    return bars.withColumns({
        "adj_high": F.col("high") * factor,
        "adj_low": F.col("low") * factor,
        "adj_volume": ratio(F.col("volume").cast("double"), factor),
    })


def _widest_move(before: Column) -> Column:
    hi, lo = F.col("adj_high"), F.col("adj_low")
    return F.greatest(hi - lo, F.abs(hi - before), F.abs(before - lo))


def true_range(bars: DataFrame, name: str = "true_range") -> DataFrame:
    """Widest of the day's range and its distances to the last close; NULL on the first row."""
    w = Window.partitionBy("ticker_code").orderBy("date")
    before = F.last("adj_close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return bars.withColumn(name, F.when(before.isNotNull(), _widest_move(before)))


def repeated_day(w) -> Column:
    """True where a ticker repeats a day, in a window ordered by date."""
    return F.lag("date").over(w) == F.col("date")


def stop_on(test: Column, value: str, message: str) -> Column:
    """``value``, or an error for the ticker when ``test`` holds.

    Placed on a value column rather than a key, so that sorts and partitioning stay valid.
    """
    stop = F.raise_error(F.concat(F.lit(f"{message} for ticker "), F.col("ticker_code")))
    return F.when(test, stop.cast("double")).otherwise(F.col(value).cast("double"))


def with_indicators(bars: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Add one column per indicator (all 21 by default), keeping the input columns.

    NULL bars give NULL indicators; the exponential means carry on over them.
    Days are dates, so that a ticker has one row a day at most.

    Columns are added in a few wide steps, not one by one: each step whose windows
    share a partition and order becomes one window operator.
    """
    names = list(INDICATOR_NAMES) if names is None else list(names)
    check_names(names)
    check_columns(bars)
    want = set(names)
    kept = [c for c in bars.columns if c not in want]
    x, n = F.col("adj_close"), F.col("_n")
    w = Window.partitionBy("ticker_code").orderBy("date")
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)

    lengths = {m: int(m[3:]) for m in names if m.startswith("ma_")}
    lengths |= {"_fast": MACD_FAST, "_slow": MACD_SLOW} if want & _MACD else {}
    signal = bool(want & {"macd_signal", "macd_hist"})
    rates = [ewm.ema_rate(k) for k in lengths.values()]
    rates += [ewm.ema_rate(MACD_SIGNAL)] if signal else []
    rates += [ewm.wilder_rate(WILDER)] if want & {"rsi", "atr"} else []
    span = ewm.block_rows(rates) if rates else 0
    block = "_blk" if rates else None

    # Windows over the input columns.
    df = adjusted_bars(nan_to_null(bars, REQUIRED_COLUMNS))
    step = {"_again": repeated_day(w)}
    if rates:
        step |= {"_n": F.count(x).over(running), "_mean": F.avg(x).over(running)}
    if want & {"rsi", "atr"}:
        step["_last"] = F.last(x, ignorenulls=True).over(before)
    if want & _BANDS:
        step["bb_mid"] = full_frame(F.avg(x), x, w, BAND_ROWS)
        step["_sd"] = full_frame(F.stddev_pop(x), x, w, BAND_ROWS)
    if want & {"hv", "obv"}:
        step["_lag"] = F.lag(x).over(w)
    if want & _STOCH:
        step["_ll"] = full_frame(F.min("adj_low"), "adj_low", w, STOCH_ROWS)
        step["_hh"] = full_frame(F.max("adj_high"), "adj_high", w, STOCH_ROWS)
    if "obv" in want:
        step["_row"] = F.row_number().over(w)
    df = df.withColumns(step)

    # Row-wise terms of the next windows.
    step = {"adj_close": stop_on(F.col("_again"), "adj_close", "repeated day")}
    if want & _BANDS:
        upper = F.col("bb_mid") + F.col("_sd") * BAND_WIDTH
        lower = F.col("bb_mid") - F.col("_sd") * BAND_WIDTH
        step |= {"bb_upper": upper, "bb_lower": lower, "bb_pct": ratio(x - lower, upper - lower)}
    if "hv" in want:
        step["_log"] = F.when((x > 0) & (F.col("_lag") > 0), F.log(x) - F.log("_lag"))
    if want & _STOCH:
        # A flat range puts the close on its low: zero, not undefined.
        width, offset = F.col("_hh") - F.col("_ll"), x - F.col("_ll")
        step["_fast_k"] = F.when(width == 0, offset * 0.0).otherwise(offset * 100.0 / width)
    if "obv" in want:
        sign = F.when(F.col("_row") == 1, F.lit(1.0)).otherwise(F.signum(x - F.col("_lag")))
        step["_flow"] = sign * F.col("adj_volume")
    move = x - F.col("_last")
    decays = [
        ewm.Decay(f"_e_{m}", ewm.ema_terms(x, n, F.col("_mean"), k), ewm.ema_rate(k))
        for m, k in lengths.items()
    ]
    if "rsi" in want:
        decays.append(ewm.Decay("_gain", F.greatest(move, move * 0.0), ewm.wilder_rate(WILDER)))
        decays.append(ewm.Decay("_loss", F.greatest(-move, move * 0.0), ewm.wilder_rate(WILDER)))
    if "atr" in want:
        step["_tr"] = F.when(F.col("_last").isNotNull(), _widest_move(F.col("_last")))
        # The bias correction is the decayed number of terms.
        decays.append(ewm.Decay("_range", F.col("_tr"), ewm.wilder_rate(WILDER)))
        ones = F.when(F.col("_tr").isNotNull(), F.lit(1.0))
        decays.append(ewm.Decay("_weight", ones, ewm.wilder_rate(WILDER)))
    index = n
    if block:
        step["_blk"] = F.greatest(F.floor((n - 1) / F.lit(span)), F.lit(0)).cast("int")
        step["_i"] = n - F.greatest(F.floor((n - 1) / F.lit(span)), F.lit(0)) * span
        index = F.col("_i")
    df = df.withColumns(step)
    # Terms read columns of this step, so they make a projection of their own.
    df = df.withColumns(ewm.powers(decays, index, span)) if decays else df

    # Decayed sums, and the frames over the terms.
    cells, series = w, w
    if block:
        cells = Window.partitionBy("ticker_code", block).orderBy("date")
        series = Window.partitionBy("ticker_code").orderBy(block, "date")
    cells = cells.rowsBetween(Window.unboundedPreceding, 0)
    frames = {}
    if "hv" in want:
        spread = full_frame(F.stddev_samp("_log"), "_log", series, HV_ROWS)
        frames["hv"] = spread * math.sqrt(TRADING_DAYS)
    if want & _STOCH:
        frames["stoch_k"] = full_frame(F.avg("_fast_k"), "_fast_k", series, STOCH_SMOOTH)
    if "obv" in want:
        total = F.sum("_flow").over(series.rowsBetween(Window.unboundedPreceding, 0))
        frames["obv"] = F.when(F.col("_flow").isNotNull(), total)
    if "atr" in want:
        frames["_n_tr"] = F.count("_tr").over(series.rowsBetween(Window.unboundedPreceding, 0))
    is_end = x.isNotNull() & (index == span)
    past = series.rowsBetween(Window.unboundedPreceding, -1)
    if block:
        df = df.withColumns(ewm.sums(decays, cells))
        frames |= ewm.earlier_ends(decays, is_end, past)
    else:
        frames |= ewm.sums(decays, cells)
    df = df.withColumns(frames) if frames else df
    if block:
        df = df.withColumns(ewm.results(decays, index, span, block))

    ready = {
        m: F.when(x.isNotNull() & (n >= k), F.col(f"_e_{m}")) for m, k in lengths.items()
    }
    if "rsi" in want:
        share = ratio(F.col("_gain") * 100.0, F.col("_gain") + F.col("_loss"))
        ready["rsi"] = F.when(x.isNotNull() & (n > WILDER), share)
    if "atr" in want:
        enough = F.col("_tr").isNotNull() & (F.col("_n_tr") >= WILDER)
        ready["atr"] = F.when(enough, F.col("_range") / F.col("_weight"))
    if want & _MACD:
        ready["macd"] = ready["_fast"] - ready["_slow"]
    df = df.withColumns(ready) if ready else df
    late = {}
    if want & _STOCH:
        late["stoch_d"] = full_frame(F.avg("stoch_k"), "stoch_k", series, STOCH_SMOOTH)
    if signal:
        seed = F.avg("macd").over(series.rowsBetween(Window.unboundedPreceding, 0))
        late["_line_mean"] = seed
    df = df.withColumns(late) if late else df
    if signal:
        df = _macd_signal(df, index, span, block, cells, is_end, past)
    return df.select(*kept, *names)


def _macd_signal(df: DataFrame, index, span, block, cells, is_end, past) -> DataFrame:
    n, line, skip = F.col("_n"), F.col("macd"), MACD_SLOW - 1
    terms = ewm.ema_terms(line, n, F.col("_line_mean"), MACD_SIGNAL, skip)
    decays = [ewm.Decay("_e_sig", terms, ewm.ema_rate(MACD_SIGNAL))]
    df = df.withColumns(ewm.powers(decays, index, span)).withColumns(ewm.sums(decays, cells))
    if block:
        df = df.withColumns(ewm.earlier_ends(decays, is_end, past, "_sig_ends"))
        df = df.withColumns(ewm.results(decays, index, span, block, "_sig_ends"))
    valid = line.isNotNull() & (n >= MACD_SIGNAL + skip)
    signal = F.when(valid, F.col("_e_sig"))
    return df.withColumns({"macd_signal": signal, "macd_hist": line - signal})
