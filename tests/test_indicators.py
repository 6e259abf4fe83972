"""Indicators against pandas, on short, long and gappy series."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeline.functions import ewm
from tapeline.functions.indicators import LOOKBACK, with_indicators
from tapeline.schemas import INDICATOR_NAMES


def frame(df):
    return df.orderBy("ticker_code", "date").toPandas()


def pandas_ema(x: pd.Series, n: int) -> pd.Series:
    """Seeded EMA over the values of ``x``, NaN rows left out."""
    v = x.dropna()
    if len(v) < n:
        return pd.Series(np.nan, index=x.index)
    seeded = pd.concat([pd.Series([v.iloc[:n].mean()], index=[v.index[n - 1]]), v.iloc[n:]])
    return seeded.ewm(span=n, adjust=False).mean().reindex(x.index)


def expected(p: pd.DataFrame) -> pd.DataFrame:
    """All indicators of one ticker by pandas."""
    x = p["adj_close"]
    f = x / p["close"]
    hi, lo, vol = p["high"] * f, p["low"] * f, p["volume"] / f
    out = pd.DataFrame(index=p.index)
    for n in (5, 10, 20, 50, 60, 100, 120, 200):
        out[f"ma_{n}"] = pandas_ema(x, n)
    out["macd"] = pandas_ema(x, 12) - pandas_ema(x, 26)
    out["macd_signal"] = pandas_ema(out["macd"], 9)
    out["macd_hist"] = out["macd"] - out["macd_signal"]
    v = x.dropna()
    move = v.diff()
    mean = lambda s: s.ewm(alpha=1 / 14, min_periods=14).mean()
    up, down = mean(move.clip(lower=0)), mean((-move).clip(lower=0))
    out["rsi"] = (100 * up / (up + down)).reindex(x.index)
    out["bb_mid"], sd = x.rolling(20).mean(), x.rolling(20).std(ddof=0)
    out["bb_upper"], out["bb_lower"] = out["bb_mid"] + 2 * sd, out["bb_mid"] - 2 * sd
    out["bb_pct"] = (x - out["bb_lower"]) / (out["bb_upper"] - out["bb_lower"])
    before = v.shift().reindex(x.index)
    tr = pd.concat([hi - lo, (hi - before).abs(), (before - lo).abs()], axis=1).max(axis=1)[before.notna()]
    out["atr"] = mean(tr).reindex(x.index)
    out["hv"] = np.log(x).diff().rolling(20).std() * np.sqrt(252)
    ll, hh = lo.rolling(14).min(), hi.rolling(14).max()
    out["stoch_k"] = (100 * (x - ll) / (hh - ll)).rolling(3).mean()
    out["stoch_d"] = out["stoch_k"].rolling(3).mean()
    sign = np.sign(x.diff())
    sign.iloc[0] = 1.0
    out["obv"] = (sign * vol).cumsum()
    return out[INDICATOR_NAMES]


def random_bars(spark, days: int, codes: list[str], missing: float = 0.0):
    rng = np.random.default_rng(7)
    parts = []
    for code in codes:
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, days)))
        p = pd.DataFrame({
            "ticker_code": code, "date": pd.date_range("1990-01-01", periods=days).date,
            "open": close, "high": close * (1 + rng.uniform(0, 0.02, days)),
            "low": close * (1 - rng.uniform(0, 0.02, days)), "close": close,
            "adj_close": close * 0.9, "volume": rng.integers(1000, 9000, days).astype(float),
        })
        values = ["open", "high", "low", "close", "adj_close", "volume"]
        p.loc[rng.uniform(size=days) < missing, values] = np.nan
        parts.append(p)
    whole = pd.concat(parts, ignore_index=True)
    schema = "ticker_code string, date date, open double, high double, low double, close double, adj_close double, volume double"
    return spark.createDataFrame(whole, schema), whole


def compare(got: pd.DataFrame, want: pd.DataFrame, skip: tuple[str, ...] = ()):
    for name in [n for n in INDICATOR_NAMES if n not in skip]:
        a, b = got[name].to_numpy(float), want[name].to_numpy(float)
        assert (np.isnan(a) == np.isnan(b)).all(), name
        np.testing.assert_allclose(a, b, rtol=1e-8, atol=1e-7, err_msg=name)


def test_all_indicators_match_pandas(spark):
    bars, whole = random_bars(spark, 400, ["A.KS", "B"])
    got = frame(with_indicators(bars))
    want = pd.concat([expected(p) for _, p in whole.groupby("ticker_code")], ignore_index=True)
    compare(got, want)


def test_many_blocks_match_pandas(spark, monkeypatch):
    # Blocks of about 29 rows: every average carries over several of them.
    monkeypatch.setattr(ewm, "_HALF_SPAN", 6.0)
    bars, whole = random_bars(spark, 700, ["A.KS", "B"])
    got = frame(with_indicators(bars))
    want = pd.concat([expected(p) for _, p in whole.groupby("ticker_code")], ignore_index=True)
    compare(got, want)


def test_long_series_stays_finite(spark):
    bars, whole = random_bars(spark, 9000, ["A.KS"])
    compare(frame(with_indicators(bars)), expected(whole))


@pytest.mark.parametrize("blocks", [True, False])
def test_missing_bars(spark, monkeypatch, blocks):
    monkeypatch.setattr(ewm, "_HALF_SPAN", 40.0 if blocks else 600.0)
    bars, whole = random_bars(spark, 500, ["A.KS"], missing=0.01)
    got, want = frame(with_indicators(bars)), expected(whole)
    compare(got, want, skip=("obv",))
    assert got["obv"].isna().sum() >= whole["adj_close"].isna().sum()


def test_valid_counts(rising):
    got = frame(with_indicators(rising))
    for name in INDICATOR_NAMES:
        assert got[name].notna().sum() == len(got) - LOOKBACK[name] + 1, name
    assert set(rising.columns) <= set(got.columns)


def test_invariants(spark):
    bars, _ = random_bars(spark, 400, ["A.KS"])
    got = frame(with_indicators(bars))
    for name in ("rsi", "stoch_k", "stoch_d"):
        assert got[name].dropna().between(0, 100).all()
    known = got.dropna()
    assert (known["bb_lower"] <= known["bb_mid"]).all() and (known["bb_mid"] <= known["bb_upper"]).all()


def test_zero_close_has_no_range(rising):
    got = frame(with_indicators(rising.withColumn("close", F.lit(0.0)), ["atr"]))
    assert got["atr"].isna().all()


def test_short_and_empty_series(make_bars):
    short = make_bars({"A": [100.0 + i for i in range(100)]})
    assert frame(with_indicators(short, ["ma_200"]))["ma_200"].isna().all()
    blank = make_bars({"A": [None] * 10})
    assert frame(with_indicators(blank))[INDICATOR_NAMES].isna().all().all()
    assert with_indicators(short, []).columns == short.columns


def test_flat_prices(make_bars):
    got = frame(with_indicators(make_bars({"A": [50.0] * 60})))
    assert np.allclose(got["ma_20"].dropna(), 50.0) and got["rsi"].isna().all() and got["bb_pct"].isna().all()


def test_bad_input(spark, rising):
    with pytest.raises(ValueError, match="adj_close"):
        with_indicators(rising.drop("adj_close"), ["ma_5"])
    with pytest.raises(ValueError, match="date"):
        with_indicators(rising.withColumn("date", F.col("date").cast("string")), ["ma_5"])
    with pytest.raises(ValueError, match="must be a date"):
        with_indicators(rising.withColumn("date", F.col("date").cast("timestamp")), ["ma_5"])
    with pytest.raises(ValueError, match="unknown"):
        with_indicators(rising, ["nope"])
    with pytest.raises(Exception, match="repeated day"):
        with_indicators(rising.unionByName(rising.limit(3)), ["ma_5"]).collect()


def test_one_exchange_and_two_sorts(spark, rising, tmp_path):
    path = str(tmp_path / "bars")
    rising.write.parquet(path)
    stored = spark.read.parquet(path)
    plan = with_indicators(stored)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 2
    lean = with_indicators(stored, ["ma_5"]).select("date", "ma_5")._jdf.queryExecution().executedPlan().toString()
    assert "volume" not in lean.split("ReadSchema")[1]
