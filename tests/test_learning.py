"""Labels, time splits, the model search and the composite jobs."""

from __future__ import annotations

import math
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tapeline.operators import labels, learn, timesplit
from tapeline.plans import evaluation, training
from tapeline.plans.indicators import full_table, indicator_version_counts, refresh_all
from tapeline.plans.prices import Paths
from tapeline.schemas import SESSIONS
from tapeline.sources import store


@pytest.mark.parametrize("start, end, threshold, label", [
    (100.0, 110.0, 0.02, 1), (100.0, 110.0, 0.05, 1), (100.0, 110.0, 0.10, 1), (100.0, 102.5, 0.02, 1),
    (100.0, 100.01, 0.0, 1), (100.0, 101.5, 0.02, 0), (100.0, 98.0, 0.02, 0),
])
def test_threshold(make_bars, start, end, threshold, label):
    rows = labels.forward_label(make_bars({"A": [start, end]}), 1, threshold).orderBy("date").collect()
    assert [r["label"] for r in rows] == [label, None]


def test_missing_prices_and_ends(make_bars):
    prices = [100.0, None, 102.0, None, 104.0, None, 106.0, None, 108.0, 109.0]
    bars = make_bars({"A": prices, "B": [1.0]})
    got = labels.forward_label(bars, 1).orderBy("ticker_code", "date").collect()
    assert [r["label"] for r in got[:10]] == [0.0] * 9 + [None] and got[10]["label"] is None
    # Tickers do not run into each other, and the horizon ends are NULL.
    two = labels.forward_label(make_bars({"A": [1.0] * 7, "B": [9.0] * 7})).where("label is null")
    assert two.count() == 10
    with pytest.raises(ValueError, match="adj_close"):
        labels.forward_label(bars.drop("adj_close"))
    with pytest.raises(ValueError, match="date"):
        labels.forward_label(bars.drop("date"))


def test_balance_and_weights(spark):
    df = spark.createDataFrame([(1.0,)] * 3 + [(0.0,)] + [(None,)], "label double")
    r = labels.label_balance(df).first()
    assert (r["n_rows"], r["up_share"], r["down_share"]) == (4, 0.75, 0.25)
    assert {x["label"]: x["weight"] for x in labels.class_weights(df).collect()} == {1.0: 4 / 6, 0.0: 2.0}


@pytest.mark.parametrize("days, per_day, test_share, n_splits", [(7, 13, 0.2, 5), (1, 40, 0.2, 5), (2, 9, 0.5, 2), (30, 1, 0.25, 4)])
def test_time_splits(spark, days, per_day, test_share, n_splits):
    codes = [f"T{i:03d}" for i in range(per_day)] + ["ABCDE1", "ABCDE2"]
    start = date(2020, 1, 1)
    rows = sorted((start + timedelta(days=d), c) for d in range(days) for c in codes)
    df = spark.createDataFrame(rows, "date date, ticker_code string").repartition(5)
    n = len(rows)
    got = {(r["date"], r["ticker_code"]): r["split"] for r in timesplit.with_split(df, test_share).collect()}
    n_train = n - math.ceil(test_share * n)
    assert [got[r] for r in rows] == ["train"] * n_train + ["test"] * (n - n_train)
    folds = {(r["date"], r["ticker_code"]): r["fold"] for r in timesplit.with_folds(df, n_splits).collect()}
    size = n // (n_splits + 1)
    assert [folds[r] for r in rows] == [max(0, n_splits - (n - 1 - i) // size) for i in range(n)]


def test_too_few_rows(spark):
    df = spark.createDataFrame([(date(2020, 1, 1), "A")], "date date, ticker_code string")
    with pytest.raises(ValueError):
        timesplit.with_folds(df, 5)


FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    """Two tickers over 400 days with labels that depend on the features."""
    rng = np.random.default_rng(3)
    n = 800
    x = rng.normal([5, 0, -2], [2, 1, 3], (n, 3))
    p = 1 / (1 + np.exp(-(0.8 * (x[:, 0] - 5) - 1.2 * x[:, 1] + 0.2)))
    pdf = pd.DataFrame(x, columns=FEATURES)
    pdf["label"] = (rng.uniform(size=n) < p).astype(float)
    pdf["date"] = [date(2020, 1, 1) + timedelta(days=i // 2) for i in range(n)]
    pdf["ticker_code"] = ["A.KS" if i % 2 else "B" for i in range(n)]
    return spark.createDataFrame(pdf).withColumn("date", F.col("date").cast("date")).cache()


def test_scaler_uses_population_deviation(rows):
    out = learn.scaler(rows, FEATURES).transform(rows)
    r = out.agg(*[F.avg(f"z_{c}") for c in FEATURES], *[F.stddev_pop(f"z_{c}") for c in FEATURES]).first()
    np.testing.assert_allclose(list(r), [0, 0, 0, 1, 1, 1], atol=1e-9)
    flat = rows.withColumn("a", F.lit(4.0))
    assert learn.scaler(flat, ["a"]).transform(flat).agg(F.max("z_a")).first()[0] == 0.0


def brute_search(rows):
    """The same search with one MLlib fit per candidate and fold."""
    scaled = learn.scaler(rows, FEATURES).transform(timesplit.with_folds(rows))
    data = VectorAssembler(inputCols=[f"z_{c}" for c in FEATURES], outputCol="features").transform(scaled).cache()
    out = {}
    for c in (0.01, 100.0):
        for weight in (None, "balanced"):
            scores = []
            for fold in range(1, 6):
                part = data.where(F.col("fold") < fold)
                sizes = {r["label"]: r["count"] for r in part.groupBy("label").count().collect()}
                model = learn._fit(part, learn.Candidate(c, weight, 1000), sizes)
                hit = (F.col("prediction") == F.col("label")).cast("double")
                scores.append(model.transform(data.where(F.col("fold") == fold)).agg(F.avg(hit)).first()[0])
            out[c, weight] = sum(scores) / 5
    return out


def test_search_equals_one_fit_per_candidate(rows):
    model, outcome = learn.grid_search(timesplit.with_folds(rows), FEATURES)
    assert len(outcome) == 20 and model.cv_score == max(s for _, s in outcome)
    first = next(c for c, s in outcome if s == model.cv_score)
    assert model.best == first
    for (c, weight), score in brute_search(rows).items():
        mine = [s for cand, s in outcome if (cand.c, cand.class_weight) == (c, weight)]
        assert mine == pytest.approx([score, score], abs=1e-12)


def test_newton_reaches_the_mllib_optimum(rows):
    scaled = learn.scaler(rows, FEATURES).transform(rows).withColumn("fold", F.lit(0))
    names = [f"z_{c}" for c in FEATURES]
    problem = learn._Problem(1, 1 / 0.5, {0.0: 1.0, 1.0: 1.0}, np.zeros(4))
    for _ in range(30):
        learn._newton_step(problem, learn._summed_parts(scaled, names, [problem], {1: (np.zeros(3), np.ones(3))})[0])
        if problem.settled:
            break
    data = VectorAssembler(inputCols=names, outputCol="features").transform(scaled)
    fit = LogisticRegression(regParam=1 / (0.5 * 800), standardization=False, tol=1e-12, maxIter=500).fit(data)
    np.testing.assert_allclose(problem.beta, [fit.intercept, *fit.coefficients], atol=1e-6)


def test_predict_save_load(spark, rows, tmp_path):
    model = learn.fit_model(rows, FEATURES, learn.Candidate(1.0, None, 1000))
    assert model.evaluate(rows).first()["test_accuracy"] > 0.7
    scored = model.predict(rows, 0.57).select("p1", "prediction").collect()
    assert all((r["p1"] >= 0.57) == (r["prediction"] == 1.0) for r in scored)
    path = str(tmp_path / "model")
    model.save(path)
    again = learn.SignalModel.load(spark, path)
    assert again.best == model.best and again.saved_at and again.features == FEATURES
    a = model.score(rows).orderBy("date", "ticker_code").select("p1").toPandas()
    b = again.score(rows).orderBy("date", "ticker_code").select("p1").toPandas()
    pd.testing.assert_frame_equal(a, b)
    with pytest.raises(ValueError):
        model.score(rows.drop("a"))
    learn.check_features(rows, FEATURES, ["label", "date", "ticker_code"])
    with pytest.raises(ValueError, match="extra"):
        learn.check_features(rows, ["a", "b"], ["label", "date", "ticker_code"])


def test_tickers_with_gaps_get_no_signal(rows):
    model = learn.fit_model(rows, FEATURES, learn.Candidate(1.0, None, 1000))
    one = (F.col("ticker_code") == "B") & (F.col("date") == "2020-03-01")
    holed = rows.withColumn("b", F.when(~one, F.col("b")))
    signals = learn.model_signals(holed, model)
    assert [r[0] for r in signals.select("ticker_code").distinct().collect()] == ["A.KS"]
    assert {r[0] for r in signals.select("signal").distinct().collect()} == {0, 1}


def test_report(spark):
    pairs = [(0.0, 0.0)] * 3 + [(0.0, 1.0)] + [(1.0, 0.0)] * 2
    df = spark.createDataFrame(pairs, "label double, prediction double")
    got = {r["row"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in learn.classification_report(df).collect()}
    assert got["0"] == pytest.approx((0.6, 0.75, 2 / 3, 4))
    assert got["1"] == (0.0, 0.0, 0.0, 2)
    assert got["accuracy"] == pytest.approx((0.5, 0.5, 0.5, 6))
    assert got["macro avg"][2] == pytest.approx(1 / 3) and got["weighted avg"][2] == pytest.approx(4 / 9)


def test_whole_run(spark, tmp_path):
    """Refresh, train and evaluate end to end on stored tables."""
    rng = np.random.default_rng(11)
    start, days = date(2020, 1, 1), 420
    parts = []
    for code in ("A.KS", "B.KS", "C"):
        close = (100 * np.exp(np.cumsum(rng.normal(0.001, 0.03, days)))).tolist()
        parts += [(code, start + timedelta(days=i), c, c * 1.01, c * 0.99, c, int(1000 + i), c) for i, c in enumerate(close)
                  if not (code == "B.KS" and i == 200)]
    source = spark.createDataFrame(parts, "ticker_code string, date date, open double, high double, low double, close double, volume long, adj_close double")
    sessions = spark.createDataFrame([(e, start + timedelta(days=i)) for e in ("XKRX", "XNYS") for i in range(days)], SESSIONS)
    paths = Paths(str(tmp_path / "t"), str(tmp_path / "p"), str(tmp_path / "i"))
    names = ["ma_5", "ma_20", "macd"]
    args = dict(start="2020-04-01", end="2021-02-01", names=names)
    table = refresh_all(spark, paths, source, sessions, ["A.KS", "B.KS", "C", "NONE"], **args).cache()
    assert table.agg(F.min("date"), F.max("date")).first() == (date(2020, 4, 1), date(2021, 1, 31))
    assert table.where("date = '2020-07-19' and ticker_code = 'B.KS' and close is null and ma_5 is null").count() == 1
    assert store.read_tickers(spark, paths.tickers).count() == 3
    assert indicator_version_counts(spark, paths).first()["n_rows"] == table.count()
    lazy = full_table(source, sessions, ["A.KS", "B.KS", "C"], date(2020, 4, 1), date(2021, 2, 1), names)
    both = table.select("ticker_code", "date", F.col("ma_20").alias("x")).join(lazy, ["ticker_code", "date"])
    assert both.count() == table.count() and both.where("abs(x - ma_20) > 1e-6").isEmpty()
    # A second run changes nothing.
    again = refresh_all(spark, paths, source, sessions, ["A.KS", "B.KS", "C"], **args)
    assert again.count() == table.count()
    done = training.train_signals(table, ["ma_5", "ma_20", "macd"])
    assert done.accuracy.first()["n_rows"] > 0 and len(done.scores) == 20
    result = evaluation.evaluate_model(table.dropna(), done.model, threshold=0.4, csv_path=str(tmp_path / "m"))
    metrics = result.metrics.first()
    assert metrics["trading_days"] > 300 and metrics["total_trades"] == result.trades.count()
    saved = spark.read.option("header", True).csv(str(tmp_path / "m"))
    assert saved.count() == 1 and "sharpe_ratio" in saved.columns


def test_fold_statistics_match_separate_passes(spark, rows):
    table = timesplit.with_folds(rows).withColumn("d", F.lit(7.0)).withColumn("e", F.when(F.col("fold") > 1, F.col("a") * 1e6 + 1e9))
    names = [*FEATURES, "d", "e"]
    got = {(r["fold"], r["feature"]): r for r in learn.fold_statistics(table, names).collect()}
    for fold in range(1, 6):
        part = table.where(F.col("fold") < fold)
        for c in names:
            n, mean, deviation = part.agg(F.count(c), F.avg(c), F.stddev_pop(c)).first()
            if n == 0:
                assert (fold, c) not in got
                continue
            r = got[fold, c]
            assert r["n_rows"] == n and r["mean"] == pytest.approx(mean, rel=1e-12)
            assert r["deviation"] == pytest.approx(deviation, rel=1e-9, abs=1e-9)


def test_search_with_a_scaler_for_each_fold(spark, rows):
    """Every fold's scores equal a fit on rows that were standardised by what the fold trains on."""
    train = timesplit.with_folds(rows)
    _, outcome = learn.grid_search(train, FEATURES, scale_per_fold=True, limits=[1000])
    wanted = learn.Candidate(0.01, None, 1000)
    shares = []
    for fold in range(1, 6):
        part, own = train.where(F.col("fold") < fold), train.where(F.col("fold") == fold)
        model = learn.fit_model(part, FEATURES, wanted)
        shares.append(model.evaluate(own).first()["test_accuracy"])
    assert dict(outcome)[wanted] == pytest.approx(sum(shares) / 5)


def test_iteration_limits_are_scored_by_their_own_states(spark, rows):
    train = timesplit.with_folds(rows)
    _, both = learn.grid_search(train, FEATURES, limits=[1, 1000])
    _, low = learn.grid_search(train, FEATURES, limits=[1])
    _, high = learn.grid_search(train, FEATURES)
    both, low, high = dict(both), dict(low), dict(high)
    assert low == {c: s for c, s in both.items() if c.max_iter == 1}
    for c, s in both.items():
        if c.max_iter == 1000:
            assert s == high[c]
    assert any(both[c] != both[learn.Candidate(c.c, c.class_weight, 1000)] for c in low)
    with pytest.raises(ValueError):
        learn.grid_search(train, FEATURES, limits=[0])


def test_certificate_tells_the_best_fit(spark, rows):
    for weight in (None, "balanced"):
        model = learn.fit_model(rows, FEATURES, learn.Candidate(1.0, weight, 1000))
        slopes = {r["name"]: r["gradient"] for r in learn.certificate(model, rows).collect()}
        assert set(slopes) == {"intercept", *FEATURES} and max(map(abs, slopes.values())) < 1e-5
        worse = learn.SignalModel(FEATURES, model.steps, learn.Candidate(1e-4, weight, 1000), 0.0)
        assert max(abs(r["gradient"]) for r in learn.certificate(worse, rows).collect()) > 1e-3


def test_exact_feature_set_when_scoring(spark, rows):
    model = learn.fit_model(rows, FEATURES, learn.Candidate(1.0, None, 1000))
    beside = [c for c in rows.columns if c not in FEATURES]
    assert model.score(rows, beside=beside).count() == rows.count()
    with pytest.raises(ValueError, match="extra"):
        model.score(rows.withColumn("z", F.lit(1.0)), beside=beside)
    with pytest.raises(ValueError, match="missing"):
        model.score(rows.drop("a"), beside=beside)


@pytest.mark.parametrize("error", [0.2, 0.01, 0.001])
def test_sketched_cut_keeps_its_error(spark, error):
    rng = np.random.default_rng(8)
    days = [date(2020, 1, 1) + timedelta(days=int(abs(d))) for d in rng.normal(0, 300, 20_000)]
    df = spark.createDataFrame([(d, "A") for d in days], "date date, ticker_code string").repartition(7)
    cut = timesplit.sketched_cut(df, 0.2, error)
    before, upto = sum(d < cut.day for d in days), sum(d <= cut.day for d in days)
    assert (cut.n_rows, cut.wanted) == (20_000, 16_000)
    assert before <= cut.wanted + cut.allowed() and upto >= cut.wanted - cut.allowed()
    split = timesplit.with_sketched_split(df, 0.2, error).groupBy("split").count().collect()
    assert {r[0]: r[1] for r in split} == {k: n for k, n in (("train", upto), ("test", 20_000 - upto)) if n}
    exact = timesplit.with_split(df.withColumn("ticker_code", F.monotonically_increasing_id().cast("string")))
    last = exact.where("split = 'train'").agg(F.max("date")).first()[0]
    lower, upper = sorted((last, cut.day))
    assert sum(lower < d < upper for d in days) <= cut.allowed()
    assert timesplit.sketched_cut(df.limit(0)) is None
    with pytest.raises(ValueError):
        timesplit.sketched_cut(df, 0.2, 0.0)


def test_collinear_features_take_few_steps(spark):
    """Averages of one price: near copies of each other and an exact sum; the fit is the best one within a hundred steps."""
    rng = np.random.default_rng(5)
    walk = 100 + np.cumsum(rng.normal(0, 1, 3000))
    near = walk + rng.normal(0, 0.05, 3000)
    far = walk + rng.normal(0, 1, 3000)
    up = (rng.normal(0, 1, 3000) + 4 * (near - walk) + 0.1 * (far - walk) > 0.1).astype(float)
    names = ["a", "b", "c", "d"]
    rows = spark.createDataFrame(
        [tuple(map(float, r)) for r in zip(walk, near, far, near - far, up)], "a double, b double, c double, d double, label double"
    ).cache()
    for weight in (None, "balanced"):
        model = learn.fit_model(rows, names, learn.Candidate(100.0, weight, 1000))
        assert model.steps.stages[-1].summary.totalIterations < 100
        assert max(abs(r["gradient"]) for r in learn.certificate(model, rows).collect()) < 1e-6
    assert set(model.score(rows).columns) == {*names, "label", "p1", "prediction"}
    flat = spark.createDataFrame([(1.0, 0.0), (1.0, 1.0)], "a double, label double")
    assert learn.fit_model(flat, ["a"], learn.Candidate(1.0, None, 10)).score(flat).first()["p1"] == pytest.approx(0.5)
    rows.unpersist()
