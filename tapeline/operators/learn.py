"""Logistic-regression signals with MLlib: scaling, grid search over time folds, scoring."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import PCA, PCAModel, SQLTransformer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeline.functions.numeric import ratio

# The grid, in the order in which ties are decided.
GRID_C = [0.01, 0.1, 1.0, 10.0, 100.0]
GRID_CLASS_WEIGHT = [None, "balanced"]
GRID_MAX_ITER = [1000, 2000]
N_SPLITS = 5
BACKTEST_THRESHOLD = 0.57
DEFAULT_THRESHOLD = 0.5
# Directions with a smaller share of the features' spread hold rounding errors alone.
LEAST_SPREAD = 1e-12


def check_features(df: DataFrame, features: list[str], ignore: list[str]) -> None:
    """The feature columns of ``df`` must be exactly the model's."""
    given, wanted = set(df.columns) - set(ignore), set(features)
    if given != wanted:
        raise ValueError(
            f"feature columns differ: missing {sorted(wanted - given)}, extra {sorted(given - wanted)}"
        )


def scaler(train: DataFrame, features: list[str]) -> SQLTransformer:
    """Standardise with the mean and population deviation of ``train``.

    One aggregation finds the statistics. They become literals of a projection, so
    scoring stays in generated code and the step is saved with the model.
    """
    stats = train.agg(
        *[F.avg(c).alias(f"m_{c}") for c in features],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in features],
    ).first()
    empty = [c for c in features if stats[f"m_{c}"] is None]
    if empty:
        raise ValueError(f"no values to train on in {empty}")
    scaled = ", ".join(
        f"(`{c}` - {stats[f'm_{c}']!r}D) / {stats[f's_{c}'] or 1.0!r}D AS `z_{c}`" for c in features
    )
    return SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__")


def fold_statistics(train: DataFrame, features: list[str]) -> DataFrame:
    """Mean and population deviation of each feature over the training part of each expanding fold.

    One pass finds count, mean and squared distances of every fold; those of fold 0 to i - 1 are then added up for
    fold i. ``(fold, feature, n_rows, mean, deviation)``, from fold 1 on; the rows do not grow with ``train``.
    """
    moments = train.groupBy("fold").agg(*[
        F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), (F.var_pop(c) * F.count(c)).alias("m2")).alias(c) for c in features
    ])
    long = moments.select("fold", F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"{c}.n").alias("n"), F.col(f"{c}.mean").alias("mean"), F.col(f"{c}.m2").alias("m2"))
        for c in features
    ])).alias("x")).select("fold", "x.*")
    before = Window.partitionBy("feature").orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    parts = long.withColumn("parts", F.collect_list(F.when(F.col("n") > 0, F.struct("n", "mean", "m2"))).over(before))
    zero = F.lit(0.0)
    n = F.aggregate("parts", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    named = parts.where(F.size("parts") > 0).withColumn("n_rows", n).withColumn(
        "_mean", F.aggregate("parts", zero, lambda s, x: s + x["mean"] * x["n"] / F.col("n_rows"))
    )
    spread = F.aggregate("parts", zero, lambda s, x: s + x["m2"] + x["n"] * F.pow(x["mean"] - F.col("_mean"), F.lit(2.0)))
    return named.select("fold", "feature", "n_rows", F.col("_mean").alias("mean"), F.sqrt(spread / F.col("n_rows")).alias("deviation"))


def feature_steps(train: DataFrame, features: list[str]) -> list:
    names = [f"z_{c}" for c in features]
    return [scaler(train, features), VectorAssembler(inputCols=names, outputCol="features")]


def turned_steps(train: DataFrame, features: list[str], n_rows: int) -> list:
    """``feature_steps`` and a turn into the principal directions of the features, fitted on ``train``.

    Averages of one price are nearly collinear, and a fit on them takes a thousand steps. A turn leaves the penalty
    and so the best fit as they are, and MLlib scales each direction by its own deviation: a few dozen steps are enough.
    Directions without any spread, as features that are sums of others have, are left out.
    """
    steps = Pipeline(stages=feature_steps(train, features)).fit(train).stages
    if n_rows < 2:
        return [*steps, VectorSlicer(inputCol="features", outputCol="turned", indices=list(range(len(features))))]
    turn = PCA(k=len(features), inputCol="features", outputCol="directions").fit(PipelineModel(steps).transform(train))
    kept = max(1, int(np.sum(turn.explainedVariance.toArray() > LEAST_SPREAD)))
    return [*steps, turn, VectorSlicer(inputCol="directions", outputCol="turned", indices=list(range(kept)))]


def coefficients(steps: PipelineModel) -> np.ndarray:
    """The coefficients of the standardised features: those of a turned fit, turned back."""
    fitted = steps.stages[-1].coefficients.toArray()
    for step in steps.stages:
        if isinstance(step, PCAModel):
            return step.pc.toArray()[:, : len(fitted)] @ fitted
    return fitted


@dataclass(frozen=True)
class Candidate:
    c: float
    class_weight: str | None
    max_iter: int


@dataclass
class SignalModel:
    """Fitted steps with the feature order and the search results."""

    features: list[str]
    steps: PipelineModel
    best: Candidate
    cv_score: float
    saved_at: str | None = None

    def score(self, df: DataFrame, beside: list[str] | None = None) -> DataFrame:
        """Add ``p1`` (probability of class 1) and ``prediction``.

        With ``beside``, the names of the columns that are no features, all others must be exactly the
        model's features; without it, other columns pass through.
        """
        if beside is not None:
            check_features(df, self.features, beside)
        missing = [c for c in self.features if c not in df.columns]
        if missing:
            raise ValueError(f"feature columns missing: {missing}")
        out = self.steps.transform(df).withColumn("p1", vector_to_array("probability")[1])
        return out.drop("features", "directions", "turned", "rawPrediction", "probability", *[f"z_{c}" for c in self.features])

    def predict(self, df: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
        """Set ``prediction``: the model's class at 0.5, else ``p1 >= threshold``."""
        scored = self.score(df)
        if threshold == DEFAULT_THRESHOLD:
            return scored
        return scored.withColumn("prediction", (F.col("p1") >= threshold).cast("double"))

    def evaluate(self, df: DataFrame) -> DataFrame:
        return accuracy(self.score(df))

    def save(self, path: str) -> None:
        self.saved_at = datetime.now(timezone.utc).isoformat()
        spark = SparkSession.active()
        self.steps.write().overwrite().save(f"{path}/steps")
        row = (
            self.features, self.best.c, self.best.class_weight, self.best.max_iter,
            self.cv_score, self.saved_at,
        )
        schema = (
            "features array<string>, c double, class_weight string, max_iter int, "
            "cv_score double, saved_at string"
        )
        spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/search")

    @staticmethod
    def load(spark: SparkSession, path: str) -> SignalModel:
        r = spark.read.parquet(f"{path}/search").first()
        best = Candidate(r["c"], r["class_weight"], r["max_iter"])
        steps = PipelineModel.load(f"{path}/steps")
        return SignalModel(list(r["features"]), steps, best, r["cv_score"], r["saved_at"])


def _fit(
    rows: DataFrame, candidate: Candidate, counts: dict[float, int], column: str = "features"
) -> LogisticRegressionModel:
    """One fit; ``counts`` are the class sizes of ``rows``.

    An inverse strength ``C`` on summed loss is ``1 / (C n)`` on MLlib's mean loss;
    balanced class weights also sum to ``n``.
    """
    n = sum(counts.values())
    estimator = LogisticRegression(
        regParam=1.0 / (candidate.c * n), elasticNetParam=0.0, standardization=False,
        maxIter=candidate.max_iter, tol=1e-12, featuresCol=column, labelCol="label",
    )
    if candidate.class_weight == "balanced":
        weight = F.lit(None).cast("double")
        for label, size in counts.items():
            weight = F.when(F.col("label") == label, n / (2.0 * size)).otherwise(weight)
        rows = rows.withColumn("_weight", weight)
        estimator = estimator.setWeightCol("_weight")
    return estimator.fit(rows)


def _class_sizes(rows: DataFrame, by: str) -> dict[int, dict[float, int]]:
    """Rows per group and label; a handful of counts."""
    sizes: dict[int, dict[float, int]] = {}
    for r in rows.groupBy(by, "label").count().collect():
        sizes.setdefault(r[by], {})[r["label"]] = r["count"]
    return sizes


def _total(sizes: dict[int, dict[float, int]], below: int | None = None) -> dict[float, int]:
    counts: dict[float, int] = {}
    for group, by_label in sizes.items():
        if below is None or group < below:
            for label, n in by_label.items():
                counts[label] = counts.get(label, 0) + n
    return counts


def fit_model(train: DataFrame, features: list[str], candidate: Candidate) -> SignalModel:
    """Scale and fit one candidate, without a search."""
    counts = _total(_class_sizes(train.withColumn("_all", F.lit(0)), "_all"))
    return SignalModel(features, _fitted_steps(train, features, candidate, counts), candidate, float("nan"))


def _fitted_steps(train: DataFrame, features: list[str], candidate: Candidate, counts: dict[float, int]) -> PipelineModel:
    steps = turned_steps(train, features, sum(counts.values()))
    rows = PipelineModel(steps).transform(train).select("turned", "label")
    return PipelineModel([*steps, _fit(rows, candidate, counts, "turned")])


@dataclass
class _Problem:
    """One penalised fit of the search: rows of folds below ``fold``, weighted by class.

    ``states`` holds the coefficients after each pass, as a fit stopped there would return them.
    """

    fold: int
    penalty: float
    weights: dict[float, float]
    beta: np.ndarray
    loss: float = np.inf
    best: np.ndarray | None = None
    settled: bool = False
    states: list[np.ndarray] = field(default_factory=list)

    def after(self, passes: int) -> np.ndarray:
        """The coefficients of a fit that may take so many passes."""
        return self.states[passes - 1] if passes < len(self.states) or not self.settled else self.best


def _logistic_parts(x: np.ndarray, y: np.ndarray, w: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Loss, gradient and curvature of a batch of rows, flattened."""
    z = x @ beta
    p = 1.0 / (1.0 + np.exp(-z))
    loss = float(w @ (np.logaddexp(0.0, z) - y * z))
    curve = (x * (w * p * (1.0 - p))[:, None]).T @ x
    return np.concatenate([[loss], x.T @ (w * (p - y)), curve.ravel()])


Scale = dict[int, tuple[np.ndarray, np.ndarray]]  # mean and deviation of the features by fold


def _summed_parts(rows: DataFrame, names: list[str], problems: list[_Problem], scale: Scale) -> dict[int, np.ndarray]:
    """One pass over ``rows`` for all open problems.

    Each task reduces its rows to a fixed number of sums per problem, and Spark adds
    them up by (problem, place); what reaches the driver does not grow with the rows.
    """
    todo = [(i, p.fold, p.weights, p.beta) for i, p in enumerate(problems) if not p.settled]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            values = batch[names].to_numpy()
            y, fold = batch["label"].to_numpy(), batch["fold"].to_numpy()
            seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for i, below, weights, beta in todo:
                if below not in seen:
                    use = fold < below
                    mean, deviation = scale[below]
                    seen[below] = np.column_stack([np.ones(int(use.sum())), (values[use] - mean) / deviation]), y[use]
                x, labels = seen[below]
                if len(labels):
                    w = np.where(labels == 1.0, weights[1.0], weights[0.0])
                    sums[i] = sums.get(i, 0.0) + _logistic_parts(x, labels, w, beta)
        for i, found in sums.items():
            yield pd.DataFrame({"problem": i, "place": np.arange(len(found)), "value": found})

    parts = rows.mapInPandas(partial, "problem int, place int, value double")
    totals = parts.groupBy("problem", "place").agg(F.sum("value").alias("value")).collect()
    size = 1 + (len(names) + 1) + (len(names) + 1) ** 2
    out = {i: np.zeros(size) for i, *_ in todo}
    for r in totals:
        out[r["problem"]][r["place"]] = r["value"]
    return out


def _newton_step(p: _Problem, parts: np.ndarray) -> None:
    """Take one step from summed parts, or halve the last one if it made the loss worse."""
    k = len(p.beta)
    ridge = np.full(k, p.penalty)
    ridge[0] = 0.0  # the intercept is free
    loss = parts[0] + 0.5 * float(ridge @ p.beta**2)
    if p.best is not None and not loss <= p.loss * (1 + 1e-12):
        p.beta = (p.beta + p.best) / 2
        p.settled = bool(np.max(np.abs(p.beta - p.best)) < 1e-9)
    else:
        p.best, p.loss = p.beta, loss
        slope = parts[1 : k + 1] + ridge * p.beta
        curve = parts[k + 1 :].reshape(k, k) + np.diag(ridge)
        step = np.linalg.lstsq(curve, slope, rcond=None)[0]
        p.beta = p.beta - step
        p.settled = bool(np.max(np.abs(step)) < 1e-8 * (1.0 + np.max(np.abs(p.beta))))
    p.states.append(p.beta)


def _fold_accuracy(rows: DataFrame, names: list[str], fits: list[tuple[int, np.ndarray]], scale: Scale) -> list[float]:
    """Accuracy of each (fold, coefficients) on its own fold, in one aggregation."""
    hits, sizes = [], []
    for i, (fold, beta) in enumerate(fits):
        mean, deviation = scale[fold]
        z = F.lit(float(beta[0]))
        for name, b, m, s in zip(names, beta[1:], mean, deviation):
            z = z + (F.col(name) - float(m)) / float(s) * float(b)
        right = (F.col("fold") == fold) & ((z > 0) == (F.col("label") == 1.0))
        hits.append(F.count_if(right).alias(f"h{i}"))
        sizes.append(F.count_if(F.col("fold") == fold).alias(f"n{i}"))
    r = rows.agg(*hits, *sizes).first()
    return [r[f"h{i}"] / r[f"n{i}"] for i in range(len(fits))]


def _scales(train: DataFrame, features: list[str], folds: range, per_fold: bool) -> Scale:
    """How the search standardises each fold: once for all on the whole training part, or on the fold's own."""
    if not per_fold:
        stats = train.agg(*[F.avg(c) for c in features], *[F.stddev_pop(c) for c in features]).first()
        empty = [c for c, m in zip(features, stats) if m is None]
        if empty:
            raise ValueError(f"no values to train on in {empty}")
        found = {(fold, c): (stats[i], stats[len(features) + i]) for fold in folds for i, c in enumerate(features)}
    else:
        found = {(r["fold"], r["feature"]): (r["mean"], r["deviation"]) for r in fold_statistics(train, features).collect()}
    return {
        fold: (np.array([found[fold, c][0] for c in features]), np.array([found[fold, c][1] or 1.0 for c in features]))
        for fold in folds
    }


def grid_search(
    train: DataFrame, features: list[str], max_passes: int = 60, scale_per_fold: bool = False,
    limits: list[int] | None = None,
) -> tuple[SignalModel, list[tuple[Candidate, float]]]:
    """Search C, class weight and iteration limit over expanding time folds; fit the best on all rows.

    ``train`` needs ``fold`` (see ``timesplit.with_folds``), ``label`` and the features. Features are standardised
    by all of ``train``, or for each fold by what it trains on (``scale_per_fold``). The fits of all folds and candidates
    share each pass over the rows and take Newton steps, so the search costs about ten
    passes instead of ten thousand; the winner is fitted once more with MLlib. Every limit is scored with the
    coefficients that a fit has after so many steps.
    """
    limits = GRID_MAX_ITER if limits is None else limits
    if min(limits) < 1:
        raise ValueError("a fit takes at least one step")
    rows = train.select(*features, "label", "fold").persist()
    try:
        sizes = _class_sizes(rows, "fold")
        folds = range(1, max(sizes) + 1)
        scale = _scales(rows, features, folds, scale_per_fold)
        plans = [(c, w) for c in GRID_C for w in GRID_CLASS_WEIGHT]
        problems = []
        for c, weight in plans:
            for fold in folds:
                counts = {0.0: 0, 1.0: 0} | _total(sizes, fold)
                n = sum(counts.values())
                even = {label: n / (2.0 * size) if size else 0.0 for label, size in counts.items()}
                weights = even if weight == "balanced" else {0.0: 1.0, 1.0: 1.0}
                problems.append(_Problem(fold, 1.0 / c, weights, np.zeros(len(features) + 1)))
        for _ in range(min(max_passes, max(limits))):
            for i, parts in _summed_parts(rows, features, problems, scale).items():
                _newton_step(problems[i], parts)
            if all(p.settled for p in problems):
                break
        unsettled = sum(not p.settled for p in problems)
        if unsettled and max(limits) > max_passes:
            raise RuntimeError(f"{unsettled} of {len(problems)} fits did not settle in {max_passes} passes")
        # Limits that stop a fit at the same state share one score.
        states = [(p.fold, p.after(limit)) for p in problems for limit in limits]
        distinct = {(i // len(limits), beta.tobytes()): (fold, beta) for i, (fold, beta) in enumerate(states)}
        share = dict(zip(distinct, _fold_accuracy(rows, features, list(distinct.values()), scale)))
        outcome = []
        for at, (c, weight) in enumerate(plans):
            for limit in limits:
                own = [(i, problems[i].after(limit).tobytes()) for i in range(at * len(folds), (at + 1) * len(folds))]
                outcome.append((Candidate(c, weight, limit), sum(share[key] for key in own) / len(folds)))
        best, score = max(outcome, key=lambda pair: pair[1])
        fitted = _fitted_steps(rows, features, best, _total(sizes))
    finally:
        rows.unpersist()
    return SignalModel(features, fitted, best, score), outcome


def certificate(model: SignalModel, train: DataFrame) -> DataFrame:
    """How far a fitted model is from the only best one: the slope of its loss on the rows that it was fitted on.

    One row per coefficient: ``name``, ``coefficient``, ``gradient`` (of the summed, weighted loss with its penalty, per row;
    zero at the optimum, which a strictly convex loss has just once) and ``n_rows``.
    """
    fitted, best = model.steps.stages[-1], model.best
    scored = model.steps.transform(train).withColumn("_p1", vector_to_array("probability")[1])
    counts = _total(_class_sizes(train.withColumn("_all", F.lit(0)), "_all"))
    n, weight = sum(counts.values()), F.lit(1.0)
    if best.class_weight == "balanced":
        for label, size in counts.items():
            weight = F.when(F.col("label") == label, n / (2.0 * size)).otherwise(weight)
    error = weight * (F.col("_p1") - F.col("label"))
    sums = scored.agg(
        F.sum(error).alias("intercept"), *[F.sum(error * F.col(f"z_{c}")).alias(c) for c in model.features], F.count("*").alias("_n"),
    )
    # The intercept carries no penalty.
    betas = [("intercept", float(fitted.intercept), 0.0)] + [(c, float(b), float(b) / best.c) for c, b in zip(model.features, coefficients(model.steps))]
    rows = F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.lit(b).alias("coefficient"), ((F.col(c) + F.lit(pull)) / F.col("_n")).alias("gradient"), F.col("_n").alias("n_rows"))
        for c, b, pull in betas
    ]))
    return sums.select(rows.alias("r")).select("r.*")


def accuracy(scored: DataFrame) -> DataFrame:
    """Accuracy and row count of a scored set."""
    hit = (F.col("prediction") == F.col("label")).cast("double")
    return scored.agg(F.avg(hit).alias("test_accuracy"), F.count("*").alias("n_rows"))


def classification_report(scored: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted means.

    All figures come from one count per (label, prediction) pair; an empty
    denominator gives 0.
    """
    pairs = scored.groupBy("label", "prediction").agg(F.count("*").alias("n"))
    sides = pairs.select(
        F.explode(F.array(
            F.struct(F.col("label").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("long").alias("chosen")),
            F.struct(F.col("prediction").alias("cls"), F.lit(0).cast("long").alias("support"), F.col("n").alias("chosen")),
        )).alias("s"),
        F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit"),
    )
    zero = F.lit(0.0)
    by_class = sides.groupBy("s.cls").agg(
        F.sum("s.support").alias("support"), F.sum("s.chosen").alias("chosen"),
        (F.sum("hit") / 2).alias("hits"),
    ).select(
        "cls", "support", "hits",
        F.coalesce(ratio(F.col("hits"), F.col("chosen")), zero).alias("precision"),
        F.coalesce(ratio(F.col("hits"), F.col("support")), zero).alias("recall"),
    )
    p, r = F.col("precision"), F.col("recall")
    by_class = by_class.withColumn("f1", F.coalesce(ratio(p * r * 2.0, p + r), zero))
    measures = ["precision", "recall", "f1"]
    rows = by_class.select(F.col("cls").cast("int").cast("string").alias("row"), *measures, "support")
    total = F.sum("support")
    summary = by_class.agg(
        F.sum("hits").alias("hits"), total.alias("support"),
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[(F.sum(F.col(m) * F.col("support")) / total).alias(f"weighted_{m}") for m in measures],
    )
    share = F.col("hits") / F.col("support")
    extra = summary.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("row"), *[share.alias(m) for m in measures], F.col("support")),
        *[
            F.struct(F.lit(f"{kind} avg").alias("row"), *[F.col(f"{kind}_{m}").alias(m) for m in measures], F.col("support"))
            for kind in ("macro", "weighted")
        ],
    )).alias("x")).select("x.*")
    return rows.unionByName(extra)


def scorable(df: DataFrame, features: list[str]) -> DataFrame:
    """Rows of tickers with no missing feature at all; others are left out as a whole."""
    gap = F.lit(False)
    for c in features:
        gap = gap | F.col(c).isNull()
    whole = Window.partitionBy("ticker_code")
    return df.withColumn("_gap", F.max(gap).over(whole)).where(~F.col("_gap")).drop("_gap")


def model_signals(
    df: DataFrame, model: SignalModel, threshold: float = BACKTEST_THRESHOLD, keep: list[str] | None = None
) -> DataFrame:
    """``(ticker_code, date, signal)`` for every scorable ticker, with the columns ``keep`` before the signal."""
    scored = model.predict(scorable(df, model.features), threshold)
    return scored.select("ticker_code", "date", *(keep or []), F.col("prediction").cast("int").alias("signal"))
