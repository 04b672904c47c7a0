"""Fitting, selecting and scoring models as Spark jobs over MLlib estimators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.ml import Estimator, Model
from pyspark.ml import classification as mlc
from pyspark.ml import regression as mlr
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import array_sum, rounded
from . import metrics
from .splits import class_weights, evenly_spaced

SEED = 42


@dataclass(frozen=True)
class Candidate:
    candidate_id: str
    family: str
    params: dict = field(default_factory=dict)
    features: str = "features"


REGRESSORS: dict[str, Callable[..., Estimator]] = {
    "linear_regression": mlr.LinearRegression,
    "decision_tree": mlr.DecisionTreeRegressor,
    "random_forest": mlr.RandomForestRegressor,
    "boosted_trees": mlr.GBTRegressor,
}


def build_regressor(spec: Candidate, label: str = "label", seed: int = SEED) -> Estimator:
    seeded = {} if spec.family == "linear_regression" else {"seed": seed}
    return REGRESSORS[spec.family](
        featuresCol=spec.features, labelCol=label, predictionCol="prediction", **seeded, **spec.params
    )


def build_classifier(spec: Candidate, classes: int, label: str = "label", weight: str = "weight", seed: int = SEED) -> Estimator:
    """Class-weighted estimator; the two-class-only families become one-vs-rest beyond two classes."""
    common = {"featuresCol": spec.features, "labelCol": label, "weightCol": weight}
    if spec.family == "decision_tree":
        return mlc.DecisionTreeClassifier(seed=seed, **common, **spec.params)
    if spec.family == "random_forest":
        return mlc.RandomForestClassifier(seed=seed, **common, **spec.params)
    if spec.family == "svm":
        return PresentClasses(mlc.LinearSVC(**common, **spec.params), classes)
    elif spec.family == "boosted_trees":
        base = mlc.GBTClassifier(seed=seed, **common, **spec.params)
    else:
        raise ValueError(f"Unknown classifier family: {spec.family}")
    return base if classes == 2 else one_vs_rest(base)


def one_vs_rest(base: Estimator) -> mlc.OneVsRest:
    return mlc.OneVsRest(classifier=base, featuresCol=base.getFeaturesCol(), labelCol=base.getLabelCol(), weightCol=base.getWeightCol())


class PresentClasses(Estimator):
    """``base``, which needs rows of two classes, over the classes that the training rows hold.

    A class without training rows is never predicted; its raw score is negative infinity.
    """

    def __init__(self, base: Estimator, classes: int) -> None:
        super().__init__()
        self.base, self.classes = base, classes

    def _fit(self, dataset: DataFrame) -> Model:
        label = self.base.getLabelCol()
        present = sorted(int(r[0]) for r in dataset.select(label).filter(F.col(label).isNotNull()).distinct().collect())
        if not present:
            raise ValueError("No training rows")
        if len(present) > 1 and present == list(range(len(present))):
            return (self.base if self.classes == 2 else one_vs_rest(self.base)).fit(dataset)
        if len(present) == 1:
            return PresentClassesModel(None, present, self.classes)
        dense = F.array_position(F.array(*[F.lit(float(c)) for c in present]), F.col(label)) - 1
        return PresentClassesModel(one_vs_rest(self.base).fit(dataset.withColumn(label, dense.cast("double"))), present, self.classes)


class PresentClassesModel(Model):
    """Scores of the present classes put back to their own places; a single class is always predicted."""

    def __init__(self, model: Model | None, present: Sequence[int], classes: int) -> None:
        super().__init__()
        self.model, self.present, self.classes = model, tuple(present), classes

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self.model is None:
            out = dataset.withColumns({"_raw": F.array(F.lit(1.0)), "prediction": F.lit(float(self.present[0]))})
        else:
            out = self.model.transform(dataset).withColumn("_raw", vector_to_array("rawPrediction"))
            names = F.array(*[F.lit(float(c)) for c in self.present])
            out = out.withColumn("prediction", F.element_at(names, F.col("prediction").cast("int") + 1))
        places = [F.element_at("_raw", self.present.index(c) + 1) if c in self.present else F.lit(float("-inf")) for c in range(self.classes)]
        return out.withColumn("rawPrediction", array_to_vector(F.array(*places))).drop("_raw")


def weighted(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced class weight per row, from these rows only; a row without label is dropped.

    The weights, one per class, become an expression of the label: a fit reads its rows several times,
    and a join would count the classes again each time.
    """
    weights = {r[label]: r["weight"] for r in class_weights(df, label).collect()}
    weight = F.lit(None).cast("double")
    for value, found in weights.items():
        weight = F.when(F.col(label) == value, found).otherwise(weight)
    return df.filter(F.col(label).isNotNull()).withColumn("weight", weight)


def class_scores(scored: DataFrame, classes: int, out: str = "probabilities") -> DataFrame:
    """Probabilities where the model gives them, else a sigmoid of its raw score, renormalised.

    One-vs-rest gives one raw score per class; a two-class margin model gives a pair.  A model knows
    the classes up to the largest of its training rows; those beyond have probability 0.
    """
    if "probability" in scored.columns:
        p = vector_to_array("probability")
    else:
        raw = vector_to_array("rawPrediction")
        p = F.transform(raw, lambda s: F.lit(1.0) / (F.lit(1.0) + F.exp(-s)))
    out_df = scored.withColumn(out, p)
    out_df = out_df.withColumn(out, F.concat(F.col(out), F.array_repeat(F.lit(0.0), F.lit(classes) - F.size(out))))
    total = array_sum(F.col(out))
    return out_df.withColumn(out, F.transform(out, lambda x: F.try_divide(x, total)))


def fold_scores(
    rows: DataFrame, candidates: Sequence[Candidate], folds: Sequence[int], score: Callable[[Model, DataFrame], DataFrame],
    build: Callable[[Candidate], Estimator], ts: str = "ts", budget: int | None = None, threads: int = 4,
) -> DataFrame:
    """Fit and score every candidate on every fold; a failure is a row, not an error.

    ``rows`` carries ``fold`` and ``role``.  Fits are independent Spark jobs submitted from a small
    pool; only one metrics row per fit comes back.
    """

    def one(task: tuple[Candidate, int]) -> dict:
        spec, fold = task
        record = {"candidate_id": spec.candidate_id, "family": spec.family, "fold": fold, "status": "ok", "error": None}
        try:
            mine = rows.filter(F.col("fold") == fold)
            train = mine.filter("role = 'train'")
            if budget:
                train = evenly_spaced(train, ts, budget)
            model = build(spec).fit(train)
            found = score(model, mine.filter("role = 'validation'")).first()
            return {**record, "metrics": {k: float(v) for k, v in found.asDict().items() if v is not None}}
        except (IllegalArgumentException, AnalysisException, ValueError) as error:  # the estimator refused; lost executors still raise
            return {**record, "status": "failed", "error": f"{type(error).__name__}: {error}", "metrics": {}}

    with ThreadPoolExecutor(threads) as pool:
        records = list(pool.map(one, [(c, f) for c in candidates for f in folds]))
    schema = "candidate_id string, family string, fold int, status string, error string, metrics map<string,double>"
    order = ("candidate_id", "family", "fold", "status", "error", "metrics")
    return rows.sparkSession.createDataFrame([tuple(x[k] for k in order) for x in records], schema)


def job_rows(rows: DataFrame, place: int, features: str, labels: str = "labels") -> DataFrame:
    """Rows of one job whose label stands at ``place`` of the labels array."""
    return rows.withColumn("label", F.col(labels)[place]).filter("label IS NOT NULL").select(
        "label", F.col(features), *[c for c in ("trains_from", "validates", "split") if c in rows.columns]
    )


def job_folds(
    rows: DataFrame, jobs: Sequence[tuple[str, int]], candidates: Sequence[Candidate], folds: Sequence[int],
    build: Callable[[Candidate, int], Estimator], score: Callable[[Model, DataFrame, int], DataFrame], weigh: bool = False, threads: int = 8,
) -> DataFrame:
    """``fold_scores`` for many jobs over rows placed by ``foldstats.fold_places``; one record per fit.

    ``jobs`` gives each job's id and the place of its label; ``build`` and ``score`` are told the place.
    Every fit reads its rows several times, so those of all fits are held for the time of the call.
    """
    names = sorted({c.features for c in candidates})
    held = rows.filter("trains_from > 0 OR validates > 0").select("labels", *names, "trains_from", "validates").persist(StorageLevel.MEMORY_AND_DISK)

    def one(task: tuple) -> tuple:
        (job, place), spec, fold = task
        head = (job, spec.candidate_id, spec.family, fold)
        try:
            mine = job_rows(held, place, spec.features)
            train = mine.filter((F.col("trains_from") > 0) & (F.col("trains_from") <= fold))
            model = build(spec, place).fit(weighted(train) if weigh else train)
            found = score(model, mine.filter(F.col("validates") == fold), place).first()
            return (*head, "ok", None, {k: float(v) for k, v in found.asDict().items() if v is not None})
        except (IllegalArgumentException, AnalysisException, ValueError) as error:  # the estimator refused; lost executors still raise
            return (*head, "failed", f"{type(error).__name__}: {error}", {})

    try:
        with ThreadPoolExecutor(threads) as pool:
            records = list(pool.map(one, [(j, c, f) for j in jobs for c in candidates for f in folds]))
    finally:
        held.unpersist()
    schema = "job_id string, candidate_id string, family string, fold int, status string, error string, metrics map<string,double>"
    return rows.sparkSession.createDataFrame(records, schema)


def regression_score(model: Model, validation: DataFrame, label: str = "label") -> DataFrame:
    out = model.transform(validation)
    return metrics.regression_metrics(out, [], label, "prediction").select("rmse", "mae", "r_squared")


def classifier_score(classes: int, label: str = "label") -> Callable[[Model, DataFrame], DataFrame]:
    def score(model: Model, validation: DataFrame) -> DataFrame:
        out = model.transform(validation)
        return metrics.multiclass_metrics(out, [], classes, (), label, "prediction").select("accuracy", "macro_f1")

    return score


def aggregate_folds(folds: DataFrame, keys: Sequence[str], names: Sequence[str], expected: int) -> DataFrame:
    """Mean and population deviation per metric, only when every fold succeeded."""
    ok = F.count_if(F.col("status") == "ok")
    whole = ok == expected
    return folds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("folds"), ok.alias("successful_folds"),
        *[F.when(whole, F.avg(n)).alias(f"mean_{n}") for n in names],
        *[F.when(whole, F.stddev_pop(n)).alias(f"std_{n}") for n in names],
    )


def pick_best(table: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per group in the given total order (one row per candidate)."""
    rank = Window.partitionBy(*keys).orderBy(*order)
    return table.withColumn("_place", F.row_number().over(rank)).filter("_place = 1").drop("_place")


def choose_within_family(table: DataFrame, keys: Sequence[str], metric: str, lower_is_better: bool = True) -> DataFrame:
    value = F.col(metric).asc() if lower_is_better else F.col(metric).desc()
    return pick_best(table.filter(F.col(metric).isNotNull()), [*keys, "family"], [value, F.col("candidate_id").asc()])


def choose_across_families(table: DataFrame, keys: Sequence[str], validation: str, cv: str, lower_is_better: bool = True) -> DataFrame:
    def side(c: str) -> Column:
        return F.col(c).asc() if lower_is_better else F.col(c).desc()

    order = [side(validation), side(cv), F.col("family").asc(), F.col("candidate_id").asc()]
    return pick_best(table.filter(F.col(validation).isNotNull()), keys, order)


# -- calibration -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class SigmoidCalibrator:
    """One logistic curve per class over its score, renormalised over classes.

    ``entries`` are the places (from 1) in the score array that the curves read.
    """

    curves: tuple[tuple[float, float], ...]
    entries: tuple[int, ...]

    def transform(self, df: DataFrame, scores: str, out: str = "probabilities") -> DataFrame:
        raw = [
            F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a) * F.element_at(scores, i) + F.lit(b))))
            for i, (a, b) in zip(self.entries, self.curves, strict=True)
        ]
        if len(raw) == 1:
            return df.withColumn(out, F.array(F.lit(1.0) - raw[0], raw[0]))
        made = df.withColumn(out, F.array(*raw))
        total = array_sum(F.col(out))
        return made.withColumn(out, F.transform(out, lambda x: x / total))


def fit_sigmoid(df: DataFrame, scores: str, label: str, classes: int, steps: int = 50, tolerance: float = 1e-9) -> SigmoidCalibrator:
    """Logistic curve of class membership on the class's own score, for all classes together.

    Newton steps; each reads the rows once and gathers the sums of every class, five numbers a class.
    A step that does not lower a class's loss is halved.  Targets are moved off 0 and 1 by the class's
    counts, so perfectly separated scores have finite curves.  For two classes the positive score
    alone is used.
    """
    wanted = list(range(classes)) if classes > 2 else [1]
    slim = df.select(*[F.element_at(scores, i + 1).cast("double").alias(f"s{i}") for i in wanted], F.col(label).cast("int").alias("y")).filter("y IS NOT NULL")
    size = slim.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("y") == i).alias(f"n{i}") for i in wanted]).first()
    if not size["n"]:
        raise ValueError("No rows to calibrate on")
    ends = {i: ((size[f"n{i}"] + 1) / (size[f"n{i}"] + 2), 1 / (size["n"] - size[f"n{i}"] + 2)) for i in wanted}
    state = {i: (0.0, 0.0) for i in wanted}
    accepted: dict[int, tuple] = {}
    step = {i: (0.0, 0.0) for i in wanted}
    for _ in range(steps):
        aggs = []
        for i in wanted:
            x = F.col(f"s{i}")
            t = F.when(F.col("y") == i, ends[i][0]).otherwise(ends[i][1])
            z = F.lit(state[i][0]) * x + F.lit(state[i][1])
            p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
            h = p * (1 - p)
            sums = {"l": F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - t * z, "ga": (p - t) * x, "gb": p - t, "haa": h * x * x, "hab": h * x, "hbb": h}
            aggs += [F.sum(e).alias(f"{n}{i}") for n, e in sums.items()]
        row = slim.agg(*aggs).first()
        moving = False
        for i in wanted:
            loss, ga, gb, haa, hab, hbb = (row[f"{n}{i}"] for n in ("l", "ga", "gb", "haa", "hab", "hbb"))
            if i in accepted and loss > accepted[i][0] + 1e-12 * max(1.0, abs(loss)):
                step[i] = (step[i][0] / 2, step[i][1] / 2)
            else:
                accepted[i] = (loss, state[i])
                # A constant score leaves the slope open; a small ridge keeps it at 0.
                haa, hbb = haa + 1e-10, hbb + 1e-10
                det = haa * hbb - hab * hab
                step[i] = ((hab * gb - hbb * ga) / det, (hab * ga - haa * gb) / det) if det > 1e-18 else (0.0, -gb / hbb)
            if max(abs(step[i][0]), abs(step[i][1])) > tolerance:
                moving = True
            state[i] = (accepted[i][1][0] + step[i][0], accepted[i][1][1] + step[i][1])
        if not moving:
            break
    return SigmoidCalibrator(tuple(accepted[i][1] for i in wanted), tuple(range(1, classes + 1)) if classes > 2 else (2,))


# -- importance ------------------------------------------------------------------------------------


def importance_table(model: Model, names: Sequence[str], reference: DataFrame, job: str) -> DataFrame:
    """Ranked importance of a tree model or absolute coefficient of a linear one."""
    vector = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
    values = [float(abs(x)) for x in vector.toArray()]
    order = sorted(range(len(values)), key=lambda i: (-values[i], names[i]))
    rows = [(job, names[i], values[i], place + 1) for place, i in enumerate(order)]
    return reference.sparkSession.createDataFrame(rows, "job_id string, feature string, importance double, rank int")


# -- scoring -----------------------------------------------------------------------------------------


def regression_rows(scored: DataFrame, job: str, target: str, horizon: int, version: str, label: str = "label") -> DataFrame:
    """Long prediction rows of one job."""
    return scored.select(
        "entity", "ts", "target_ts", "split", F.lit(job).alias("job_id"), F.lit(target).alias("target"),
        F.lit(horizon).alias("horizon"), F.lit(horizon * 30).alias("horizon_minutes"), F.col(label).cast("double").alias("actual"),
        F.col("prediction").cast("double").alias("prediction"), (F.col(label) - F.col("prediction")).alias("residual"),
        F.lit(version).alias("model_version"),
    )


def classification_rows(
    scored: DataFrame, job: str, labels: Sequence[str], horizon: int, version: str, threshold: float | None = None, label: str = "label"
) -> DataFrame:
    """Ordered probabilities and the label by argmax, or by threshold on the second class."""
    p = F.col("probabilities")
    names = F.array(*[F.lit(x) for x in labels])
    place = (
        F.array_position(p, F.array_max(p)).cast("int")
        if threshold is None
        else F.when(F.element_at(p, 2) >= threshold, 2).otherwise(1)
    )
    return scored.withColumn("_place", place).select(
        "entity", "ts", "target_ts", "split", F.lit(job).alias("job_id"), F.lit(horizon).alias("horizon"),
        F.col(label).cast("int").alias("actual_class_index"), (F.col("_place") - 1).alias("predicted_class_index"),
        F.element_at(names, F.col(label).cast("int") + 1).alias("actual_label"),
        F.element_at(names, F.col("_place")).alias("predicted_label"),
        *[F.element_at(p, i + 1).alias(f"probability_{x.lower().replace('-', '_')}") for i, x in enumerate(labels)],
        F.lit(threshold).cast("double").alias("operating_threshold"), F.lit(version).alias("model_version"),
    )


def wide_to_long(df: DataFrame, keys: Sequence[str], horizons: Sequence[int], measures: dict[str, str]) -> DataFrame:
    """Columns ``<prefix>_h<k>`` to one row per horizon; ``measures`` maps output name to prefix."""
    records = [
        F.struct(F.lit(h).alias("horizon"), *[F.col(f"{prefix}_h{h}").alias(name) for name, prefix in measures.items()])
        for h in horizons
    ]
    return df.select(*keys, F.explode(F.array(*records)).alias("r")).select(*keys, "r.*")


def grouped_line(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Slope and intercept of every group by its moments, in one aggregate."""
    x_, y_ = F.col(x).cast("double"), F.col(y).cast("double")
    sums = df.groupBy(*keys).agg(F.regr_slope(y_, x_).alias("slope"), F.regr_intercept(y_, x_).alias("intercept"))
    return sums.select(*keys, "slope", "intercept")


# -- least squares by gradient descent -------------------------------------------------------------


@dataclass(frozen=True)
class LinearFit:
    features: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float
    iterations: int
    converged: bool
    loss: float

    def table(self, reference: DataFrame, name: str) -> DataFrame:
        rows = [*zip(self.features, self.weights), ("(bias)", self.bias)]
        return reference.sparkSession.createDataFrame([(f, float(w)) for f, w in rows], f"feature string, {name} double")


def moments(df: DataFrame, features: Sequence[str], label: str) -> dict[str, float]:
    """Sums of x_i, x_i*x_j, x_i*y, y, y*y and the row count, in one distributed pass."""
    x = [F.col(f).cast("double") for f in features]
    y = F.col(label).cast("double")
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(y).alias("y"), F.sum(y * y).alias("yy")]
    for i, a in enumerate(x):
        aggs += [F.sum(a).alias(f"x{i}"), F.sum(a * y).alias(f"xy{i}")]
        aggs += [F.sum(a * b).alias(f"xx{i}_{j}") for j, b in enumerate(x) if j >= i]
    return df.agg(*aggs).first().asDict()


def gradient_descent(
    df: DataFrame, features: Sequence[str], label: str, learning_rate: float = 0.1, max_iterations: int = 2000,
    tolerance: float = 1e-12, patience: int = 10,
) -> LinearFit:
    """Full-batch descent on the mean squared error; stops on a loss plateau.

    The loss and its gradient depend on the rows only through the moments, so the rows are read
    once and the iterations work on a (d+1) x (d+1) matrix.
    """
    m = moments(df, features, label)
    d, n = len(features), m["n"]
    gram = np.zeros((d + 1, d + 1))
    for i in range(d):
        for j in range(i, d):
            gram[i, j] = gram[j, i] = m[f"xx{i}_{j}"] / n
        gram[i, d] = gram[d, i] = m[f"x{i}"] / n
    gram[d, d] = 1.0
    cross = np.array([m[f"xy{i}"] / n for i in range(d)] + [m["y"] / n])
    theta, previous, stale = np.zeros(d + 1), None, 0
    # Rounding of a loss rebuilt from sums of squares.
    noise = 1e-12 * max(1.0, m["yy"] / n)
    for step in range(max_iterations + 1):
        pull = gram @ theta
        loss = float(theta @ pull - 2 * theta @ cross + m["yy"] / n)
        if not np.isfinite(loss):
            raise FloatingPointError("Descent left the finite range; lower the learning rate")
        if previous is not None:
            gain, scale = previous - loss, max(1.0, abs(previous))
            if gain < -(tolerance * scale + noise):
                raise FloatingPointError("Loss increased; lower the learning rate")
            stale = stale + 1 if gain <= tolerance * scale else 0
            if stale >= patience:
                return LinearFit(tuple(features), tuple(theta[:d]), float(theta[d]), step, True, loss)
        previous = loss
        if step < max_iterations:
            theta = theta - learning_rate * 2 * (pull - cross)
    return LinearFit(tuple(features), tuple(theta[:d]), float(theta[d]), max_iterations, False, loss)


def compare_coefficients(left: DataFrame, right: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Both coefficients per feature, the bias row included, and their absolute difference."""
    a, b = names
    return left.join(right, "feature", "full").withColumn("absolute_difference", F.abs(F.col(a) - F.col(b)))


# -- multi-horizon forecasts from sequences ----------------------------------------------------------


def sequence_vector(df: DataFrame, sequence: str = "sequence", out: str = "features") -> DataFrame:
    """Flattened step x feature history as one vector."""
    return df.withColumn(out, array_to_vector(F.flatten(sequence)))


def horizon_models(train: DataFrame, spec: Candidate, horizons: Sequence[int], prefix: str) -> dict[int, Model]:
    """One regressor per horizon on the same inputs."""
    return {h: build_regressor(spec, f"{prefix}_h{h}").fit(train) for h in horizons}


def horizon_forecasts(df: DataFrame, models: dict[int, Model], prefix: str) -> DataFrame:
    """Wide predictions ``prediction_h<k>`` beside the actuals."""
    out = df
    for h, model in models.items():
        out = model.transform(out).withColumnRenamed("prediction", f"prediction_h{h}")
    return out


def mean_validation_rmse(wide: DataFrame, horizons: Sequence[int], prefix: str) -> DataFrame:
    long = wide_to_long(wide, [], horizons, {"actual": prefix, "prediction": "prediction"})
    per = metrics.regression_metrics(long, ["horizon"])
    return per.agg(rounded(F.avg("rmse"), 8).alias("mean_rmse"))
