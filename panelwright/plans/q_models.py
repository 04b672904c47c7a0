"""Queries over model fitting, selection, calibration and scoring (ML)."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import durable, shared_dir
from ..functions.scalars import rounded
from ..operators import clean, features, foldstats, metrics, models, prep, sequences, serving, splits, uncertainty
from .frames import HORIZONS, LEVELS, PLAN, SPEC, TARGETS, Tables
from .q_features import _folds
from .registry import query, tidy
from .sql import cte, nudged, r, with_ctes

_NUMERIC = ("load", "speed", *features.lag_names(PLAN), "load_rolling_mean_4", "load_rolling_std_4", "load_rolling_mean_8")
_BOUNDED = ("hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos")
NAMES = [*_NUMERIC, *_BOUNDED, "is_weekend", "is_peak"]


def _rows(t: Tables) -> DataFrame:
    """Origins with history, features, targets, split and within-split marks."""
    panel = t.clean().withColumns(
        {"level": clean.capacity_band(F.col("load"), F.col("capacity")), "observed": ~F.col("inserted")}
    )
    ts = F.col("ts")
    out = features.add_history(panel, SPEC, PLAN).withColumns({**features.clock_columns(ts), **features.peak_columns(ts, PLAN)})
    out = features.add_targets(out.withColumns(features.cyclic_columns()), SPEC, TARGETS, HORIZONS)
    out = splits.assign(out, "ts", t.splits(), {h: f"target_ts_h{h}" for h in HORIZONS})
    return out.filter("history_available")


def prepared(t: Tables, target: str, horizon: int = 1) -> DataFrame:
    """Eligible rows of one job with tree and linear feature vectors, stored once for all fits."""
    rows = splits.eligible(
        _rows(t), F.col(f"target_{target}_h{horizon}_available"), F.col(f"target_within_split_h{horizon}")
    ).withColumn("target_ts", F.col(f"target_ts_h{horizon}"))
    value = F.col(f"target_{target}_h{horizon}")
    label = {
        "load": value.cast("double"), "level": splits.encode(value, LEVELS).cast("double"), "incident": value.cast("double")
    }[target]
    base = durable(rows.select("entity", "ts", "target_ts", "split", label.alias("label"), *NAMES))
    groups = prep.feature_groups(base.schema, NAMES, bounded=_BOUNDED)
    fitted = prep.fit(base.filter("split = 'train'"), groups)
    out = fitted.transform(fitted.transform(base, "tree", "features"), "linear", "features_linear")
    return durable(out.select("entity", "ts", "target_ts", "split", "label", "features", "features_linear"))


def _parts(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(rows.filter(F.col("split") == s) for s in splits.SPLITS)


_SPECS = {
    "linear": models.Candidate("linear_default", "linear_regression", {}, "features_linear"),
    "tree": models.Candidate("tree_balanced", "decision_tree", {"maxDepth": 8, "minInstancesPerNode": 12}),
    "forest": models.Candidate("forest_balanced", "random_forest", {"numTrees": 12, "maxDepth": 8, "minInstancesPerNode": 8}),
    "boosted": models.Candidate("boosted_balanced", "boosted_trees", {"maxIter": 10, "maxDepth": 4, "stepSize": 0.1}),
}
_CLASSIFIERS = {
    "tree": models.Candidate("tree_balanced", "decision_tree", {"maxDepth": 6, "minInstancesPerNode": 12}),
    "forest": models.Candidate("forest_balanced", "random_forest", {"numTrees": 12, "maxDepth": 8}),
    "svm": models.Candidate("svm_balanced", "svm", {"maxIter": 20, "regParam": 0.01}, "features_linear"),
    "boosted": models.Candidate("boosted_balanced", "boosted_trees", {"maxIter": 6, "maxDepth": 3}),
}


def _regression_report(t: Tables, name: str) -> DataFrame:
    rows = prepared(t, "load")
    model = models.build_regressor(_SPECS[name]).fit(rows.filter("split = 'train'"))
    return metrics.regression_metrics(model.transform(rows), ["split"], "label", "prediction")


def _classifier_report(t: Tables, name: str, target: str, classes: int) -> DataFrame:
    rows = prepared(t, target)
    train = models.weighted(rows.filter("split = 'train'"))
    model = models.build_classifier(_CLASSIFIERS[name], classes).fit(train)
    return metrics.multiclass_metrics(model.transform(rows), ["split"], classes, (), "label", "prediction")


@query(
    "ML3_linear_regression",
    "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem GROUP BY 1",
)
def _(t: Tables) -> DataFrame:
    fit = models.grouped_line(t.lineitem, ["l_returnflag"], "l_quantity", "l_extendedprice")
    return fit.select("l_returnflag", F.round("slope", 3).alias("slope"), F.round("intercept", 2).alias("intercept"))


@query("ML3b_linear_regression_panel")
def _(t: Tables) -> DataFrame:
    return _regression_report(t, "linear")


@query("ML4_tree_regression")
def _(t: Tables) -> DataFrame:
    return _regression_report(t, "tree")


@query("ML5_forest_regression")
def _(t: Tables) -> DataFrame:
    return _regression_report(t, "forest")


@query("ML6_boosted_regression")
def _(t: Tables) -> DataFrame:
    return _regression_report(t, "boosted")


@query("ML7_weighted_tree_classifier")
def _(t: Tables) -> DataFrame:
    return _classifier_report(t, "tree", "level", 4)


@query("ML8_weighted_forest_classifier")
def _(t: Tables) -> DataFrame:
    return _classifier_report(t, "forest", "level", 4)


@query("ML9_weighted_linear_svm")
def _(t: Tables) -> DataFrame:
    return _classifier_report(t, "svm", "incident", 2)


@query("ML9b_multiclass_svm")
def _(t: Tables) -> DataFrame:
    return _classifier_report(t, "svm", "level", 4)


@query("ML10_boosted_classifier")
def _(t: Tables) -> DataFrame:
    return _classifier_report(t, "boosted", "incident", 2)


@query("ML10b_multiclass_boosted")
def _(t: Tables) -> DataFrame:
    return _classifier_report(t, "boosted", "level", 4)


# -- many jobs over one table ------------------------------------------------------------------------

_TARGETS = (*TARGETS, ("speed", "speed", "regression", None))
NUMBER_JOBS = tuple(foldstats.Job(target, h) for target in ("load", "speed") for h in HORIZONS)
CLASS_JOBS = tuple(foldstats.Job(target, h, k) for target, k in (("level", 4), ("incident", 2)) for h in HORIZONS)
JOBS = (*NUMBER_JOBS, *CLASS_JOBS)
_RIDGES = tuple(foldstats.Linear(name, "linear_regression", x) for name, x in (("linear_default", 0.0), ("ridge_light", 1.0), ("ridge_strong", 50.0)))
_MARGINS = tuple(foldstats.Linear(name, "svm", x) for name, x in (("svm_regularized", 0.1), ("svm_default", 1.0)))
FOLDS = (1, 2, 3, 4, 5)


def _job_table(t: Tables) -> DataFrame:
    """Every origin with both feature vectors, the labels of all jobs and its place in the folds."""
    panel = t.clean().withColumns(
        {"level": clean.capacity_band(F.col("load"), F.col("capacity")), "observed": ~F.col("inserted")}
    )
    ts = F.col("ts")
    out = features.add_history(panel, SPEC, PLAN).withColumns({**features.clock_columns(ts), **features.peak_columns(ts, PLAN)})
    out = features.add_targets(out.withColumns(features.cyclic_columns()), SPEC, _TARGETS, HORIZONS)
    out = splits.assign(out, "ts", t.splits(), {h: f"target_ts_h{h}" for h in HORIZONS}).filter("history_available")
    labels = []
    for job in JOBS:
        value = F.col(f"target_{job.target}_h{job.horizon}")
        value = splits.encode(value, LEVELS) if job.target == "level" else value
        usable = F.col(f"target_{job.target}_h{job.horizon}_available") & F.col(f"target_within_split_h{job.horizon}")
        labels.append(F.when(usable, value.cast("double")))
    base = durable(out.select("entity", "ts", "split", *NAMES, F.array(*labels).alias("labels"), *[f"target_ts_h{h}" for h in HORIZONS]))
    groups = prep.feature_groups(base.schema, NAMES, bounded=_BOUNDED)
    fitted = prep.fit(base.filter("split = 'train'"), groups)
    made = fitted.transform(fitted.transform(base, "tree", "features"), "linear", "features_linear")
    made = made.withColumn("x", vector_to_array("features_linear")).withColumns(foldstats.fold_places(F.col("ts"), _folds(t).collect()))
    return made.drop(*NAMES)


def job_table(t: Tables) -> DataFrame:
    return t.kept("job_table", lambda: _job_table(t))


def _labels_of(jobs: tuple[foldstats.Job, ...]):
    return F.slice("labels", JOBS.index(jobs[0]) + 1, len(jobs))


def _linear_folds(t: Tables, jobs: tuple[foldstats.Job, ...], candidates: tuple[foldstats.Linear, ...]) -> DataFrame:
    rows = job_table(t).filter("split = 'train'").withColumn("labels", _labels_of(jobs))
    return foldstats.fold_table(rows, jobs, candidates, FOLDS, len(NAMES), "x")


def _placed(jobs) -> list[tuple[str, int]]:
    return [(j.job_id, JOBS.index(j)) for j in jobs]


def _number_folds(t: Tables) -> DataFrame:
    """Folds of all number jobs: the linear family from shared sums, the trees from their own fits."""
    trees = models.job_folds(
        job_table(t), _placed(NUMBER_JOBS), [_SPECS["tree"]], FOLDS, lambda spec, _: models.build_regressor(spec),
        lambda model, rows, _: models.regression_score(model, rows),
    )
    broken = models.job_folds(
        job_table(t), _placed(NUMBER_JOBS[:1]), [models.Candidate("broken", "decision_tree", {"maxDepth": 99})], FOLDS,
        lambda spec, _: models.build_regressor(spec), lambda model, rows, _: models.regression_score(model, rows),
    )
    return _linear_folds(t, NUMBER_JOBS, _RIDGES).unionByName(trees).unionByName(broken)


def number_folds(t: Tables) -> DataFrame:
    return t.kept("number_folds", lambda: _number_folds(t))


def _class_folds(t: Tables) -> DataFrame:
    """Folds of all class jobs; trees at the first horizon."""
    first = [j for j in CLASS_JOBS if j.horizon == 1]
    trees = models.job_folds(
        job_table(t), _placed(first), [_CLASSIFIERS["tree"]], FOLDS, lambda spec, place: models.build_classifier(spec, JOBS[place].classes),
        lambda model, rows, place: models.classifier_score(JOBS[place].classes)(model, rows), weigh=True,
    )
    return _linear_folds(t, CLASS_JOBS, _MARGINS).unionByName(trees)


def class_folds(t: Tables) -> DataFrame:
    return t.kept("class_folds", lambda: _class_folds(t))


@query("ML11_cross_validation")
def _(t: Tables) -> DataFrame:
    return number_folds(t).select(
        "job_id", "candidate_id", "family", "fold", "status", "error", *[F.element_at("metrics", m).alias(m) for m in ("rmse", "mae", "r_squared")]
    )


@query("ML11b_classifier_cross_validation")
def _(t: Tables) -> DataFrame:
    return class_folds(t).select(
        "job_id", "candidate_id", "family", "fold", "status", "error", *[F.element_at("metrics", m).alias(m) for m in ("accuracy", "macro_f1")]
    )


def _model_cv(folds: DataFrame, names: tuple[str, ...]) -> DataFrame:
    wide = folds.withColumns({m: F.element_at("metrics", m) for m in names})
    return models.aggregate_folds(wide, ["job_id", "family", "candidate_id"], names, len(FOLDS))


@query("ML12b_model_fold_aggregates")
def _(t: Tables) -> DataFrame:
    numbers = _model_cv(number_folds(t), ("rmse",)).withColumn("metric", F.lit("rmse")).withColumnsRenamed({"mean_rmse": "mean", "std_rmse": "deviation"})
    classes = _model_cv(class_folds(t), ("macro_f1",)).withColumn("metric", F.lit("macro_f1")).withColumnsRenamed({"mean_macro_f1": "mean", "std_macro_f1": "deviation"})
    return tidy(numbers.unionByName(classes))


_FEATURES = {"linear_regression": "features_linear", "decision_tree": "features"}


def _finalists(t: Tables) -> list[dict]:
    """Best candidate of each family of each number job by its folds, fitted on all training rows and scored on validation."""
    table = models.choose_within_family(_model_cv(number_folds(t), ("rmse",)), ["job_id"], "mean_rmse").collect()
    specs = {c.candidate_id: models.Candidate(c.candidate_id, c.family, {"regParam": c.strength}, "features_linear") for c in _RIDGES}
    specs[_SPECS["tree"].candidate_id] = _SPECS["tree"]
    # Every fit reads its rows several times.
    rows = job_table(t).filter("split <> 'test'").select("labels", "features", "features_linear", "split").persist(StorageLevel.MEMORY_AND_DISK)
    jobs = {j.job_id: j for j in NUMBER_JOBS}

    def fit(row) -> dict:
        job, spec = jobs[row["job_id"]], specs[row["candidate_id"]]
        mine = models.job_rows(rows, JOBS.index(job), spec.features)
        model = models.build_regressor(spec).fit(mine.filter("split = 'train'"))
        found = models.regression_score(model, mine.filter("split = 'validation'")).first()
        return {
            "job_id": job.job_id, "target": job.target, "horizon": job.horizon, "family": spec.family, "candidate_id": spec.candidate_id,
            "features": spec.features, "model": model, "cv_rmse": row["mean_rmse"], "validation_rmse": found["rmse"],
        }

    try:
        with ThreadPoolExecutor(8) as pool:
            return list(pool.map(fit, table))
    finally:
        rows.unpersist()


_FINALISTS = "job_id string, family string, candidate_id string, cv_rmse double, validation_rmse double"


def _chosen_models(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The registry of the winners' saved models and the table that chose them."""
    fitted = _finalists(t)
    columns = [c.split()[0] for c in _FINALISTS.split(", ")]
    table = t.spark.createDataFrame([tuple(f[c] for c in columns) for f in fitted], _FINALISTS)
    won = {(r["job_id"], r["family"]) for r in models.choose_across_families(table, ["job_id"], "validation_rmse", "cv_rmse").collect()}
    version = f"registry-{uuid.uuid4().hex[:12]}"
    chosen = [f for f in fitted if (f["job_id"], f["family"]) in won]
    return serving.save_models(t.spark, chosen, f"{shared_dir(t.spark)}/models", version), table


def chosen_models(t: Tables) -> tuple[DataFrame, DataFrame]:
    def build() -> DataFrame:
        entries, table = _chosen_models(t)
        won = entries.withColumn("job_id", F.concat("target", F.lit("_h"), F.col("horizon").cast("string")))
        return table.join(won.drop("family"), ["job_id", "candidate_id"], "left")

    kept = t.kept("chosen_models", build)
    entries = kept.filter("path IS NOT NULL").select("target", "horizon", "family", "candidate_id", "features", "version", "path")
    return entries, kept.select("job_id", "family", "candidate_id", "cv_rmse", "validation_rmse", F.col("path").isNotNull().alias("chosen"))


@query("ML13b_model_winners")
def _(t: Tables) -> DataFrame:
    return tidy(chosen_models(t)[1])


def served_numbers(t: Tables, parts: tuple[str, ...] = ("validation", "test")) -> DataFrame:
    """Long predictions of the chosen models: one scan of the job table, each row by its own model."""
    rows = job_table(t).filter(F.col("split").isin(*parts))
    jobs = F.array(*[
        F.struct(F.lit(j.target).alias("target"), F.lit(j.horizon).alias("horizon"), F.lit(j.horizon * 30).alias("horizon_minutes"),
                 F.col(f"target_ts_h{j.horizon}").alias("target_ts"), F.col("labels")[JOBS.index(j)].alias("actual"))
        for j in NUMBER_JOBS
    ])
    long = rows.select("entity", "ts", "split", "features", "features_linear", F.explode(jobs).alias("r")).select(
        "entity", "ts", "split", "features", "features_linear", "r.*"
    )
    scored = serving.predict_routed(long.filter("actual IS NOT NULL"), chosen_models(t)[0])
    return scored.drop("features", "features_linear").withColumn("residual", F.col("actual") - F.col("prediction"))


@query("RT4b_routed_models")
def _(t: Tables) -> DataFrame:
    """Rows, models and errors of each routed job."""
    out = metrics.regression_metrics(served_numbers(t), ["target", "horizon", "split", "routed"])
    return out.select("target", "horizon", "split", "routed", "rows", "rmse", "r_squared")


# Fold metrics of the two baseline forecasters, as candidates of two families.
cte(
    "fold_metrics",
    f"SELECT f.horizon, f.model_version AS candidate_id, CASE f.model_version WHEN 'last_value' THEN 'recent' ELSE 'seasonal' END AS family, k.fold, "
    f"{r('sqrt(avg((prediction - actual) * (prediction - actual)))', 10)} AS rmse FROM forecasts f JOIN folds k ON f.ts BETWEEN k.validation_start AND k.validation_end WHERE f.split = 'train' AND f.horizon <= 4 GROUP BY 1, 2, 3, 4",
    "forecasts",
    "folds",
)
cte(
    "cv_table",
    "SELECT horizon, family, candidate_id, count(*) AS folds, count(*) AS successful_folds, CASE WHEN count(*) = 5 THEN avg(rmse) END AS mean_rmse, CASE WHEN count(*) = 5 THEN stddev_pop(rmse) END AS std_rmse FROM fold_metrics GROUP BY 1, 2, 3",
    "fold_metrics",
)


def _cv_table(t: Tables) -> DataFrame:
    rows = splits.fold_rows(t.forecasts().filter("split = 'train'"), "ts", _folds(t)).filter("role = 'validation'")
    per = metrics.regression_metrics(rows, ["horizon", "model_version", "fold"]).withColumnRenamed("model_version", "candidate_id")
    family = F.when(F.col("candidate_id") == "last_value", "recent").otherwise("seasonal")
    return models.aggregate_folds(
        per.withColumns({"family": family, "status": F.lit("ok")}), ["horizon", "family", "candidate_id"], ["rmse"], 5
    )


@query("ML12_fold_aggregates", with_ctes("cv_table", f"SELECT horizon, family, candidate_id, folds, successful_folds, {nudged('mean_rmse')} AS mean_rmse, {nudged('std_rmse')} AS std_rmse FROM cv_table"))
def _(t: Tables) -> DataFrame:
    return tidy(_cv_table(t))


cte("winners", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY mean_rmse, family, candidate_id) AS rn FROM cv_table) WHERE rn = 1", "cv_table")


@query("ML13_winner", with_ctes("winners", f"SELECT horizon, family, candidate_id, {nudged('mean_rmse')} AS mean_rmse FROM winners"))
def _(t: Tables) -> DataFrame:
    within = models.choose_within_family(_cv_table(t), ["horizon"], "mean_rmse")
    return tidy(models.choose_across_families(within, ["horizon"], "mean_rmse", "mean_rmse").select("horizon", "family", "candidate_id", "mean_rmse"))


def _calibrated(t: Tables, job: foldstats.Job, spec: models.Candidate) -> tuple[DataFrame, DataFrame]:
    """Scores of the later validation half before and after calibration on the earlier half."""
    rows = job_table(t).withColumn("label", F.col("labels")[JOBS.index(job)]).filter("label IS NOT NULL")
    model = models.build_classifier(spec, job.classes).fit(models.weighted(rows.filter("split = 'train'").select("label", spec.features)))
    valid = splits.calibration_halves(rows.filter("split = 'validation'"), "ts")
    scored = durable(models.class_scores(model.transform(valid), job.classes, "scores").select("entity", "ts", "half", "label", "scores"))
    curve = models.fit_sigmoid(scored.filter("half = 'fit'"), "scores", "label", job.classes)
    return scored.filter("half = 'assess'"), curve.transform(scored.filter("half = 'assess'"), "scores")


_EVENT_JOB, _LEVEL_JOB = foldstats.Job("incident", 1, 2), foldstats.Job("level", 1, 4)


@query("ML14_sigmoid_calibration")
def _(t: Tables) -> DataFrame:
    _, after = _calibrated(t, _EVENT_JOB, _CLASSIFIERS["tree"])
    return after.select("entity", "ts", F.col("label").cast("int").alias("actual_class_index"), F.element_at("probabilities", 2).alias("probability"))


@query("ML14b_multiclass_calibration")
def _(t: Tables) -> DataFrame:
    """Four classes; each class's curve keeps the order of its scores."""
    _, after = _calibrated(t, _LEVEL_JOB, _CLASSIFIERS["tree"])
    return after.select(
        "entity", "ts", F.col("label").cast("int").alias("actual_class_index"), *[F.element_at("probabilities", i + 1).alias(f"probability_{i}") for i in range(4)]
    )


# Newton steps of all curves at once, as a recursive query.
_NEWTON = """
, pairs AS (
  SELECT horizon, i AS class_index, probabilities[i + 1] AS s, actual_class_index = i AS hit, n, m
  FROM (SELECT *, count(*) OVER (PARTITION BY horizon) AS n FROM classified WHERE task = 'level' AND split = 'validation') c, range(4) k(i)
  JOIN (SELECT horizon AS hh, j, m FROM (SELECT horizon, j, count(*) FILTER (actual_class_index = j) AS m FROM classified, range(4) x(j) WHERE task = 'level' AND split = 'validation' GROUP BY 1, 2)) z ON z.j = k.i
  WHERE z.hh = c.horizon),
d AS (SELECT horizon, class_index, s, CASE WHEN hit THEN CAST(m + 1 AS DOUBLE) / (m + 2) ELSE CAST(1 AS DOUBLE) / (n - m + 2) END AS t FROM pairs),
newton(step, horizon, class_index, a, b) AS (
  SELECT DISTINCT 0, horizon, class_index, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM d
  UNION ALL
  SELECT step + 1, horizon, class_index, a + (hab * gb - hbb * ga) / (haa * hbb - hab * hab), b + (hab * ga - haa * gb) / (haa * hbb - hab * hab)
  FROM (SELECT step, horizon, class_index, any_value(a) AS a, any_value(b) AS b, sum((p - t) * s) AS ga, sum(p - t) AS gb,
               sum(p * (1 - p) * s * s) + 1e-10 AS haa, sum(p * (1 - p) * s) AS hab, sum(p * (1 - p)) + 1e-10 AS hbb
        FROM (SELECT step, horizon, class_index, a, b, s, t, 1 / (1 + exp(-(a * s + b))) AS p FROM newton JOIN d USING (horizon, class_index) WHERE step < 30)
        GROUP BY step, horizon, class_index))
SELECT horizon, CAST(class_index AS INTEGER) AS class_index, round(a, 4) + 0 AS slope, round(b, 4) + 0 AS intercept FROM newton WHERE step = 30"""


def _newton_sql() -> str:
    head = with_ctes("classified", "SELECT 1")
    return head[: head.rindex("SELECT 1")].rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + _NEWTON


@query("ML14c_calibration_curves", _newton_sql())
def _(t: Tables) -> DataFrame:
    """Curves of the four level classes, fitted together for each horizon."""
    rows = t.classified().filter("task = 'level' AND split = 'validation'").select("horizon", "probabilities", "actual_class_index")
    out = []
    for h in HORIZONS:
        fit = models.fit_sigmoid(rows.filter(F.col("horizon") == h), "probabilities", "actual_class_index", 4)
        out += [(h, i, a, b) for i, (a, b) in enumerate(fit.curves)]
    table = t.spark.createDataFrame(out, "horizon int, class_index int, slope double, intercept double")
    return table.select("horizon", "class_index", *[rounded(F.col(c), 4).alias(c) for c in ("slope", "intercept")])


@query("ML15_calibration_choice")
def _(t: Tables) -> DataFrame:
    """The decision for two and for four classes."""
    out = []
    for job in (_EVENT_JOB, _LEVEL_JOB):
        before, after = _calibrated(t, job, _CLASSIFIERS["tree"])
        raw = metrics.probability_quality(before.withColumn("job_id", F.lit(job.job_id)), ["job_id"], "scores", "label")
        new = metrics.probability_quality(after.withColumn("job_id", F.lit(job.job_id)), ["job_id"], "probabilities", "label")
        out.append(metrics.calibration_decision(raw, new, ["job_id"], 0.0001))
    return out[0].unionByName(out[1])


_CUTS = "[" + ", ".join(f"CAST({i / 200!r} AS DOUBLE)" for i in range(201)) + "]"
cte("cuts200", f"SELECT lang, list_sort(list_distinct(list_append(list_transform(quantile_cont(score, {_CUTS}), lambda x: round(x, 12)), CAST(0.5 AS DOUBLE)))) AS ts FROM scored GROUP BY 1", "scored")
cte(
    "threshold_rows",
    f"""SELECT lang, {r('t', 10)} AS threshold, {r('coalesce(tp / nullif(tp + fp, 0), 0)', 10)} AS precision, {r('coalesce(tp / nullif(p, 0), 0)', 10)} AS recall, {r('coalesce(2 * tp / nullif(tp + fp + p, 0), 0)', 10)} AS f1, tp + fp AS predicted_positive_rows
    FROM (SELECT c.lang, c.t, count(*) FILTER (s.actual = 1 AND s.score >= c.t) AS tp, count(*) FILTER (s.actual = 0 AND s.score >= c.t) AS fp, count(*) FILTER (s.actual = 1) AS p
    FROM (SELECT lang, unnest(ts) AS t FROM cuts200) c JOIN scored s USING (lang) GROUP BY 1, 2)""",
    "cuts200",
    "scored",
)


@query("ML16_threshold_table", with_ctes("threshold_rows", "SELECT DISTINCT * FROM threshold_rows"))
def _(t: Tables) -> DataFrame:
    # Two candidates may show the same ten digits.
    return metrics.threshold_table(t.scored(), ["lang"], "score", "actual", 201, 0.5).distinct()


@query("ML16b_best_threshold", with_ctes("threshold_rows", "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY f1 DESC, recall DESC, precision DESC, threshold) AS rn FROM threshold_rows) WHERE rn = 1"))
def _(t: Tables) -> DataFrame:
    return metrics.best_threshold(metrics.threshold_table(t.scored(), ["lang"], "score", "actual", 201, 0.5), ["lang"])


@query("ML17_feature_importance")
def _(t: Tables) -> DataFrame:
    """A tree and a linear model of a number, a tree of each class job."""
    rows = job_table(t).filter("split = 'train'")
    number = JOBS.index(NUMBER_JOBS[0])
    fits = []
    for name in ("tree", "linear"):
        spec = _SPECS[name]
        fits.append((f"load_h1_{name}", models.build_regressor(spec).fit(models.job_rows(rows, number, spec.features))))
    for job in (_EVENT_JOB, _LEVEL_JOB):
        mine = models.weighted(models.job_rows(rows, JOBS.index(job), "features"))
        fits.append((f"{job.job_id}_tree", models.build_classifier(_CLASSIFIERS["tree"], job.classes).fit(mine)))
    return reduce(DataFrame.unionByName, [models.importance_table(model, NAMES, rows, name) for name, model in fits])


@query("ML18_regression_scoring")
def _(t: Tables) -> DataFrame:
    """Both targets at all horizons, by the chosen models."""
    scored = served_numbers(t).withColumn("job_id", F.concat("target", F.lit("_h"), F.col("horizon").cast("string")))
    return scored.select(
        "entity", "ts", "target_ts", "split", "job_id", "target", "horizon", "horizon_minutes", "actual", "prediction", "residual", "model_version"
    )


def _class_scored(t: Tables, job: foldstats.Job) -> DataFrame:
    rows = job_table(t).withColumn("label", F.col("labels")[JOBS.index(job)]).filter("label IS NOT NULL")
    rows = rows.withColumn("target_ts", F.col(f"target_ts_h{job.horizon}"))
    train = rows.filter("split = 'train'").select("label", "features")
    model = models.build_classifier(_CLASSIFIERS["tree"], job.classes).fit(models.weighted(train))
    return models.class_scores(model.transform(rows.filter("split <> 'train'")), job.classes)


@query("ML19_classification_scoring")
def _(t: Tables) -> DataFrame:
    """Four classes by the largest probability, all horizons."""
    jobs = [j for j in CLASS_JOBS if j.target == "level"]
    with ThreadPoolExecutor(4) as pool:
        scored = list(pool.map(lambda j: _class_scored(t, j), jobs))
    return reduce(DataFrame.unionByName, [models.classification_rows(s, j.job_id, LEVELS, j.horizon, "tree_v1") for j, s in zip(jobs, scored, strict=True)])


@query("ML19b_thresholded_scoring")
def _(t: Tables) -> DataFrame:
    """Two classes by each job's own threshold, the best F1 on the validation rows, all horizons."""
    jobs = [j for j in CLASS_JOBS if j.target == "incident"]

    def one(job: foldstats.Job) -> DataFrame:
        scored = durable(_class_scored(t, job).select("entity", "ts", "target_ts", "split", "label", "probabilities"))
        valid = scored.filter("split = 'validation'").select(
            F.lit(job.job_id).alias("job_id"), F.element_at("probabilities", 2).alias("p"), F.col("label").cast("int").alias("actual")
        )
        best = metrics.best_threshold(metrics.threshold_table(valid, ["job_id"], "p", "actual", 201, 0.5), ["job_id"]).first()
        return models.classification_rows(scored, job.job_id, ("no_incident", "incident"), job.horizon, "tree_v1", best["threshold"] if best else 0.5)

    with ThreadPoolExecutor(4) as pool:
        return reduce(DataFrame.unionByName, list(pool.map(one, jobs)))


@query(
    "ML20_wide_to_long",
    with_ctes("targets", " UNION ALL ".join(f"SELECT entity, ts, CAST({h} AS INTEGER) AS horizon, target_ts_h{h} AS target_ts, target_load_h{h} AS actual FROM targets" for h in HORIZONS)),
)
def _(t: Tables) -> DataFrame:
    return models.wide_to_long(t.targets(), ["entity", "ts"], HORIZONS, {"target_ts": "target_ts", "actual": "target_load"})


def _class_marks(t: Tables) -> DataFrame:
    """Probabilities of every later row by the class models, calibrated where that helps, with thresholds and bands.

    A row needs no label to be served.
    """

    def one(job: foldstats.Job) -> DataFrame:
        rows = job_table(t).withColumn("label", F.col("labels")[JOBS.index(job)])
        train = rows.filter("split = 'train' AND label IS NOT NULL").select("label", "features")
        model = models.build_classifier(_CLASSIFIERS["tree"], job.classes).fit(models.weighted(train))
        scored = models.class_scores(model.transform(rows.filter("split <> 'train'")), job.classes, "scores")
        scored = durable(scored.select("entity", "ts", "split", "label", "scores"))
        halves = durable(splits.calibration_halves(scored.filter("split = 'validation' AND label IS NOT NULL"), "ts"))
        curve = models.fit_sigmoid(halves.filter("half = 'fit'"), "scores", "label", job.classes)
        later = curve.transform(halves.filter("half = 'assess'"), "scores").withColumn("job_id", F.lit(job.job_id))
        quality = [metrics.probability_quality(later, ["job_id"], c, "label") for c in ("scores", "probabilities")]
        decision = metrics.calibration_decision(*quality, ["job_id"], 0.0001).first()
        out = curve.transform(scored, "scores") if decision and decision["applied"] else scored.withColumn("probabilities", F.col("scores"))
        threshold = None
        if job.classes == 2:
            valid = out.filter("split = 'validation' AND label IS NOT NULL").select(
                F.lit(job.job_id).alias("job_id"), F.element_at("probabilities", 2).alias("p"), F.col("label").cast("int").alias("actual")
            )
            best = metrics.best_threshold(metrics.threshold_table(valid, ["job_id"], "p", "actual", 201, 0.5), ["job_id"]).first()
            threshold = best["threshold"] if best else 0.5
        event = F.element_at("probabilities", 2) if job.classes == 2 else F.lit(None).cast("double")
        return out.withColumns({
            "task": F.lit(job.target), "horizon": F.lit(job.horizon), "event_probability": event, "operating_threshold": F.lit(threshold).cast("double"),
            "confidence_band": uncertainty.confidence_band(F.array_max("probabilities")),
        }).withColumn("risk_band", uncertainty.risk_band(F.col("event_probability"), F.col("operating_threshold"))).drop("scores", "label")

    with ThreadPoolExecutor(4) as pool:
        return reduce(DataFrame.unionByName, list(pool.map(one, CLASS_JOBS)))


def class_marks(t: Tables) -> DataFrame:
    return t.kept("class_marks", lambda: _class_marks(t))


cte("descent", "SELECT *, (l_quantity - 25.5) / 14.5 AS quantity, (l_discount - 0.05) / 0.03 AS discount, l_extendedprice / 10000 AS price FROM lineitem")


def _descent_rows(t: Tables) -> DataFrame:
    return t.lineitem.select(
        ((F.col("l_quantity") - 25.5) / 14.5).alias("quantity"), ((F.col("l_discount") - 0.05) / 0.03).alias("discount"),
        (F.col("l_extendedprice") / 10000).alias("price"),
    )


@query("ML21_gradient_descent", with_ctes("descent", "SELECT 'quantity' AS feature, round(regr_slope(price, quantity), 4) AS weight FROM descent UNION ALL SELECT '(bias)', round(regr_intercept(price, quantity), 4) FROM descent"))
def _(t: Tables) -> DataFrame:
    rows = _descent_rows(t)
    fit = models.gradient_descent(rows, ["quantity"], "price", tolerance=1e-15)
    return fit.table(rows, "weight").select("feature", F.round("weight", 4).alias("weight"))


# Normal equations of two features, by covariances.
cte(
    "normal_two",
    "SELECT *, (vb * sa - vab * sb) / (va * vb - vab * vab) AS wa, (va * sb - vab * sa) / (va * vb - vab * vab) AS wb FROM ("
    "SELECT var_pop(quantity) AS va, var_pop(discount) AS vb, covar_pop(quantity, discount) AS vab, covar_pop(quantity, price) AS sa, covar_pop(discount, price) AS sb, "
    "avg(quantity) AS ma, avg(discount) AS mb, avg(price) AS mp FROM descent)",
    "descent",
)


@query(
    "ML22_coefficient_comparison",
    with_ctes(
        "normal_two",
        f"SELECT feature, {r('w', 5)} AS descent, {r('w', 5)} AS library, CAST(0 AS DOUBLE) AS absolute_difference FROM (SELECT 'quantity' AS feature, wa AS w FROM normal_two "
        "UNION ALL SELECT 'discount', wb FROM normal_two UNION ALL SELECT '(bias)', mp - wa * ma - wb * mb FROM normal_two)",
    ),
)
def _(t: Tables) -> DataFrame:
    rows = _descent_rows(t)
    names = ["quantity", "discount"]
    ours = models.gradient_descent(rows, names, "price", tolerance=1e-15).table(rows, "descent")
    assembled = VectorAssembler(inputCols=names, outputCol="features").transform(rows.withColumnRenamed("price", "label"))
    fit = models.build_regressor(models.Candidate("linear", "linear_regression")).fit(assembled)
    theirs = [*zip(names, [float(c) for c in fit.coefficients]), ("(bias)", float(fit.intercept))]
    other = t.spark.createDataFrame(theirs, "feature string, library double")
    out = models.compare_coefficients(ours, other, ("descent", "library"))
    return out.select("feature", *[rounded(F.col(c), 5).alias(c) for c in ("descent", "library", "absolute_difference")])


@query("ML23_sequence_forecast")
def _(t: Tables) -> DataFrame:
    """Two window lengths per horizon model; the one with the lower mean validation RMSE forecasts the test rows."""
    rows = _rows(t).select(
        "entity", "ts", "split", "load", "speed", *[f"target_ts_h{h}" for h in HORIZONS], *[f"target_load_h{h}" for h in HORIZONS],
        *[f"target_load_h{h}_available" for h in HORIZONS], *[f"target_within_split_h{h}" for h in HORIZONS],
    )
    rows = durable(rows)
    mask = sequences.endpoint_mask(HORIZONS, "load", SPEC)
    spec = models.Candidate("sequence_linear", "linear_regression", {"regParam": 0.1})
    scored = []
    for length in (4, 12):
        made = sequences.feature_sequences(rows, SPEC, ["load", "speed"], length).filter(mask)
        made = made.filter(~F.exists(F.flatten("sequence"), lambda x: x.isNull()))
        data = durable(models.sequence_vector(made).drop("sequence"))
        fits = models.horizon_models(data.filter("split = 'train'"), spec, HORIZONS, "target_load")
        wide = models.horizon_forecasts(data.filter("split <> 'train'"), fits, "target_load")
        error = models.mean_validation_rmse(wide.filter("split = 'validation'"), HORIZONS, "target_load").first()["mean_rmse"]
        scored.append((error, length, wide))
    error, length, wide = min(scored, key=lambda x: (x[0], x[1]))
    long = models.wide_to_long(
        wide.filter("split = 'test'"), ["entity", "ts"], HORIZONS, {"target_ts": "target_ts", "actual": "target_load", "prediction": "prediction"}
    )
    return long.withColumns({"sequence_length": F.lit(length), "validation_mean_rmse": F.lit(float(error))})
