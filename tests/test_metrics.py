"""Metrics, uncertainty, slices, aggregates and registry tables on hand-made rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import aggregates, enrich, metrics, models, prep, registry, slices, uncertainty

from .conftest import at

LEVELS = ("Free-flow", "Moderate", "Heavy", "Severe")


def test_regression_metrics_match_numpy(spark):
    rng = np.random.default_rng(0)
    y, p = rng.normal(5, 3, 200), rng.normal(5, 3, 200)
    y[:3] = 0.0
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "actual double, prediction double")
    r = metrics.regression_metrics(df, []).first()
    e, nz = p - y, y != 0
    assert r["rmse"] == pytest.approx(math.sqrt((e**2).mean()), abs=1e-9)
    assert r["mape_percent"] == pytest.approx((abs(e[nz]) / abs(y[nz])).mean() * 100, abs=1e-6)
    assert r["r_squared"] == pytest.approx(1 - (e**2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-9)
    assert (r["mape_nonzero_rows"], r["mape_zero_actual_rows"]) == (197, 3)
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0)], "actual double, prediction double")
    assert metrics.regression_metrics(flat, []).first()["r_squared"] == 0.0


def test_ranking_metrics_match_pairs(spark):
    rng = np.random.default_rng(1)
    s, y = np.round(rng.random(300), 2), rng.integers(0, 2, 300)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int")
    r = metrics.ranking_metrics(df, [], "s", "y").first()
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    ap = sum((s[y == 1] == t).sum() / len(pos) * (y[s >= t]).mean() for t in np.unique(s))
    assert r["roc_auc"] == pytest.approx(auc, abs=1e-9) and r["pr_auc"] == pytest.approx(ap, abs=1e-9)


def test_threshold_choice_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    s = np.round(rng.random(150), 3)
    y = (rng.random(150) < s).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int")
    cuts = np.unique(np.concatenate([np.quantile(s, np.linspace(0, 1, 21)), [0.5]]))
    rows = []
    for t in cuts:
        hit = s >= t
        tp, fp = int((hit & (y == 1)).sum()), int((hit & (y == 0)).sum())
        precision, recall = tp / (tp + fp) if tp + fp else 0.0, tp / y.sum()
        rows.append((round(2 * tp / (tp + fp + y.sum()), 10), round(recall, 10), round(precision, 10), -round(float(t), 10)))
    best = metrics.best_threshold(metrics.threshold_table(df, [], "s", "y", 21, 0.5), []).first()
    assert (best["f1"], best["recall"], best["precision"], -best["threshold"]) == pytest.approx(max(rows), abs=1e-9)


def test_multiclass_zero_division_and_confusion(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "actual_class_index int, predicted_class_index int")
    r = metrics.multiclass_metrics(df, [], 4).first()
    assert r["accuracy"] == 0.5 and r["macro_precision"] == pytest.approx((1 + 1 / 3) / 4, abs=1e-9)
    assert r["macro_f1"] == pytest.approx((2 / 3 + 0.5) / 4, abs=1e-9)
    cells = metrics.confusion_long(df, [], LEVELS)
    assert cells.count() == 16 and cells.agg(F.sum("rows")).first()[0] == 4


def test_probability_quality_and_contract(spark):
    df = spark.createDataFrame([(0, [0.7, 0.3]), (1, [0.4, 0.6])], "actual_class_index int, probabilities array<double>")
    r = metrics.probability_quality(df, []).first()
    assert r["brier_score"] == pytest.approx((2 * 0.09 + 2 * 0.16) / 2, abs=1e-9)
    assert r["log_loss"] == pytest.approx(-(math.log(0.7) + math.log(0.6)) / 2, abs=1e-9)
    bad = spark.createDataFrame([([0.5, 0.6],), ([float("nan"), 1.0],), ([1.2, -0.2],)], "probabilities array<double>")
    v = metrics.probability_violations(bad, []).first()
    assert (v["rows"], v["non_finite"], v["out_of_range"] >= 1, v["bad_sum"] >= 1) == (3, 1, True, True)


def predictions(spark, residuals, split="validation"):
    rows = [("m", "load", 1, 30, split, float(r), 0.0) for r in residuals] + [("m", "load", 1, 30, "test", 1000.0, 0.0)]
    return spark.createDataFrame(rows, "model_version string, target string, horizon int, horizon_minutes int, split string, actual double, prediction double")


def test_conformal_width_uses_validation_rank(spark):
    r = uncertainty.conformal_widths(predictions(spark, [1, 2, 3, 4]), 0.80).first()
    assert (r["finite_sample_rank"], r["width"], r["calibration_rows"]) == (4, 4.0, 4)
    many = uncertainty.conformal_widths(predictions(spark, range(1, 101)), 0.90).first()
    assert (many["finite_sample_rank"], many["width"]) == (91, 91.0)


def test_risk_and_confidence_bands(spark):
    df = spark.createDataFrame([(p,) for p in (0.004, 0.007, 0.015, 0.03)], "p double").orderBy("p")
    assert [r[0] for r in df.select(uncertainty.risk_band(F.col("p"), F.lit(0.01))).collect()] == list(uncertainty.RISK_BANDS)
    one = spark.createDataFrame([([0.1, 0.7, 0.1, 0.1], 1, 1)], "probabilities array<double>, actual_class_index int, predicted_class_index int")
    r = one.withColumns(uncertainty.confidence_columns()).first()
    assert r["confidence_band"] == "medium" and r["correct"] and r["normalized_entropy"] == pytest.approx(r["entropy"] / math.log(4))


def test_reliability_keeps_empty_bins(spark):
    df = spark.createDataFrame([("g", 0.05, 0.0), ("g", 0.95, 1.0), ("g", 1.0, 0.0)], "k string, _p double, _y double")
    rows = uncertainty.reliability_table(df, ["k"], 10).orderBy("bin_index").collect()
    assert [r["rows"] for r in rows] == [1] + [0] * 8 + [2]
    assert rows[0]["expected_calibration_error"] == pytest.approx((0.05 + 2 * abs(0.975 - 0.5)) / 3, abs=1e-6)
    assert rows[4]["mean_probability"] is None


def test_slices_keep_unsupported_rows_without_metrics(spark):
    rows = [("m", e, 1.0, 2.0) for e in "AAB"]
    df = spark.createDataFrame(rows, "k string, entity string, actual double, prediction double").withColumn("width", F.lit(0.5))
    out = slices.regression_slices(df.withColumns(uncertainty.interval_columns()), ["k"], ["entity"], 2)
    got = {r["slice_value"]: r for r in out.collect()}
    assert set(got) == {"all", "A", "B"}
    assert not got["B"]["sufficient_support"] and got["B"]["rmse"] is None and got["B"]["rows"] == 1
    assert got["A"]["rmse"] == 1.0 and got["A"]["residual_median"] == 1.0


def test_pairing_checks_actuals(spark):
    rows = [("e", 1, "a", 100.0, 90.0), ("e", 1, "b", 99.0, 101.0), ("e", 2, "a", 5.0, 5.0), ("e", 2, "b", 5.0, 5.0), ("e", 3, "a", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "entity string, k int, model_version string, actual double, prediction double")
    df = df.withColumn("absolute_error", F.abs(F.col("prediction") - F.col("actual")))
    pairs = enrich.pair_models(df, "a", "b", ["entity", "k"], ["prediction", "absolute_error"])
    assert pairs.count() == 2
    with pytest.raises(ValueError, match="1 actuals differ"):
        enrich.require_paired(pairs)
    enrich.require_paired(pairs.filter("k = 2"))
    assert slices.with_winner(pairs.filter("k = 2")).first()["winner"] == "tie"


def test_dashboard_aggregates(spark):
    rows = [("r", at("01 00:00").replace(minute=0), 100, "Free-flow", 0), ("r", at("01 00:30"), 120, "Moderate", 0), ("r", at("01 01:00"), 140, "Heavy", 1), ("r", at("01 01:30"), 160, "Severe", 0)]
    df = spark.createDataFrame(rows, "entity string, ts timestamp_ntz, load int, level string, events int")
    cells = aggregates.severity_matrix(df, "entity", "ts", "level", LEVELS).first()["cells"]
    assert [c["severity"] for c in cells] == [0, 1, 2, 3]
    wide = aggregates.severity_pivot(df, "entity", "ts", "level", LEVELS, 2).first()
    assert [wide[i] for i in (1, 2)] == [2, 3]
    s = aggregates.entity_summary(df, ["entity"], "load", ["load"], "level", "Severe", "events").first()
    assert (s["mean_demand"], s["severe_share"], s["event_windows"]) == (130.0, 0.25, 1)
    batch = spark.createDataFrame([("a", "Severe", 30.0, 0.01), ("b", "Moderate", 50.0, 0.03)], "entity string, level string, speed double, risk double")
    b = aggregates.batch_snapshot(batch, "entity", "level", ["Heavy", "Severe"], "speed", "risk").first()
    assert tuple(b) == (2, 1, 40.0, 0.03)
    assert tuple(aggregates.batch_snapshot(batch.limit(0), "entity", "level", ["Heavy"], "speed", "risk").first()) == (0, 0, 0.0, 0.0)


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, None, 5.0)], "a double, b double, c double")
    got = {(r[0], r[1]): r[2] for r in aggregates.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"] == pytest.approx(1.0) and got["a", "c"] is None


def test_registry_tables(spark):
    index = registry.prediction_index(spark.createDataFrame([("j1", "validation"), ("j1", "test"), ("j2", "test")], "job_id string, split string"))
    problems = registry.index_problems(index, spark.createDataFrame([("j1",), ("j3",)], "job_id string"))
    assert sorted(tuple(r) for r in problems.collect()) == [("j2", "empty_split"), ("j2", "unregistered"), ("j3", "no_predictions")]
    left = spark.createDataFrame([("j", "rmse", 1.0), ("j", "mae", 2.0), ("j", "seconds", 9.0)], "job_id string, metric string, value double")
    right = spark.createDataFrame([("j", "rmse", 1.0 + 1e-12), ("j", "mae", 2.5), ("j", "seconds", 1.0)], "job_id string, metric string, value double")
    out = registry.compare_metrics(left, right, ["job_id"], 1e-9, ["seconds"])
    s = registry.comparison_summary(out).first()
    assert (s["metrics"], s["different"], s["max_delta"]) == (2, 1, 0.5)


def test_preprocessing_reads_training_rows_only(spark):
    train = spark.createDataFrame([(1.0, 5.0, "b"), (3.0, 5.0, "a"), (None, 5.0, "a")], "x double, k double, c string")
    fitted = prep.fit(train, prep.feature_groups(train.schema, ["x", "k", "c"], bounded=["k"]))
    stats = {r["column"]: r for r in fitted.numbers.collect()}
    assert stats["x"]["median"] == 2.0 and stats["x"]["scale"] == pytest.approx(np.std([1, 3, 2]))
    new = spark.createDataFrame([(2.0, 5.0, "zzz"), (None, 5.0, None)], "x double, k double, c string")
    got = [list(r["features"].toArray()) for r in fitted.transform(new).collect()]
    assert got == [[0.0, 0.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]]


def test_descent_matches_least_squares(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (200, 3))
    y = x @ np.array([2.0, -1.0, 0.5]) + 4 + rng.normal(0, 0.1, 200)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double")
    fit = models.gradient_descent(df, ["a", "b", "c"], "y", tolerance=1e-15)
    want = np.linalg.lstsq(np.c_[x, np.ones(200)], y, rcond=None)[0]
    assert fit.converged and np.allclose([*fit.weights, fit.bias], want, atol=1e-5)
    with pytest.raises(FloatingPointError):
        models.gradient_descent(df, ["a", "b", "c"], "y", learning_rate=5.0)


def test_selection_needs_every_fold_and_breaks_ties_by_id(spark):
    rows = [("j", "f", "b", 1.0, "ok"), ("j", "f", "b", 3.0, "ok"), ("j", "f", "a", 2.0, "ok"), ("j", "f", "a", 2.0, "ok"), ("j", "g", "x", 0.1, "ok"), ("j", "g", "x", None, "failed")]
    df = spark.createDataFrame(rows, "job string, family string, candidate_id string, rmse double, status string")
    table = models.aggregate_folds(df, ["job", "family", "candidate_id"], ["rmse"], 2)
    best = models.choose_within_family(table, ["job"], "mean_rmse").collect()
    assert [(r["candidate_id"], r["mean_rmse"], r["std_rmse"]) for r in best] == [("a", 2.0, 0.0)]
