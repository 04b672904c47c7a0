"""Linear folds from shared sums, calibration of many classes, saved models and routing, stage counters."""

import numpy as np
import pytest
from pyspark.ml import regression as mlr
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from panelwright.operators import foldstats, models, serving
from panelwright.operators.stages import StageCounters, session_of_its_own

FOLDS = [dict(fold=k, train_start=0, train_end=99 + 50 * k, validation_start=110 + 50 * k, validation_end=140 + 50 * k) for k in (1, 2, 3)]
JOBS = (foldstats.Job("y", 1), foldstats.Job("z", 1), foldstats.Job("kind", 1, 3), foldstats.Job("flag", 1, 2))


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(320, 4)) * [1, 5, 0.2, 1] + [0, 3, -1, 0]
    x[:, 3] = 7.0  # constant
    y = x @ [1.0, -2.0, 4.0, 0.0] + 3 + rng.normal(size=320)
    z = np.where(rng.random(320) < 0.2, np.nan, 100 + y * 2)
    kind = np.digitize(x[:, 1] + rng.normal(size=320), [1.0, 5.0])
    data = [(i, x[i].tolist(), [float(y[i]), None if np.isnan(z[i]) else float(z[i]), float(kind[i]), float(y[i] > 0)]) for i in range(320)]
    df = spark.createDataFrame(data, "ts int, x array<double>, labels array<double>").repartition(5)
    return df.withColumns(foldstats.fold_places(F.col("ts"), FOLDS)).cache()


def test_ridge_folds_equal_single_fits(spark, rows):
    candidates = (foldstats.Linear("plain", "linear_regression", 0.0), foldstats.Linear("ridge", "linear_regression", 3.0))
    sums = foldstats.product_sums(rows.withColumn("labels", F.slice("labels", 1, 2)), JOBS[:2], 4, "x")
    fits, refused = foldstats.fit_folds(sums, JOBS[:2], candidates, (1, 2, 3))
    assert not refused
    for (j, i, fold), fit in fits.items():
        train = rows.filter(F.col("ts") <= 99 + 50 * fold).select(array_to_vector("x").alias("features"), F.col("labels")[j].alias("label")).filter("label IS NOT NULL")
        want = mlr.LinearRegression(regParam=candidates[i].strength, solver="normal").fit(train)
        assert fit.coefficients[0] == pytest.approx(want.coefficients.toArray(), abs=1e-6)
        assert fit.intercepts[0] == pytest.approx(want.intercept, abs=1e-5)


def test_fold_table_scores_and_refusals(spark, rows):
    table = foldstats.fold_table(rows, JOBS, (foldstats.Linear("a", "linear", 1.0),), (1, 2, 3), 4, "x").collect()
    assert len(table) == 12 and all(r["status"] == "ok" for r in table)
    by = {(r["job_id"], r["fold"]): r["metrics"] for r in table}
    pandas = rows.toPandas().sort_values("ts")
    x, y = np.stack(pandas["x"]), np.stack(pandas["labels"]).astype(float)[:, 0]
    for fold in (1, 2, 3):
        train, valid = pandas["ts"] <= 99 + 50 * fold, pandas["ts"].between(110 + 50 * fold, 140 + 50 * fold)
        mean, spread = x[train].mean(0), x[train].std(0)
        live = spread > 0
        a = (x[:, live] - mean[live]) / spread[live]
        gram = a[train].T @ a[train] / train.sum() + np.eye(live.sum()) / y[train].std()
        w = np.linalg.solve(gram, a[train].T @ (y[train] - y[train].mean()) / train.sum())
        error = a[valid] @ w + y[train].mean() - y[valid]
        assert by["y_h1", fold]["rmse"] == pytest.approx(np.sqrt((error**2).mean()), abs=1e-8)
        assert by["y_h1", fold]["mae"] == pytest.approx(np.abs(error).mean(), abs=1e-8)
    assert min(by["flag_h1", f]["accuracy"] for f in (1, 2, 3)) > 0.9 and min(by["kind_h1", f]["macro_f1"] for f in (1, 2, 3)) > 0.5
    one_class = rows.withColumn("labels", F.array(F.lit(1.0)))
    failed = foldstats.fold_table(one_class, (JOBS[3],), (foldstats.Linear("a", "svm", 1.0),), (1,), 4, "x").first()
    assert failed["status"] == "failed" and "two classes" in failed["error"] and failed["metrics"] == {}


def test_folds_must_be_nested():
    crossed = [{**FOLDS[0], "train_end": 400}, FOLDS[1]]
    with pytest.raises(ValueError, match="nested"):
        foldstats.fold_places(F.col("ts"), crossed)


def newton(s, t):
    a = b = 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-(a * s + b)))
        g, h = np.array([((p - t) * s).sum(), (p - t).sum()]), p * (1 - p)
        step = np.linalg.solve([[(h * s * s).sum() + 1e-10, (h * s).sum()], [(h * s).sum(), h.sum() + 1e-10]], g)
        a, b = a - step[0], b - step[1]
    return a, b


@pytest.mark.parametrize("classes", [2, 4])
def test_curves_of_all_classes(spark, classes):
    rng = np.random.default_rng(classes)
    score = rng.random((500, classes))
    label = np.where(rng.random(500) < 0.6, score.argmax(1), rng.integers(0, classes, 500))
    df = spark.createDataFrame([(s.tolist(), int(y)) for s, y in zip(score, label, strict=True)], "s array<double>, y int")
    fit = models.fit_sigmoid(df, "s", "y", classes)
    for i, curve in zip([1] if classes == 2 else range(classes), fit.curves, strict=True):
        hits = (label == i).sum()
        t = np.where(label == i, (hits + 1) / (hits + 2), 1 / (500 - hits + 2))
        assert curve == pytest.approx(newton(score[:, i], t), abs=1e-6)
    made = np.array([r["probabilities"] for r in fit.transform(df, "s").orderBy(F.col("s")[classes - 1]).collect()])
    assert made.sum(axis=1) == pytest.approx(np.ones(500))
    if classes == 2:
        assert (np.diff(made[:, 1]) >= 0).all()  # order kept


def test_separated_scores_have_finite_curves(spark):
    df = spark.createDataFrame([([1 - p, p], int(p > 0.5)) for p in np.linspace(0, 1, 50).tolist()], "s array<double>, y int")
    (curve,) = models.fit_sigmoid(df, "s", "y", 2).curves
    assert np.isfinite(curve).all() and 0 < curve[0] < 1000


def test_folds_read_their_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([([float(i % 7)], [float(i % 7), None if i % 5 else 1.0], 1 + i // 50, i // 50) for i in range(150)], "x array<double>, labels array<double>, trains_from int, validates int")
    rows = rows.mapInArrow(counted, rows.schema).withColumn("features", array_to_vector("x"))
    spec = models.Candidate("t", "decision_tree", {"maxDepth": 3})
    out = models.job_folds(rows, [("y", 0), ("z", 1)], [spec], (1, 2), lambda s, _: models.build_regressor(s), lambda m, r, _: models.regression_score(m, r))
    assert {(r["job_id"], r["fold"], r["status"], r["metrics"]["rmse"]) for r in out.collect()} == {(j, f, "ok", 0.0) for j in "yz" for f in (1, 2)}
    assert read.value <= 150


def test_weights_need_no_join(spark):
    rows = spark.createDataFrame([(0.0,), (0.0,), (0.0,), (2.0,), (None,)], "label double")
    out = models.weighted(rows)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["label"], r["weight"]) for r in out.collect()) == [(0.0, 0.6666666667)] * 3 + [(2.0, 2.0)]


def _levels(spark, labels, classes=4):
    data = [([float(y == 1) + i % 5 / 10, float(i % 7)], float(y), 1.0) for i, y in enumerate(labels)]
    return spark.createDataFrame(data, "x array<double>, label double, weight double").withColumn("features", array_to_vector("x"))


@pytest.mark.parametrize("labels", [[0] * 40, [1] * 40, [0, 1] * 20, [0, 2] * 20, [1, 3] * 20])
@pytest.mark.parametrize("family", ["decision_tree", "svm"])
def test_scores_of_classes_without_training_rows(spark, labels, family):
    train = _levels(spark, labels)
    spec = models.Candidate("c", family, {"maxDepth": 3} if family == "decision_tree" else {"maxIter": 10, "regParam": 0.01})
    out = models.build_classifier(spec, 4).fit(train).transform(train)
    rows = models.class_scores(out, 4).select("label", "prediction", "probabilities").collect()
    absent = [c for c in range(4) if c not in labels]
    assert len(rows) == 40 and {r["prediction"] for r in rows} <= set(map(float, labels))
    for r in rows:
        assert len(r["probabilities"]) == 4 and sum(r["probabilities"]) == pytest.approx(1.0)
        assert all(r["probabilities"][c] == 0 for c in absent)
    if len(set(labels)) == 1 or 1 in labels:
        assert all(r["prediction"] == r["label"] for r in rows)
    shown = models.classification_rows(models.class_scores(out, 4).withColumns({c: F.lit(1) for c in ("entity", "ts", "target_ts", "split")}), "j", list("abcd"), 1, "v")
    assert shown.filter("probability_d IS NULL").count() == 0


def test_margins_of_one_class_out_of_two(spark):
    train = _levels(spark, [1] * 20)
    out = models.build_classifier(models.Candidate("c", "svm", {"maxIter": 5}), 2).fit(train).transform(train)
    assert {tuple(r["probabilities"]) for r in models.class_scores(out, 2).collect()} == {(0.0, 1.0)}


def test_saved_models_route_rows(spark, tmp_path):
    train = spark.createDataFrame([([float(i), float(i % 3)], float(2 * i + i % 3)) for i in range(60)], "x array<double>, label double").withColumn("features", array_to_vector("x"))
    chosen = []
    for target, scale in (("load", 1.0), ("speed", -3.0)):
        for h in (1, 2):
            rows = train.withColumn("label", F.col("label") * scale + h)
            estimator = mlr.LinearRegression() if h == 1 else mlr.DecisionTreeRegressor(maxDepth=5)
            chosen.append({"target": target, "horizon": h, "family": "linear_regression" if h == 1 else "decision_tree", "candidate_id": "c", "features": "features", "model": estimator.fit(rows)})
    entries = serving.save_models(spark, chosen, str(tmp_path), "v1")
    asked = train.select("features").crossJoin(spark.createDataFrame([(t, h) for t in ("load", "speed", "other") for h in (1, 2)], "target string, horizon int"))
    scored = serving.predict_routed(asked, entries)
    assert scored.columns == ["features", "target", "horizon", "prediction", "model_version", "routed"]
    rows = scored.collect()
    for c in chosen:
        want = sorted(r["prediction"] for r in c["model"].transform(train).select("prediction").collect())
        got = sorted(r["prediction"] for r in rows if (r["target"], r["horizon"]) == (c["target"], c["horizon"]))
        assert got == pytest.approx(want)
    assert {r["model_version"] for r in rows if r["target"] == "load" and r["horizon"] == 1} == {"v1/load_h1/c"}
    assert all(not r["routed"] and r["prediction"] is None for r in rows if r["target"] == "other")
    # A key with two entries serves nobody.
    doubled = serving.predict_routed(asked, entries.unionByName(entries.filter("target = 'load' AND horizon = 2")))
    assert doubled.filter("target = 'load' AND horizon = 2 AND routed").count() == 0
    with pytest.raises(ValueError, match="More than one model"):
        serving.save_models(spark, [chosen[0], chosen[0]], str(tmp_path), "v2")


def test_counters_come_from_the_jobs(spark):
    run, spark = StageCounters(), session_of_its_own(spark)
    first = run.run("first", run.watch("input", spark.range(100), rows=F.count(F.lit(1))).filter("id % 3 = 0"), rows=F.count(F.lit(1)), biggest=F.max("id"))
    assert first.count() == 34
    assert {(r["stage"], r["counter"]): r["value"] for r in run.table(spark).collect()} == {("input", "rows"): 100, ("first", "rows"): 34, ("first", "biggest"): 99}
