"""All folds and regularisations of the linear families from one pass over the rows.

Training ranges of the folds are nested and validation ranges are disjoint, so a row is placed by the
first fold it trains in and by the fold it validates.  Per place, job and class the pass keeps one
matrix of sums of products; a fold's training matrix is the sum over the places before it.  Ridge
regression and the class-weighted least-squares margin classifier then need small solves only.  A
second pass scores every fit on its own fold at once.

Labels of all jobs stand side by side in one array column, null where a row is not eligible.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

Sums = dict[tuple[int, int, int, int], np.ndarray]


@dataclass(frozen=True)
class Job:
    """One target at one horizon; ``classes`` is 0 for a number."""

    target: str
    horizon: int
    classes: int = 0

    @property
    def job_id(self) -> str:
        return f"{self.target}_h{self.horizon}"


@dataclass(frozen=True)
class Linear:
    """A linear candidate: ``strength`` is the ridge weight, for classifiers the weight of the margin errors."""

    candidate_id: str
    family: str
    strength: float = 0.0


@dataclass(frozen=True)
class Fit:
    """One row of coefficients and an intercept for a number or a two-class job, one per class beyond."""

    coefficients: np.ndarray
    intercepts: np.ndarray
    notes: dict = field(default_factory=dict)


def fold_places(ts: Column, folds: Sequence[Row]) -> dict[str, Column]:
    """``trains_from``: first fold the row trains in; ``validates``: the fold it validates; 0 for none."""
    ordered = sorted(folds, key=lambda f: f["fold"])
    if any(a["train_end"] > b["train_end"] or a["train_start"] != b["train_start"] for a, b in zip(ordered, ordered[1:], strict=False)):
        raise ValueError("Training ranges must be nested")
    if any(a["validation_end"] >= b["validation_start"] for a, b in zip(ordered, ordered[1:], strict=False)):
        raise ValueError("Validation ranges must be disjoint and in order")
    trains = validates = None
    for f in ordered:
        here, there = ts.between(f["train_start"], f["train_end"]), ts.between(f["validation_start"], f["validation_end"])
        trains = (F if trains is None else trains).when(here, f["fold"])
        validates = (F if validates is None else validates).when(there, f["fold"])
    none = F.lit(0)
    return {
        "trains_from": (none if trains is None else trains.otherwise(0)).cast("int"),
        "validates": (none if validates is None else validates.otherwise(0)).cast("int"),
    }


def _added(parts: DataFrame, keys: Sequence[str], width: int) -> dict[tuple, np.ndarray]:
    """Element-wise sums of the ``sums`` arrays per key; only keys x width numbers reach the driver."""
    long = parts.select(*keys, F.posexplode("sums").alias("place", "value"))
    out: dict[tuple, np.ndarray] = defaultdict(lambda: np.zeros(width))
    for row in long.groupBy(*keys, "place").agg(F.sum("value").alias("value")).collect():
        out[tuple(row[k] for k in keys)][row["place"]] = row["value"]
    return dict(out)


def product_sums(rows: DataFrame, jobs: Sequence[Job], features: int, column: str = "features", labels: str = "labels") -> Sums:
    """(job, class, trains_from, validates) -> sums of products of (features, 1, label), in one pass."""
    kinds, width = [j.classes for j in jobs], features + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            n = batch.num_rows
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, features)
            y = batch.column("y").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, len(kinds))
            place = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("trains_from", "validates")], axis=1)
            for at in np.unique(place, axis=0):
                here = (place == at).all(axis=1)
                for j, classes in enumerate(kinds):
                    for c in range(max(classes, 1)):
                        mine = here & (y[:, j] == c if classes else ~np.isnan(y[:, j]))
                        if mine.any():
                            a = np.column_stack([x[mine], np.ones(mine.sum()), y[mine, j]])
                            key = (j, c, int(at[0]), int(at[1]))
                            held[key] = held.get(key, 0) + a.T @ a
        if held:
            columns = [pa.array(c, pa.int32()) for c in zip(*held, strict=True)]
            sums = pa.array([g.ravel() for g in held.values()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*columns, sums], names=["job", "class", "trains_from", "validates", "sums"])

    slim = rows.select(F.col(column).alias("x"), F.col(labels).alias("y"), "trains_from", "validates")
    keys = ["job", "class", "trains_from", "validates"]
    parts = slim.mapInArrow(run, ", ".join(f"{k} int" for k in keys) + ", sums array<double>")
    return {k: v.reshape(width, width) for k, v in _added(parts, keys, width * width).items()}


def training_sums(sums: Sums, job: int, fold: int | None) -> dict[int, np.ndarray]:
    """Matrix per class of the rows that train in ``fold``; of all rows without a fold."""
    out: dict[int, np.ndarray] = {}
    for (j, c, first, _), gram in sums.items():
        if j == job and (fold is None or 0 < first <= fold):
            out[c] = out.get(c, 0) + gram
    return out


def _solve(gram: np.ndarray, cross: np.ndarray, mean: np.ndarray, target_mean: float, ridge: float) -> tuple[np.ndarray, float]:
    """Ridge on standardised features; a constant feature has coefficient 0."""
    spread = np.sqrt(np.clip(np.diag(gram), 0, None))
    live = spread > 1e-9 * np.maximum(1.0, np.abs(mean))
    out = np.zeros(len(mean))
    if live.any():
        scale = spread[live]
        left = gram[np.ix_(live, live)] / np.outer(scale, scale) + ridge * np.eye(live.sum())
        out[live] = np.linalg.lstsq(left, cross[live] / scale, rcond=1e-12)[0] / scale
    return out, float(target_mean - out @ mean)


def ridge_fit(train: np.ndarray, strength: float) -> Fit:
    """Least squares with ``strength`` as MLlib counts it: on standardised features and label."""
    d, n = len(train) - 2, train[-2, -2]
    if n < 2:
        raise ValueError("Fewer than two training rows")
    mean, target = train[:d, d] / n, train[d, d + 1] / n
    gram = train[:d, :d] / n - np.outer(mean, mean)
    cross = train[:d, d + 1] / n - mean * target
    spread = np.sqrt(max(train[d + 1, d + 1] / n - target * target, 0.0))
    w, b = _solve(gram, cross, mean, target, strength / spread if strength and spread > 0 else 0.0)
    return Fit(w[None, :], np.array([b]))


def margin_fit(train: dict[int, np.ndarray], classes: int, strength: float) -> Fit:
    """Balanced least-squares margins of each class against the rest (of class 1 for two classes)."""
    sizes = {c: g[-2, -2] for c, g in train.items()}
    if len(sizes) < 2:
        raise ValueError("Fewer than two classes in the training rows")
    total = sum(sizes.values())
    weight = {c: total / (len(sizes) * n) for c, n in sizes.items()}
    d = len(next(iter(train.values()))) - 2
    w_all, b_all = [], []
    for positive in [1] if classes == 2 else range(classes):
        gram = sum(weight[c] * g for c, g in train.items())
        signed = sum((1 if c == positive else -1) * weight[c] * g for c, g in train.items())
        n = gram[d, d]
        mean, target = gram[:d, d] / n, signed[d, d] / n
        w, b = _solve(gram[:d, :d] / n - np.outer(mean, mean), signed[:d, d] / n - mean * target, mean, target, 1 / (strength * n))
        w_all.append(w)
        b_all.append(b)
    return Fit(np.array(w_all), np.array(b_all))


def fit_folds(sums: Sums, jobs: Sequence[Job], candidates: Sequence[Linear], folds: Sequence[int]) -> tuple[dict, list[dict]]:
    """(job, candidate, fold) -> Fit, and a record of every fit that was refused."""
    fits, refused = {}, []
    for j, job in enumerate(jobs):
        for i, candidate in enumerate(candidates):
            for fold in folds:
                train = training_sums(sums, j, fold)
                try:
                    if not train:
                        raise ValueError("No training rows")
                    fits[j, i, fold] = margin_fit(train, job.classes, candidate.strength) if job.classes else ridge_fit(train[0], candidate.strength)
                except (ValueError, np.linalg.LinAlgError) as error:
                    refused.append({"job": j, "candidate": i, "fold": fold, "error": f"{type(error).__name__}: {error}"})
    return fits, refused


#: Sums kept for a fit of numbers; a classifier keeps its confusion counts.
_NUMBERS = ("n", "squared", "absolute", "relative", "nonzero", "y", "yy")


def score_folds(
    rows: DataFrame, jobs: Sequence[Job], candidates: Sequence[Linear], fits: dict, features: int, column: str = "features", labels: str = "labels"
) -> dict[tuple[int, int, int], np.ndarray]:
    """(job, candidate, fold) -> sums over the fold's validation rows, in one pass for all fits."""
    kinds, total = [j.classes for j in jobs], len(candidates)
    plain = {k: (f.coefficients, f.intercepts) for k, f in fits.items()}
    width = max([len(_NUMBERS), *[c * c for c in kinds]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            n = batch.num_rows
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, features)
            y = batch.column("y").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, len(kinds))
            fold = batch.column("validates").to_numpy(zero_copy_only=False)
            for f in np.unique(fold):
                for j, classes in enumerate(kinds):
                    mine = (fold == f) & ~np.isnan(y[:, j])
                    for i in range(total):
                        fit = plain.get((j, i, int(f)))
                        if fit is None or not mine.any():
                            continue
                        out, actual = x[mine] @ fit[0].T + fit[1], y[mine, j]
                        sums = np.zeros(width)
                        if classes:
                            predicted = (out[:, 0] >= 0).astype(int) if classes == 2 else out.argmax(axis=1)
                            cells = actual.astype(int) * classes + predicted
                            sums[: classes * classes] = np.bincount(cells, minlength=classes * classes)
                        else:
                            error, some = out[:, 0] - actual, np.abs(actual) > 2.220446049250313e-16
                            relative = np.abs(error[some]) / np.abs(actual[some])
                            sums[: len(_NUMBERS)] = (len(error), error @ error, np.abs(error).sum(), relative.sum(), some.sum(), actual.sum(), actual @ actual)
                        key = (j, i, int(f))
                        held[key] = held.get(key, 0) + sums
        if held:
            columns = [pa.array(c, pa.int32()) for c in zip(*held, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(held.values()), pa.list_(pa.float64()))], names=["job", "candidate", "fold", "sums"])

    slim = rows.filter("validates > 0").select(F.col(column).alias("x"), F.col(labels).alias("y"), "validates")
    keys = ["job", "candidate", "fold"]
    return _added(slim.mapInArrow(run, "job int, candidate int, fold int, sums array<double>"), keys, width)


def measures(sums: np.ndarray, classes: int) -> dict[str, float]:
    """Metrics of one fit from its sums; an empty denominator counts as 0."""
    if classes:
        cells = sums[: classes * classes].reshape(classes, classes)
        hits, actual, predicted = np.diag(cells), cells.sum(axis=1), cells.sum(axis=0)
        f1 = np.divide(2 * hits, actual + predicted, out=np.zeros(classes), where=actual + predicted > 0)
        return {"accuracy": round(float(hits.sum() / cells.sum()), 10), "macro_f1": round(float(f1.mean()), 10)}
    n, squared, absolute, relative, nonzero, y, yy = (float(v) for v in sums[: len(_NUMBERS)])
    spread = yy - y * y / n
    out = {"rmse": round((squared / n) ** 0.5, 10), "mae": round(absolute / n, 10), "r_squared": round(1 - squared / spread, 10) if spread > 0 else 0.0}
    return {**out, "mape_percent": round(100 * relative / nonzero, 8)} if nonzero else out


def fold_table(
    rows: DataFrame, jobs: Sequence[Job], candidates: Sequence[Linear], folds: Sequence[int], features: int, column: str = "features", labels: str = "labels"
) -> DataFrame:
    """One row per job, candidate and fold: two passes over ``rows`` for all of them.

    ``job_id, candidate_id, family, fold, status, error, metrics``; a refused fit is a failed row.
    """
    fits, refused = fit_folds(product_sums(rows, jobs, features, column, labels), jobs, candidates, folds)
    sums = score_folds(rows, jobs, candidates, fits, features, column, labels)
    wrong = {(r["job"], r["candidate"], r["fold"]): r["error"] for r in refused}
    records = []
    for j, job in enumerate(jobs):
        for i, candidate in enumerate(candidates):
            for fold in folds:
                key = (j, i, fold)
                found = sums.get(key)
                error = wrong.get(key) or (None if found is not None else "ValueError: No validation rows")
                records.append((job.job_id, candidate.candidate_id, candidate.family, fold, "failed" if error else "ok", error, {} if error else measures(found, job.classes)))
    schema = "job_id string, candidate_id string, family string, fold int, status string, error string, metrics map<string,double>"
    return rows.sparkSession.createDataFrame(records, schema)
