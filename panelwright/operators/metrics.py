"""Exact regression and classification metrics as grouped aggregates.

Every metric is a sum over rows (or over distinct scores), so groups of any size reduce map-side
first; no group is sorted or collected as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order_stats import prefix_sums, ranked_values
from ..functions.scalars import array_sum, ratio, rounded

EPS = 2.220446049250313e-16


def regression_aggregates(actual: str = "actual", prediction: str = "prediction") -> dict[str, Column]:
    """Named aggregate expressions of one group."""
    y, e = F.col(actual), F.col(prediction) - F.col(actual)
    nonzero = F.abs(y) > EPS
    n = F.count(F.lit(1))
    total = F.var_pop(y) * n
    return {
        "rows": n,
        "rmse": rounded(F.sqrt(F.avg(e * e)), 10),
        "mae": rounded(F.avg(F.abs(e)), 10),
        "mape_percent": rounded(F.avg(F.when(nonzero, F.abs(e) / F.abs(F.nullif(y, F.lit(0.0))))) * 100, 8),
        "r_squared": rounded(F.when(F.min(y) == F.max(y), F.lit(0.0)).otherwise(1 - F.try_divide(F.sum(e * e), total)), 10),
        "mape_nonzero_rows": F.count_if(nonzero),
        "mape_zero_actual_rows": F.count_if(~nonzero),
    }


def regression_metrics(df: DataFrame, keys: Sequence[str], actual: str = "actual", prediction: str = "prediction") -> DataFrame:
    """RMSE, MAE, MAPE over non-zero actuals, R squared, with denominators, per group."""
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in regression_aggregates(actual, prediction).items()])


def mean_horizon_rmse(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of the horizon RMSEs per group."""
    return metrics.groupBy(*keys).agg(F.count(F.lit(1)).alias("horizons"), F.avg("rmse").alias("mean_rmse"))


# -- multiclass ------------------------------------------------------------------------------------


def _class_sums(k: int, actual: str, predicted: str) -> list[Column]:
    a, p = F.col(actual), F.col(predicted)
    out = []
    for i in range(k):
        out += [
            F.count_if((a == i) & (p == i)).alias(f"_tp{i}"),
            F.count_if(a == i).alias(f"_sup{i}"),
            F.count_if(p == i).alias(f"_pred{i}"),
        ]
    return out


def _prf(i: int) -> tuple[Column, Column, Column]:
    tp, sup, pred = F.col(f"_tp{i}"), F.col(f"_sup{i}"), F.col(f"_pred{i}")
    zero = F.lit(0.0)
    return (
        F.coalesce(ratio(tp, pred), zero), F.coalesce(ratio(tp, sup), zero), F.coalesce(ratio(2 * tp, sup + pred), zero)
    )


def _mean(columns: Sequence[Column]) -> Column:
    return sum(columns[1:], columns[0]) / len(columns)


def multiclass_metrics(
    df: DataFrame, keys: Sequence[str], classes: int, extra: Sequence[Column] = (),
    actual: str = "actual_class_index", predicted: str = "predicted_class_index",
) -> DataFrame:
    """Accuracy and macro precision, recall and F1; an empty denominator counts as 0."""
    sums = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *_class_sums(classes, actual, predicted), *extra)
    parts = [_prf(i) for i in range(classes)]
    hits = sum((F.col(f"_tp{i}") for i in range(1, classes)), F.col("_tp0"))
    out = sums.withColumns(
        {
            "accuracy": rounded(ratio(hits, F.col("rows")), 10),
            "macro_precision": rounded(_mean([x[0] for x in parts]), 10),
            "macro_recall": rounded(_mean([x[1] for x in parts]), 10),
            "macro_f1": rounded(_mean([x[2] for x in parts]), 10),
        }
    )
    return out.drop(*[c for c in out.columns if c.startswith(("_tp", "_sup", "_pred"))])


def per_class_metrics(
    df: DataFrame, keys: Sequence[str], labels: Sequence[str],
    actual: str = "actual_class_index", predicted: str = "predicted_class_index",
) -> DataFrame:
    sums = df.groupBy(*keys).agg(*_class_sums(len(labels), actual, predicted))
    records = []
    for i, label in enumerate(labels):
        precision, recall, f1 = _prf(i)
        records.append(
            F.struct(
                F.lit(i).alias("class_index"), F.lit(label).alias("class"), rounded(precision, 10).alias("precision"),
                rounded(recall, 10).alias("recall"), rounded(f1, 10).alias("f1"), F.col(f"_sup{i}").alias("support"),
            )
        )
    return sums.select(*keys, F.explode(F.array(*records)).alias("r")).select(*keys, "r.*")


def confusion_long(
    df: DataFrame, keys: Sequence[str], labels: Sequence[str], minimum_rows: int = 0,
    actual: str = "actual_class_index", predicted: str = "predicted_class_index",
) -> DataFrame:
    """Ordered confusion cells, zero cells included, of groups with enough rows."""
    a, p, k = F.col(actual), F.col(predicted), range(len(labels))
    cells = [F.count_if((a == i) & (p == j)).alias(f"_c{i}_{j}") for i in k for j in k]
    wide = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *cells).filter(F.col("_n") >= minimum_rows)
    records = [
        F.struct(
            F.lit(labels[i]).alias("actual_label"), F.lit(labels[j]).alias("predicted_label"), F.col(f"_c{i}_{j}").alias("rows")
        )
        for i in k
        for j in k
    ]
    return wide.select(*keys, F.explode(F.array(*records)).alias("r")).select(*keys, "r.*")


# -- binary ----------------------------------------------------------------------------------------


def ranking_metrics(df: DataFrame, keys: Sequence[str], score: str, actual: str) -> DataFrame:
    """ROC-AUC (ties count half) and step-wise average precision from distinct scores."""
    y = F.col(actual).cast("long")
    table = prefix_sums(df, keys, score, {"pos": y, "neg": 1 - y})
    pos, neg = F.col("pos"), F.col("neg")
    above = F.col("total_pos") - F.col("before_pos")
    flagged = above + F.col("total_neg") - F.col("before_neg")
    sums = table.groupBy(*keys).agg(
        F.max("total_pos").alias("positive_rows"), F.max("total_neg").alias("negative_rows"),
        F.sum(pos * (F.col("before_neg") + neg / 2.0)).alias("_auc"), F.sum(pos * ratio(above, flagged)).alias("_ap"),
    )
    p, n = F.col("positive_rows"), F.col("negative_rows")
    return sums.select(
        *keys, (p + n).alias("rows"), "positive_rows", "negative_rows", rounded(ratio(p, p + n), 10).alias("positive_rate"),
        rounded(ratio(F.col("_auc"), p * n), 10).alias("roc_auc"),
        rounded(F.when(n > 0, ratio(F.col("_ap"), p)), 10).alias("pr_auc"),
    )


def operating_metrics(df: DataFrame, keys: Sequence[str], score: str, actual: str, threshold: Column) -> DataFrame:
    """Accuracy, precision, recall, F1 and the 2x2 table at a threshold (score >= threshold)."""
    yes, hit = F.col(actual) == 1, F.col(score) >= threshold
    sums = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(yes & hit).alias("true_positive"), F.count_if(~yes & hit).alias("false_positive"),
        F.count_if(yes & ~hit).alias("false_negative"), F.count_if(~yes & ~hit).alias("true_negative"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("true_positive", "false_positive", "false_negative", "true_negative"))
    zero = F.lit(0.0)
    return sums.withColumns(
        {
            "predicted_positive_rows": tp + fp,
            "accuracy": rounded(ratio(tp + tn, F.col("rows")), 10),
            "precision": rounded(F.coalesce(ratio(tp, tp + fp), zero), 10),
            "recall": rounded(F.coalesce(ratio(tp, tp + fn), zero), 10),
            "f1": rounded(F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), zero), 10),
        }
    )


def threshold_table(df: DataFrame, keys: Sequence[str], score: str, actual: str, candidates: int, default: float) -> DataFrame:
    """Precision, recall and F1 at every candidate: evenly spaced score quantiles and a default.

    Candidates are rounded to 12 places, so that interpolation noise cannot put one a hair above the
    score it stands for.  Candidate quantiles come from exact ranks; counts at a candidate come from per-candidate
    conditional sums, reached by counting each score into the highest candidate it meets.
    """
    steps = candidates - 1

    def low(n: Column, i: Column) -> Column:
        return F.floor((n - 1).cast("double") * (i / steps)).cast("long") + 1

    def wanted(n: Column) -> Column:
        spots = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.array(low(n, i), F.least(low(n, i) + 1, n)))
        return F.array_sort(F.array_distinct(F.flatten(spots)))

    at = ranked_values(df, keys, score, wanted)
    # One entry per wanted rank, at most two per candidate.
    values = at.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at"), F.max("n").alias("_n"))

    def quantile(i: Column) -> Column:
        n = F.col("_n")
        place = (n - 1).cast("double") * (i / steps)
        a, b = F.element_at("_at", low(n, i)), F.element_at("_at", F.least(low(n, i) + 1, n))
        return a + (b - a) * (place - F.floor(place))

    cuts = F.array_sort(
        F.array_distinct(
            F.concat(
                F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.round(quantile(i), 12)),
                F.array(F.lit(float(default))),
            )
        )
    )
    tables = values.select(*keys, cuts.alias("_cuts"))
    counts = prefix_sums(df, keys, score, {"pos": F.col(actual).cast("long"), "neg": 1 - F.col(actual).cast("long")})
    joined = counts.join(tables, list(keys)) if keys else counts.withColumn("_cuts", tables.select("_cuts").scalar())
    # Each score belongs to the last candidate at or below it; candidates then accumulate downwards.
    place = F.size(F.filter("_cuts", lambda c: c <= F.col(score)))
    cells = joined.groupBy(*keys, "_cuts", place.alias("_place")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    wide = cells.groupBy(*keys, "_cuts").agg(
        F.collect_list(F.struct("_place", "pos", "neg")).alias("_cells"), F.sum("pos").alias("_p"), F.sum("neg").alias("_q")
    )

    def upto(kind: str) -> Column:
        return F.aggregate(
            F.filter("_cells", lambda c: c["_place"] >= F.col("_i") + 1), F.lit(0).cast("long"), lambda s, c: s + c[kind]
        )

    rows = wide.select(*keys, "_cells", "_p", F.posexplode("_cuts").alias("_i", "_t"))
    rows = rows.withColumns({"_tp": upto("pos"), "_fp": upto("neg")})
    tp, fp, p = F.col("_tp"), F.col("_fp"), F.col("_p")
    zero = F.lit(0.0)
    return rows.select(
        *keys, rounded(F.col("_t"), 10).alias("threshold"), rounded(F.coalesce(ratio(tp, tp + fp), zero), 10).alias("precision"),
        rounded(F.coalesce(ratio(tp, p), zero), 10).alias("recall"),
        rounded(F.coalesce(ratio(2 * tp, tp + fp + p), zero), 10).alias("f1"), (tp + fp).alias("predicted_positive_rows"),
    )


def best_threshold(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best F1, then recall, then precision, then the lower threshold."""
    order = F.struct("f1", "recall", "precision", (-F.col("threshold")).alias("t"))
    fields = F.struct("threshold", "precision", "recall", "f1", "predicted_positive_rows")
    return table.groupBy(*keys).agg(F.max_by(fields, order).alias("b")).select(*keys, "b.*")


# -- probabilities ---------------------------------------------------------------------------------


def probability_violations(df: DataFrame, keys: Sequence[str], probabilities: str = "probabilities") -> DataFrame:
    """Rows with non-finite or out-of-range entries, or not summing to one within 1e-6."""
    p = F.col(probabilities)
    finite = F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    inside = F.forall(p, lambda x: (x >= -1e-12) & (x <= 1 + 1e-12))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~finite).alias("non_finite"), F.count_if(~inside).alias("out_of_range"),
        F.count_if(F.abs(array_sum(p) - 1) > 1e-6).alias("bad_sum"),
    )


def normalized(probabilities: Column) -> Column:
    """Clipped to [0, 1] and divided by the row sum."""
    clipped = F.transform(probabilities, lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))
    return F.transform(clipped, lambda x: x / array_sum(clipped))


def brier_of(probabilities: Column, actual: Column) -> Column:
    squares = F.transform(
        probabilities, lambda x, i: (x - F.when(i == actual, 1.0).otherwise(0.0)) * (x - F.when(i == actual, 1.0).otherwise(0.0))
    )
    return array_sum(squares)


def log_loss_of(probabilities: Column, actual: Column) -> Column:
    chosen = F.element_at(probabilities, actual.cast("int") + 1)
    return -F.ln(F.least(F.greatest(chosen, F.lit(EPS)), F.lit(1.0 - EPS)))


def probability_quality(df: DataFrame, keys: Sequence[str], probabilities: str = "probabilities", actual: str = "actual_class_index") -> DataFrame:
    """Multiclass Brier score and log loss."""
    p, y = F.col(probabilities), F.col(actual)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), rounded(F.avg(brier_of(p, y)), 10).alias("brier_score"),
        rounded(F.avg(log_loss_of(p, y)), 10).alias("log_loss"),
    )


def calibration_decision(raw: DataFrame, calibrated: DataFrame, keys: Sequence[str], minimum: float) -> DataFrame:
    """Raw against calibrated quality on the assessment rows and whether calibration is applied."""
    a = raw.select(*keys, F.col("brier_score").alias("raw_brier"), F.col("log_loss").alias("raw_log_loss"))
    b = calibrated.select(*keys, F.col("brier_score").alias("calibrated_brier"), F.col("log_loss").alias("calibrated_log_loss"))
    gain = F.col("raw_brier") - F.col("calibrated_brier")
    applied = F.col("raw_brier").isNull() | (gain >= minimum)
    reason = (
        F.when(F.col("raw_brier").isNull(), "required_for_probability_output")
        .when(applied, "validation_brier_improved")
        .otherwise("validation_brier_improvement_below_minimum")
    )
    return b.join(a, list(keys), "left").select(
        *keys, "raw_brier", "raw_log_loss", "calibrated_brier", "calibrated_log_loss",
        rounded(gain, 9).alias("brier_improvement"), applied.alias("applied"), reason.alias("reason"),
    )


