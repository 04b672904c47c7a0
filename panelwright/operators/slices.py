"""Metrics per slice of several dimensions at once, with minimum support."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order_stats import quantiles
from ..functions.scalars import rounded
from . import metrics

SLICE = ("dimension", "slice_value")


def explode_slices(df: DataFrame, dimensions: Sequence[str], overall: bool = True, keep_null: bool = False) -> DataFrame:
    """One copy of a row per dimension it has a value in, plus ``overall``.

    All dimensions then share one shuffle of map-side combined sums.
    """
    entries = [F.struct(F.lit("overall").alias("dimension"), F.lit("all").alias("slice_value"))] if overall else []
    for name in dimensions:
        value = F.col(name).cast("string")
        entry = F.struct(F.lit(name).alias("dimension"), (F.coalesce(value, F.lit("null")) if keep_null else value).alias("slice_value"))
        entries.append(entry if keep_null else F.when(value.isNotNull(), entry))
    return df.withColumn("_slice", F.explode(F.array_compact(F.array(*entries)))).select(*df.columns, "_slice.*")


def supported(columns: Sequence[str], enough: Column) -> dict[str, Column]:
    """Metrics kept only on sufficient support; the row itself stays."""
    return {"sufficient_support": enough, **{c: F.when(enough, F.col(c)) for c in columns}}


def regression_coverage(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Accuracy, bias, residual deviation, empirical coverage and mean width per group."""
    return df.groupBy(*keys).agg(
        *[c.alias(n) for n, c in metrics.regression_aggregates().items()], *[c.alias(n) for n, c in _interval_aggregates().items()],
        F.max("confidence_level").alias("confidence_level"),
    )


def _interval_aggregates() -> dict[str, Column]:
    return {
        "bias": F.avg("signed_error"),
        "residual_standard_deviation": F.stddev_pop("signed_error"),
        "interval_coverage": rounded(F.avg(F.col("interval_covered").cast("int")), 10),
        "mean_interval_width": F.avg("interval_width"),
    }


def regression_slices(df: DataFrame, keys: Sequence[str], dimensions: Sequence[str], minimum_rows: int) -> DataFrame:
    """Accuracy, bias, residual quantiles and coverage per slice."""
    sliced = explode_slices(df, dimensions)
    by = [*keys, *SLICE]
    wanted = {k: v for k, v in metrics.regression_aggregates().items() if not k.startswith("mape_n") and not k.startswith("mape_z")}
    sums = sliced.groupBy(*by).agg(
        *[c.alias(n) for n, c in wanted.items()], *[c.alias(n) for n, c in _interval_aggregates().items()]
    )
    cuts = quantiles(sliced, by, "signed_error", {"residual_q10": 0.10, "residual_median": 0.50, "residual_q90": 0.90})
    cuts = cuts.select(*by, "residual_q10", "residual_median", "residual_q90")
    joined = sums.join(cuts, by, "left")
    values = [c for c in joined.columns if c not in (*by, "rows")]
    return joined.withColumns(supported(values, F.col("rows") >= minimum_rows))


def class_slices(df: DataFrame, keys: Sequence[str], dimensions: Sequence[str], classes: int, minimum_rows: int) -> DataFrame:
    """Accuracy, macro scores, mean confidence and entropy per slice."""
    sliced = explode_slices(df, dimensions)
    extra = [
        F.avg("max_probability").alias("mean_confidence"),
        F.avg("normalized_entropy").alias("mean_normalized_entropy"),
    ]
    out = metrics.multiclass_metrics(sliced, [*keys, *SLICE], classes, extra)
    values = [c for c in out.columns if c not in (*keys, *SLICE, "rows")]
    return out.withColumns(supported(values, F.col("rows") >= minimum_rows))


def event_slices(df: DataFrame, keys: Sequence[str], dimensions: Sequence[str], minimum_rows: int, minimum_positives: int) -> DataFrame:
    """Operating point, ROC-AUC, PR-AUC and prevalence per slice; both classes are needed."""
    by = [*keys, *SLICE]
    sliced = explode_slices(df, dimensions)
    ranking = metrics.ranking_metrics(sliced, by, "event_probability", "actual_class_index")
    point = metrics.operating_metrics(sliced, by, "event_probability", "actual_class_index", F.col("operating_threshold"))
    spread = sliced.groupBy(*by).agg(
        F.min("operating_threshold").alias("_lo"), F.max("operating_threshold").alias("_hi"),
        F.avg("max_probability").alias("mean_confidence"),
        F.avg("normalized_entropy").alias("mean_normalized_entropy"),
    )
    joined = point.select(*by, "rows", "accuracy", "precision", "recall", "f1").join(
        ranking.select(*by, "positive_rows", "roc_auc", "pr_auc", F.col("positive_rate").alias("prevalence")), by, "left"
    ).join(spread, by).withColumn("positive_rows", F.coalesce("positive_rows", F.lit(0).cast("long")))
    enough = (F.col("rows") >= minimum_rows) & (F.col("positive_rows") >= minimum_positives) & (F.col("positive_rows") < F.col("rows"))
    values = [c for c in joined.columns if c not in (*by, "rows", "positive_rows", "_lo", "_hi")]
    return joined.withColumns(supported(values, enough)).withColumn("single_threshold", F.col("_lo") == F.col("_hi")).drop("_lo", "_hi")


def confusion_slices(df: DataFrame, keys: Sequence[str], dimensions: Sequence[str], labels: Sequence[str], minimum_rows: int) -> DataFrame:
    return metrics.confusion_long(explode_slices(df, dimensions), [*keys, *SLICE], labels, minimum_rows)


def row_winner(first: Column, second: Column, names: tuple[str, str]) -> Column:
    """Name of the model with the smaller error, else ``tie``."""
    return F.when(first < second, names[0]).when(second < first, names[1]).otherwise("tie")


def with_winner(paired: DataFrame, names: tuple[str, str] = ("first", "second")) -> DataFrame:
    a, b = F.col("absolute_error_first"), F.col("absolute_error_second")
    return paired.withColumns({"error_delta": b - a, "winner": row_winner(a, b, names)})


def paired_slices(paired: DataFrame, keys: Sequence[str], dimensions: Sequence[str], minimum_rows: int) -> DataFrame:
    """Both models' errors, their deltas and the second model's row win rate per slice."""
    sliced = explode_slices(paired, dimensions)
    y = F.col("actual")
    first, second = F.col("prediction_first") - y, F.col("prediction_second") - y
    out = sliced.groupBy(*keys, *SLICE).agg(
        F.count(F.lit(1)).alias("rows"),
        rounded(F.sqrt(F.avg(first * first)), 10).alias("rmse_first"), rounded(F.sqrt(F.avg(second * second)), 10).alias("rmse_second"),
        rounded(F.avg(F.abs(first)), 10).alias("mae_first"), rounded(F.avg(F.abs(second)), 10).alias("mae_second"),
        F.avg("error_delta").alias("mean_error_delta"),
        rounded(F.avg((F.col("winner") == "second").cast("int")), 10).alias("second_win_rate"),
    )
    out = out.withColumn("rmse_delta", F.col("rmse_second") - F.col("rmse_first"))
    values = [c for c in out.columns if c not in (*keys, *SLICE, "rows")]
    return out.withColumns(supported(values, F.col("rows") >= minimum_rows))


def model_comparison(compared: DataFrame, keys: Sequence[str]) -> DataFrame:
    """RMSE of both forecasts on the same rows, the delta and whether the left one is better."""
    y = F.col("actual")
    a, b = F.col("prediction") - y, F.col("other_prediction") - F.col("other_actual")
    out = compared.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), rounded(F.sqrt(F.avg(a * a)), 10).alias("left_rmse"),
        rounded(F.sqrt(F.avg(b * b)), 10).alias("right_rmse"), F.every("mapped").alias("mapping_complete"),
        F.every("same_actual").alias("actuals_identical"), F.every("same_target_ts").alias("target_ts_identical"),
    )
    return out.withColumns(
        {"rmse_delta": F.col("left_rmse") - F.col("right_rmse"), "left_wins": F.col("left_rmse") < F.col("right_rmse")}
    )


def coverage_extremes(coverage: DataFrame, level: float, split: str = "test") -> DataFrame:
    """Nominal level, groups, groups below nominal and the range of empirical coverage."""
    return coverage.filter(F.col("split") == split).agg(
        F.lit(level).alias("nominal"), F.count(F.lit(1)).alias("groups"),
        F.count_if(F.col("interval_coverage") < level).alias("below_nominal"),
        F.min("interval_coverage").alias("minimum_coverage"), F.max("interval_coverage").alias("maximum_coverage"),
    )


def dominant_confusion(confusions: DataFrame, split: str = "test") -> DataFrame:
    """Largest off-diagonal cell; ties go to the lower horizon, then the labels."""
    off = confusions.filter(
        (F.col("split") == split) & (F.col("dimension") == "overall") & (F.col("actual_label") != F.col("predicted_label"))
    )
    return off.select("horizon", "actual_label", "predicted_label", "rows").orderBy(
        F.desc("rows"), "horizon", "actual_label", "predicted_label"
    ).limit(1)


def worst_slices(paired: DataFrame, k: int = 5, split: str = "test") -> DataFrame:
    kept = paired.filter((F.col("split") == split) & (F.col("dimension") != "overall") & F.col("sufficient_support"))
    return kept.select("horizon", "dimension", "slice_value", "rows", "rmse_delta").orderBy(
        F.desc("rmse_delta"), "horizon", "dimension", "slice_value"
    ).limit(k)


def winning_horizons(paired: DataFrame, split: str = "test") -> DataFrame:
    return paired.filter((F.col("split") == split) & (F.col("dimension") == "overall")).agg(
        F.count(F.lit(1)).alias("horizons"), F.count_if(F.col("rmse_delta") < 0).alias("second_wins")
    )


def analysis_checks(
    source: DataFrame, enriched: DataFrame, scored: DataFrame, classified: DataFrame, widths: DataFrame
) -> DataFrame:
    """Named reconciliation checks of an uncertainty analysis, one scan per table."""
    n = F.count(F.lit(1))
    a = enriched.agg(
        n.alias("rows"), F.count_if(F.col("actual_level").isNull()).alias("unmapped"),
        F.count_if(F.col("interval_lower") > F.col("interval_upper")).alias("unordered"),
    ).select(F.struct("*")).scalar()
    b = scored.agg(
        n.alias("rows"), F.count_if(F.col("max_probability").isNull() | F.isnan("normalized_entropy")).alias("unusable"),
    ).select(F.struct("*")).scalar()
    checks = {
        "calibration_uses_validation_only": widths.agg(F.every(F.col("calibration_split") == "validation")).scalar(),
        "regression_rows_reconciled": source.agg(n).scalar() == a["rows"],
        "classification_rows_reconciled": classified.agg(n).scalar() == b["rows"],
        "all_context_rows_mapped": a["unmapped"] == 0,
        "all_intervals_ordered": a["unordered"] == 0,
        "all_probabilities_finite": b["unusable"] == 0,
    }
    row = source.sparkSession.range(1)
    rows = F.array(*[F.struct(F.lit(k).alias("check"), v.alias("passed")) for k, v in checks.items()])
    return row.select(F.explode(rows).alias("r")).select("r.*")


