"""Conformal intervals, confidence and risk bands, reliability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order_stats import ranked_values
from ..functions.scalars import ratio, rounded

CALIBRATION_KEY = ("model_version", "target", "horizon", "horizon_minutes")
# Confidence limits and multipliers of the operating threshold.
MEDIUM, HIGH = 0.55, 0.80
ELEVATED, CRITICAL = 0.5, 2.0
RISK_BANDS = ("low", "elevated", "high", "critical")


def conformal_rank(n: Column, level: float) -> Column:
    return F.least(n, F.ceil((n + 1) * F.lit(float(level))).cast("long"))


def conformal_widths(predictions: DataFrame, level: float, keys: Sequence[str] = CALIBRATION_KEY) -> DataFrame:
    """k-th smallest absolute validation residual per calibration key."""
    residuals = predictions.filter("split = 'validation'").select(
        *keys, F.abs(F.col("actual") - F.col("prediction")).alias("_e")
    )
    ranked = ranked_values(residuals, list(keys), "_e", lambda n: F.array(conformal_rank(n, level)))
    return ranked.select(
        *keys, F.lit("validation").alias("calibration_split"), F.col("n").alias("calibration_rows"),
        F.lit(float(level)).alias("confidence_level"), F.lit(1.0 - level).alias("alpha"),
        F.col("rank").alias("finite_sample_rank"), F.col("value").alias("width"),
        F.lit("finite_sample_higher").alias("quantile_method"),
    )


def interval_columns(clip_at_zero: bool = True) -> dict[str, Column]:
    """Errors and interval of rows that carry ``prediction``, ``actual`` and ``width``."""
    lower = F.col("prediction") - F.col("width")
    if clip_at_zero:
        lower = F.greatest(lower, F.lit(0.0))
    upper = F.col("prediction") + F.col("width")
    signed = F.col("prediction") - F.col("actual")
    return {
        "signed_error": signed,
        "absolute_error": F.abs(signed),
        "interval_lower": lower,
        "interval_upper": upper,
        "interval_width": upper - lower,
        "interval_covered": (F.col("actual") >= lower) & (F.col("actual") <= upper),
    }


def entropy(probabilities: Column) -> Column:
    tiny = F.lit(2.2250738585072014e-308)
    return F.aggregate(
        probabilities, F.lit(0.0), lambda acc, p: acc - p * F.ln(F.least(F.greatest(p, tiny), F.lit(1.0)))
    )


def confidence_band(top: Column, medium: float = MEDIUM, high: float = HIGH) -> Column:
    return F.when(top >= high, "high").when(top >= medium, "medium").otherwise("low")


def confidence_columns(probabilities: str = "probabilities") -> dict[str, Column]:
    """Max probability, entropy, normalised entropy, band and correctness."""
    p = F.col(probabilities)
    top = F.array_max(p)
    return {
        "max_probability": top,
        "entropy": entropy(p),
        "normalized_entropy": entropy(p) / F.ln(F.size(p).cast("double")),
        "confidence_band": confidence_band(top),
        "correct": F.col("actual_class_index") == F.col("predicted_class_index"),
    }


def risk_band(probability: Column, threshold: Column, elevated: float = ELEVATED, critical: float = CRITICAL) -> Column:
    """Threshold-relative band; null without a threshold."""
    top = F.least(F.lit(1.0), threshold * critical)
    return (
        F.when(threshold.isNull() | probability.isNull(), F.lit(None).cast("string"))
        .when(probability < threshold * elevated, RISK_BANDS[0])
        .when(probability < threshold, RISK_BANDS[1])
        .when(probability < top, RISK_BANDS[2])
        .otherwise(RISK_BANDS[3])
    )


def risk_band_table(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bounds, rows, events and rates per band; all four bands of every group are kept.

    One aggregate per group holds the sums of each band, so no band join is needed.
    """
    aggs = [F.max("operating_threshold").alias("operating_threshold")]
    for i, band in enumerate(RISK_BANDS):
        inside = F.col("risk_band") == band
        aggs += [
            F.count_if(inside).alias(f"n{i}"),
            F.coalesce(F.sum(F.when(inside, F.col("actual_class_index"))), F.lit(0)).cast("long").alias(f"e{i}"),
            F.sum(F.when(inside, F.col("event_probability"))).alias(f"p{i}"),
        ]
    wide = df.groupBy(*keys).agg(*aggs)
    t = F.col("operating_threshold")
    edges = [F.lit(0.0), t * ELEVATED, t, F.least(F.lit(1.0), t * CRITICAL), F.lit(1.0)]
    records = [
        F.struct(
            F.lit(band).alias("risk_band"), rounded(edges[i]).alias("probability_lower"),
            rounded(edges[i + 1]).alias("probability_upper"), F.col(f"n{i}").alias("rows"), F.col(f"e{i}").alias("event_rows"),
            rounded(ratio(F.col(f"e{i}"), F.col(f"n{i}"))).alias("observed_event_rate"),
            rounded(ratio(F.col(f"p{i}"), F.col(f"n{i}"))).alias("mean_probability"),
        )
        for i, band in enumerate(RISK_BANDS)
    ]
    return wide.select(*keys, F.explode(F.array(*records)).alias("r")).select(*keys, "r.*")


def reliability_rows(df: DataFrame) -> DataFrame:
    """Score and outcome per row: confidence against correctness, or event probability against event."""
    level = F.col("task") == "level"
    return df.withColumns(
        {
            "_p": F.when(level, F.array_max("probabilities")).otherwise(F.col("event_probability")),
            "_y": F.when(level, (F.col("actual_class_index") == F.col("predicted_class_index")).cast("double")).otherwise(
                F.col("actual_class_index").cast("double")
            ),
        }
    )


def reliability_table(df: DataFrame, keys: Sequence[str], bins: int, probability: str = "_p", outcome: str = "_y") -> DataFrame:
    """Equal-width bins with counts, means and gap, empty bins kept, and the group's calibration error.

    Rows shuffle as one partial sum per group and bin; a group's bins then fit one small array.
    """
    index = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).cast("int")
    sums = df.groupBy(*keys, index.alias("_bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(probability).alias("p"), F.avg(outcome).alias("y")
    )
    # At most ``bins`` rows per group.
    filled = F.map_from_entries(F.collect_list(F.struct("_bin", F.struct("n", "p", "y"))))
    wide = sums.groupBy(*keys).agg(
        filled.alias("_m"), (F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("_ece")
    )
    cell = F.try_element_at("_m", F.col("bin_index"))
    return wide.withColumn("bin_index", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).select(
        *keys, "bin_index", rounded(F.col("bin_index") / bins).alias("bin_lower"),
        rounded((F.col("bin_index") + 1) / bins).alias("bin_upper"), F.coalesce(cell["n"], F.lit(0)).alias("rows"),
        rounded(cell["p"]).alias("mean_probability"), rounded(cell["y"]).alias("observed_rate"),
        rounded(F.abs(cell["p"] - cell["y"])).alias("absolute_gap"), rounded(F.col("_ece")).alias("expected_calibration_error"),
    )


def calibration_error(df: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    return reliability_table(df, keys, bins).groupBy(*keys).agg(
        F.sum("rows").alias("rows"), F.count_if(F.col("rows") > 0).alias("populated_bins"),
        F.max("expected_calibration_error").alias("expected_calibration_error"),
    )


