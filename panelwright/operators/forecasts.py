"""Long-form prediction rows: baseline forecasts, class scores and origin context."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import array_sum
from ..functions.windows import PanelSpec, over_chunks, plus_steps
from . import clean, enrich, features
from .splits import encode, with_split

LEVELS = ("Free-flow", "Moderate", "Heavy", "Severe")
CENTRES = (0.25, 0.65, 0.9, 1.3)
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def baselines(df: DataFrame, spec: PanelSpec, measure: str, horizons: Sequence[int], bounds: DataFrame) -> DataFrame:
    """``last_value`` and ``same_window_yesterday`` forecasts whose target stays in the split."""
    day = 24 * 60 // spec.cadence_minutes

    def build(w):
        out = {f"_a{h}": F.lead(measure, h).over(w) for h in horizons}
        return {**out, **{f"_y{h}": F.lag(measure, day - h).over(w) for h in horizons}}

    wide = over_chunks(df.select(spec.entity, spec.ts, measure), spec, build, back=day, ahead=max(horizons))
    records = F.array(
        *[
            F.struct(
                F.lit(h).alias("horizon"), F.lit(h * spec.cadence_minutes).alias("horizon_minutes"),
                plus_steps(F.col(spec.ts), h, spec).alias("target_ts"), F.lit(model).alias("model_version"),
                F.col(f"_a{h}").cast("double").alias("actual"), prediction.cast("double").alias("prediction"),
            )
            for h in horizons
            for model, prediction in (("last_value", F.col(measure)), ("same_window_yesterday", F.col(f"_y{h}")))
        ]
    )
    long = wide.select(spec.entity, spec.ts, F.explode(records).alias("r")).select(spec.entity, spec.ts, "r.*")
    known = long.filter("actual IS NOT NULL AND prediction IS NOT NULL")
    placed = with_split(known, spec.ts, bounds).filter("target_ts <= _split_end").drop("_split_end")
    return placed.withColumns(
        {"target": F.lit(measure), "residual": F.col("actual") - F.col("prediction")}
    )


def origin_columns(ts: Column) -> dict[str, Column]:
    """Hour, weekday, weekday type and peak status of the origin."""
    peaks = features.peak_columns(ts, features.FeaturePlan())
    names = F.array(*[F.lit(x) for x in WEEKDAYS])
    return {
        "origin_hour": F.hour(ts),
        "weekday": F.element_at(names, F.weekday(ts) + 1),
        "weekday_type": F.when(F.weekday(ts) >= 5, "weekend").otherwise("weekday"),
        "peak_status": F.when(peaks["is_morning_peak"], "morning_peak").when(
            peaks["is_evening_peak"], "evening_peak"
        ).otherwise("off_peak"),
    }


def origin_context(df: DataFrame, hourly: DataFrame, spec: PanelSpec, horizons: Sequence[int]) -> DataFrame:
    level = clean.capacity_band(F.col("load"), F.col("capacity"))
    labelled = df.select(spec.entity, "grp", spec.ts, level.alias("level"))

    def build(w):
        return {f"level_h{h}": F.lead("level", h).over(w) for h in horizons}

    wide = over_chunks(labelled, spec, build, ahead=max(horizons)).withColumns(origin_columns(F.col(spec.ts)))
    labels = clean.canonical_labels(hourly, "condition", clean.CONDITION_MAP).select("grp", "hour", "condition")
    joined = enrich.join_hourly(wide, labels, "grp", spec.ts)
    return joined.select(
        spec.entity, spec.ts, "origin_hour", "weekday", "weekday_type", "peak_status", "condition",
        *[f"level_h{h}" for h in horizons],
    )


def shares_of(weights: Column) -> Column:
    """Weights divided by their sum."""
    return F.transform(weights, lambda w: w / array_sum(weights))


def class_scores(df: DataFrame, spec: PanelSpec, horizons: Sequence[int], bounds: DataFrame) -> DataFrame:
    """Level probabilities from closeness to class centres, event probability from speed."""
    use = F.try_divide(F.col("load"), F.col("capacity") / 2.0)
    base = df.select(
        spec.entity, spec.ts, use.alias("_use"), "speed", "incidents", "inserted",
        encode(clean.capacity_band(F.col("load"), F.col("capacity")), LEVELS).alias("_level"),
    ).withColumn("_event", F.when(~F.col("inserted"), (F.col("incidents") > 0).cast("int")))

    def build(w):
        out = {f"_l{h}": F.lead("_level", h).over(w) for h in horizons}
        return {**out, **{f"_e{h}": F.lead("_event", h).over(w) for h in horizons}}

    wide = over_chunks(base, spec, build, ahead=max(horizons))
    records = []
    for h in horizons:
        weights = F.array(*[F.lit(1.0) / (F.lit(0.05 * h) + F.abs(F.col("_use") - c)) for c in CENTRES])
        level = shares_of(weights)
        p = F.round(F.col("speed") / (F.col("speed") + F.lit(400.0 + 50 * h)), 3)
        common = [
            F.lit(h).alias("horizon"), F.lit(h * spec.cadence_minutes).alias("horizon_minutes"),
            plus_steps(F.col(spec.ts), h, spec).alias("target_ts"),
        ]
        threshold = 0.1 + 0.005 * h
        records.append(
            F.struct(
                F.lit("level").alias("task"), *common, F.col(f"_l{h}").alias("actual_class_index"),
                level.alias("probabilities"), F.lit(None).cast("double").alias("operating_threshold"),
            )
        )
        records.append(
            F.struct(
                F.lit("incident").alias("task"), *common, F.col(f"_e{h}").alias("actual_class_index"),
                F.array(1 - p, p).alias("probabilities"), F.lit(threshold).alias("operating_threshold"),
            )
        )
    long = wide.select(spec.entity, spec.ts, F.explode(F.array(*records)).alias("r")).select(spec.entity, spec.ts, "r.*")
    known = long.filter(F.col("actual_class_index").isNotNull() & F.element_at("probabilities", 1).isNotNull())
    placed = with_split(known, spec.ts, bounds).filter("target_ts <= _split_end").drop("_split_end")
    best = (F.array_position("probabilities", F.array_max("probabilities")) - 1).cast("int")
    event = (F.element_at("probabilities", 2) >= F.col("operating_threshold")).cast("int")
    return placed.withColumns(
        {
            "predicted_class_index": F.when(F.col("task") == "level", best).otherwise(event),
            "event_probability": F.when(F.col("task") == "incident", F.element_at("probabilities", 2)),
            "model_version": F.lit("closeness_v1"),
        }
    )
