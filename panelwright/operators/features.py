"""Calendar, history, capacity and context features; future targets."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import PanelSpec, over_chunks, plus_steps
from .enrich import nearest_event_days


@dataclass(frozen=True)
class FeaturePlan:
    """Peak ranges, lags, rolling sizes, thresholds and bands."""

    peaks: tuple[tuple[str, str, str], ...] = (("morning", "07:00", "10:00"), ("evening", "17:00", "20:00"))
    measures: tuple[str, ...] = ("load", "speed")
    lags: tuple[int, ...] = (1, 2, 48)
    rolling: tuple[int, ...] = (4, 8)
    demand: str = "load"
    windows_per_hour: int = 2
    rain_above: float = 0.0
    low_visibility_below: float = 1000.0
    conditions: tuple[str, ...] = ("Clear", "Cloudy", "Rain", "Fog")
    temperature_bounds: tuple[float, ...] = (15.0, 25.0, 35.0)
    temperature_labels: tuple[str, ...] = ("cool", "mild", "warm", "hot")
    event_days: int = 1


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def clock_columns(ts: Column) -> dict[str, Column]:
    """Fractional hour, Monday=0 weekday, weekend flag."""
    return {
        "hour_of_day": minute_of_day(ts) / F.lit(60.0),
        "day_of_week": F.weekday(ts),
        "is_weekend": F.weekday(ts) >= 5,
    }


def cyclic_columns() -> dict[str, Column]:
    turn = F.lit(2 * math.pi)
    hour, day = turn * F.col("hour_of_day") / 24.0, turn * F.col("day_of_week") / 7.0
    return {
        "hour_sin": F.sin(hour), "hour_cos": F.cos(hour),
        "day_of_week_sin": F.sin(day), "day_of_week_cos": F.cos(day),
    }


def _minutes(text: str) -> int:
    hours, minutes = text.split(":")
    return int(hours) * 60 + int(minutes)


def peak_columns(ts: Column, plan: FeaturePlan) -> dict[str, Column]:
    """Half-open clock ranges and whether any applies."""
    minute = minute_of_day(ts)
    out = {
        f"is_{name}_peak": (minute >= _minutes(start)) & (minute < _minutes(end)) for name, start, end in plan.peaks
    }
    any_peak = F.lit(False)
    for flag in out.values():
        any_peak = any_peak | flag
    return {**out, "is_peak": any_peak}


def lag_names(plan: FeaturePlan) -> list[str]:
    return [f"{m}_lag_{k}" for m in plan.measures for k in plan.lags]


def rolling_names(plan: FeaturePlan) -> list[str]:
    return [f"{m}_rolling_{s}_{k}" for m in plan.measures for k in plan.rolling for s in ("mean", "std")]


def add_history(df: DataFrame, spec: PanelSpec, plan: FeaturePlan) -> DataFrame:
    """Lags and shifted full-frame rolling mean and deviation, all over one exchange."""

    def build(w):
        out = {}
        for m in plan.measures:
            for k in plan.lags:
                out[f"{m}_lag_{k}"] = F.lag(m, k).over(w)
            for k in plan.rolling:
                frame = w.rowsBetween(-k, -1)
                full = F.count(m).over(frame) == k
                out[f"{m}_rolling_mean_{k}"] = F.when(full, F.avg(m).over(frame))
                out[f"{m}_rolling_std_{k}"] = F.when(full, F.stddev_samp(m).over(frame))
        return out

    out = over_chunks(df, spec, build, back=max(*plan.lags, *plan.rolling))
    known = F.lit(True)
    for name in lag_names(plan) + rolling_names(plan):
        known = known & F.col(name).isNotNull()
    return out.withColumn("history_available", known)


def capacity_columns(plan: FeaturePlan) -> dict[str, Column]:
    window = F.col("capacity") / F.lit(float(plan.windows_per_hour))
    return {
        "window_capacity": window,
        "capacity_ratio": F.try_divide(F.col(plan.demand).cast("double"), window),
        "capacity_headroom": window - F.col(plan.demand),
    }


def condition_flags(plan: FeaturePlan) -> dict[str, Column]:
    rain = (F.col("rainfall") > plan.rain_above) | (F.col("condition") == "Rain")
    return {"is_rain": rain, "is_low_visibility": F.col("visibility") < plan.low_visibility_below}


def condition_indicators(plan: FeaturePlan) -> dict[str, Column]:
    return {f"condition_is_{c.lower()}": F.col("condition") == c for c in plan.conditions}


def banded(value: Column, bounds: Sequence[float], labels: Sequence[str]) -> Column:
    """Left-closed bands; null stays null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for bound, label in zip(bounds, labels):
        out = out.when(value < bound, label)
    return out.otherwise(labels[-1])


def event_columns(plan: FeaturePlan) -> dict[str, Column]:
    near = F.coalesce(F.col("days_to_nearest_event") <= plan.event_days, F.lit(False))
    return {"holiday_peak": (F.col("public_holiday") == 1) & F.col("is_peak"), "event_within_proximity": near}


def engineer(df: DataFrame, spec: PanelSpec, plan: FeaturePlan) -> DataFrame:
    """All origin-time features of the merged panel."""
    ts = F.col(spec.ts)
    out = add_history(df, spec, plan)
    out = out.withColumns({**clock_columns(ts), **peak_columns(ts, plan)})
    out = out.withColumns(
        {
            **cyclic_columns(), **capacity_columns(plan), **condition_flags(plan), **condition_indicators(plan),
            "temperature_band": banded(F.col("temperature"), plan.temperature_bounds, plan.temperature_labels),
        }
    )
    days = nearest_event_days(df.select("calendar_date", "event_flag"), "calendar_date", F.col("event_flag") == 1)
    return out.join(days, "calendar_date", "left").withColumns(event_columns(plan))


def history_gaps(df: DataFrame, entity: str) -> DataFrame:
    """Rows without full history per entity."""
    return df.groupBy(entity).agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("history_available")).alias("unavailable_rows"))


def add_targets(
    df: DataFrame,
    spec: PanelSpec,
    targets: Sequence[tuple[str, str, str, str | None]],
    horizons: Sequence[int],
) -> DataFrame:
    """Future timestamp, value and availability per horizon; no origin row is dropped.

    ``targets`` holds (name, source column, kind, observation flag).  A binary target is known only
    where the future window was observed, and is then whether its count is above zero.
    """
    flags = {flag for *_, flag in targets if flag}

    def build(w):
        out = {}
        for h in horizons:
            out[f"target_ts_h{h}"] = F.lead(spec.ts, h).over(w)
            for source in {source for _, source, _, _ in targets} | flags:
                out[f"_{source}_h{h}"] = F.lead(source, h).over(w)
        return out

    out = over_chunks(df, spec, build, ahead=max(horizons))
    columns: dict[str, Column] = {}
    for h in horizons:
        for name, source, kind, flag in targets:
            future = F.col(f"_{source}_h{h}")
            ready = F.col(f"target_ts_h{h}").isNotNull() & future.isNotNull()
            if flag:
                ready = ready & F.coalesce(F.col(f"_{flag}_h{h}"), F.lit(False))
            value = future > 0 if kind == "binary" else future
            columns[f"target_{name}_h{h}"] = F.when(ready, value)
            columns[f"target_{name}_h{h}_available"] = ready
    out = out.withColumns(columns)
    return out.drop(*[c for c in out.columns if c.startswith("_") and c.rsplit("_h", 1)[-1].isdigit()])


def misplaced_targets(df: DataFrame, spec: PanelSpec, horizons: Sequence[int]) -> DataFrame:
    """Per horizon: known future timestamps and those not exactly h steps ahead."""
    row = df.agg(
        *[F.count(f"target_ts_h{h}").alias(f"n{h}") for h in horizons],
        *[
            F.count_if(F.col(f"target_ts_h{h}") != plus_steps(F.col(spec.ts), h, spec)).alias(f"bad{h}")
            for h in horizons
        ],
    )
    records = F.array(
        *[
            F.struct(F.lit(h).alias("horizon"), F.col(f"n{h}").alias("available_rows"), F.col(f"bad{h}").alias("misplaced_rows"))
            for h in horizons
        ]
    )
    return row.select(F.explode(records).alias("r")).select("r.*")


def target_long(df: DataFrame, targets: Sequence[tuple], horizons: Sequence[int], keep: Sequence[str] = ()) -> DataFrame:
    """One row per origin, target and horizon with availability and the value as text."""
    records = F.array(
        *[
            F.struct(
                F.lit(f"{name}_h{h}").alias("target"), F.lit(kind).alias("kind"), F.lit(h).alias("horizon"),
                F.col(f"target_ts_h{h}").alias("target_ts"), F.col(f"target_{name}_h{h}_available").alias("available"),
                F.col(f"target_{name}_h{h}").cast("string").alias("value"),
            )
            for h in horizons
            for name, _, kind, _ in targets
        ]
    )
    return df.select(*keep, F.explode(records).alias("r")).select(*keep, "r.*")


def target_coverage(df: DataFrame, targets: Sequence[tuple], horizons: Sequence[int]) -> DataFrame:
    """Available, unavailable and null rows with positive and negative rows of binary targets."""
    long = target_long(df, targets, horizons)
    yes, no = F.col("value") == "true", F.col("value") == "false"
    binary = F.col("kind") == "binary"
    return long.groupBy("target", "kind").agg(
        F.count_if("available").alias("available_rows"), F.count_if(~F.col("available")).alias("unavailable_rows"),
        F.count_if(F.col("value").isNull()).alias("null_rows"),
        F.count_if(binary & yes).alias("positive_rows"), F.count_if(binary & no).alias("negative_rows"),
    )


def target_class_counts(df: DataFrame, targets: Sequence[tuple], horizons: Sequence[int]) -> DataFrame:
    multi = [x for x in targets if x[2] == "multiclass"]
    return target_long(df, multi, horizons).filter("available").groupBy("target", F.col("value").alias("class")).agg(
        F.count(F.lit(1)).alias("rows")
    )


