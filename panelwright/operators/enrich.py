"""Joins with a stated cardinality: context dimensions, pairings, key restrictions.

No side is broadcast by hint: the session's size threshold (checked again at run time by adaptive
execution) picks broadcast or shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import close_to


def join_status(marker: Column) -> Column:
    return F.when(marker.isNull(), "left_only").otherwise("both")


def join_hourly(df: DataFrame, hourly: DataFrame, group: str, ts: str, hour: str = "hour") -> DataFrame:
    """Many-to-one left join on (group, hour of ts) with a status column."""
    left = df.withColumn("aligned_hour", F.date_trunc("hour", ts).cast("timestamp_ntz"))
    right = hourly.withColumnRenamed(hour, "aligned_hour").withColumn("_hit", F.lit(True))
    out = left.join(right, [group, "aligned_hour"], "left")
    return out.withColumn("hourly_join_status", join_status(F.col("_hit"))).drop("_hit")


def join_daily(df: DataFrame, daily: DataFrame, ts: str, date: str = "date") -> DataFrame:
    """Many-to-one left join on the local date of ts with a status column."""
    left = df.withColumn("calendar_date", F.to_date(ts))
    right = daily.withColumnRenamed(date, "calendar_date").withColumn("_hit", F.lit(True))
    out = left.join(right, "calendar_date", "left")
    return out.withColumn("daily_join_status", join_status(F.col("_hit"))).drop("_hit")


def status_counts(df: DataFrame, statuses: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(s).alias("join"), F.col(s).alias("status")) for s in statuses])
    return df.select(F.explode(pairs).alias("r")).select("r.*").groupBy("join", "status").agg(
        F.count(F.lit(1)).alias("rows")
    )


def require_matched(df: DataFrame, status: str) -> None:
    misses = df.filter(F.col(status) != "both").count()
    if misses:
        raise ValueError(f"{status}: {misses} unexpected misses")


def join_proof(before: DataFrame, after: DataFrame, key: Sequence[str], ts: str, context: Sequence[str]) -> DataFrame:
    """Row change, duplicate keys, misaligned hours and null context of a finished join.

    Key counts and null counts share one aggregate: rows are first reduced per key.
    """
    n = F.count(F.lit(1))
    off = F.col("aligned_hour") != F.date_trunc("hour", ts).cast("timestamp_ntz")
    per_key = after.groupBy(*key).agg(
        n.alias("k"), F.count_if(off).alias("off"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in context]
    )
    proof = per_key.agg(
        F.sum("k").alias("rows"), F.sum(F.col("k") - 1).alias("duplicate_keys"), F.sum("off").alias("misaligned"),
        *[F.sum(f"null_{c}").alias(f"null_{c}") for c in context],
    )
    return proof.withColumn("row_change", F.col("rows") - before.agg(n).scalar())


def add_context(predictions: DataFrame, context: DataFrame, key: Sequence[str], classes: Sequence[str], horizon: str) -> DataFrame:
    """Origin-time context per prediction and the actual class of the row's own horizon."""
    out = predictions.join(context, list(key), "left")
    return out.withColumn(
        "actual_level", F.element_at(F.array(*[F.col(c) for c in classes]), F.col(horizon).cast("int"))
    ).drop(*classes)


def attach_width(predictions: DataFrame, calibration: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Interval width by calibration key; rows without one are listed by ``missing_widths``."""
    return predictions.join(calibration.select(*keys, "calibration_rows", "confidence_level", "width"), list(keys), "left")


def missing_widths(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("width").isNull()).alias("missing_widths"))


def keys_without_width(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Calibration keys whose rows have no width, and how many rows."""
    return df.filter(F.col("width").isNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))


def require_widths(predictions: DataFrame, calibration: DataFrame, keys: Sequence[str]) -> None:
    """Fail when a prediction's key has no calibrated width, naming at most ten keys."""
    known = calibration.filter(F.col("width").isNotNull()).select(*keys)
    lost = predictions.select(*keys).distinct().join(known, list(keys), "left_anti").limit(10).collect()
    if lost:
        raise ValueError(f"No calibrated width for {[tuple(r) for r in lost]}")


def pair_models(df: DataFrame, first: str, second: str, keys: Sequence[str], measures: Sequence[str], context: Sequence[str] = ()) -> DataFrame:
    """Both models' measures on their common keys, from one shuffle on the key.

    A self-join would read the predictions twice; grouping by the key holds at most one row of
    each model.
    """
    is_a, is_b = F.col("model_version") == first, F.col("model_version") == second

    def of(which: Column, c: str) -> Column:
        return F.max(F.when(which, F.col(c)))

    grouped = df.filter(is_a | is_b).groupBy(*keys).agg(
        F.count_if(is_a).alias("_a"), F.count_if(is_b).alias("_b"),
        *[F.max(c).alias(c) for c in context],
        of(is_a, "actual").alias("actual"), of(is_b, "actual").alias("actual_second"),
        *[of(is_a, m).alias(f"{m}_first") for m in measures],
        *[of(is_b, m).alias(f"{m}_second") for m in measures],
    )
    paired = grouped.filter((F.col("_a") > 0) & (F.col("_b") > 0))
    return paired.withColumn("actual_differs", ~close_to(F.col("actual"), F.col("actual_second"))).withColumn(
        "key_repeated", (F.col("_a") > 1) | (F.col("_b") > 1)
    ).drop("_a", "_b", "actual_second")


def require_paired(paired: DataFrame) -> None:
    found = paired.agg(F.count_if("actual_differs").alias("d"), F.count_if("key_repeated").alias("r")).first()
    if found["d"] or found["r"]:
        raise ValueError(f"Paired rows disagree: {found['d']} actuals differ, {found['r']} keys repeat")


def compare_forecasts(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Left join of two forecasts of the same rows with mapping flags per row."""
    r = right.select(*key, *[F.col(c).alias(f"other_{c}") for c in ("target_ts", "actual", "prediction")])
    return left.join(r, list(key), "left").withColumns(
        {
            "mapped": F.col("other_prediction").isNotNull(),
            "same_target_ts": F.coalesce(F.col("target_ts") == F.col("other_target_ts"), F.lit(False)),
            "same_actual": F.coalesce(F.col("actual") == F.col("other_actual"), F.lit(False)),
        }
    )


def nearest_event_days(dates: DataFrame, date: str, is_event: Column, out: str = "days_to_nearest_event") -> DataFrame:
    """Days from each distinct date to the nearest event date (null without events).

    The nearest earlier and later event are carried along the sorted calendar, one row per day, so
    no dates x events pairs are formed.
    """
    days = dates.groupBy(date).agg(F.max(F.when(is_event, F.col(date))).alias("_event"))
    # One row per calendar day: a century is 36,525 rows.
    back = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.orderBy(date).rowsBetween(0, Window.unboundedFollowing)
    before = F.datediff(date, F.last("_event", ignorenulls=True).over(back))
    after = F.datediff(F.first("_event", ignorenulls=True).over(ahead), date)
    return days.select(date, F.least(before, after).alias(out))


def common_keys(frames: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Keys present in every frame."""
    return reduce(DataFrame.intersect, [f.select(*key) for f in frames])


def restrict(df: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.join(keys, list(key), "left_semi")


def attach_partition(panel: DataFrame, assignments: DataFrame, key: Sequence[str], split: str) -> DataFrame:
    """Panel rows of one partition, with their assignment columns."""
    return panel.join(assignments.filter(F.col("split") == split), list(key))
