"""Analytical aggregates over history, prediction batches and metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order_stats import quantiles
from ..functions.scalars import ratio
from .slices import SLICE, explode_slices

def rows() -> Column:
    return F.count(F.lit(1))


def share(condition: Column) -> Column:
    """Share of rows meeting a condition; null counts as not met."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("int"))


def context_aggregates(
    df: DataFrame, dimensions: Sequence[str], demand: str, means: Sequence[str], events: str, observed: str,
    label: str, order: Sequence[str],
) -> DataFrame:
    """Rows, means, median, event rate over observed rows and class counts per context value.

    Null context values are kept as their own group.
    """
    sliced = explode_slices(df, dimensions, overall=False, keep_null=True)
    seen = F.coalesce(F.col(observed), F.lit(False))
    hit = seen & F.coalesce(F.col(events) > 0, F.lit(False))
    sums = sliced.groupBy(*SLICE).agg(
        rows().alias("rows"), F.avg(demand).alias(f"{demand}_mean"), *[F.avg(m).alias(f"{m}_mean") for m in means],
        F.count_if(seen).alias("observed_rows"), F.count_if(hit).alias("positive_rows"),
        *[F.count_if(F.col(label) == x).alias(f"{label}_{_slug(x)}_rows") for x in order],
    )
    median = quantiles(sliced, list(SLICE), demand, {f"{demand}_median": 0.5})
    return sums.withColumn("positive_rate", ratio(F.col("positive_rows"), F.col("observed_rows"))).join(
        median, list(SLICE), "left"
    )


def _slug(text: str) -> str:
    return text.lower().replace("-", "_").replace(" ", "_")


def _pairs(columns: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[i:]]


def pearson(a: Column, b: Column) -> Column:
    """Correlation over rows with both values; null when either is constant."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    varied = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varied, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def _matrix(df: DataFrame, columns: Sequence[str], measure, name: str) -> DataFrame:
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    pairs = _pairs(columns)
    row = numbers.agg(*[measure(F.col(a), F.col(b)).alias(f"m{i}") for i, (a, b) in enumerate(pairs)])
    records = [
        F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"m{i}").alias(name))
        for i, (a, b) in enumerate(pairs)
    ]
    return row.select(F.explode(F.array(*records)).alias("r")).select("r.*")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Upper triangle with diagonal, pairwise complete, one pass."""
    return _matrix(df, columns, pearson, "correlation")


def covariance_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _matrix(df, columns, lambda a, b: F.covar_samp(F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)), "covariance")


def redundant_pairs(correlations: DataFrame, threshold: float) -> DataFrame:
    """Different features whose absolute correlation reaches the threshold, strongest first."""
    kept = correlations.filter((F.col("feature_a") != F.col("feature_b")) & (F.abs("correlation") >= threshold))
    return kept.orderBy(F.desc(F.abs("correlation")), "feature_a", "feature_b")


def target_correlations(df: DataFrame, features: Sequence[str], target: str, available: str) -> DataFrame:
    """Correlation of each feature with the target over available rows, with rank by strength."""
    t = F.when(F.col(available), F.col(target).cast("double"))
    row = df.agg(
        *[pearson(F.col(f).cast("double"), t).alias(f"c{i}") for i, f in enumerate(features)],
        *[F.count(F.when(t.isNotNull(), F.col(f))).alias(f"n{i}") for i, f in enumerate(features)],
    )
    records = [
        F.struct(F.lit(f).alias("feature"), F.col(f"n{i}").alias("observations"), F.col(f"c{i}").alias("correlation"))
        for i, f in enumerate(features)
    ]
    out = row.select(F.explode(F.array(*records)).alias("r")).select("r.*")
    # One row per feature.
    order = Window.orderBy(F.desc(F.abs(F.coalesce("correlation", F.lit(0.0)))), "feature")
    return out.withColumn("rank", F.row_number().over(order))


def findings(contexts: DataFrame, demand: str, speed: str, entity: str, hour: str, condition: str) -> DataFrame:
    """Entity and hour with the highest mean demand, condition with the lowest mean speed."""

    def top(dimension: str, measure: str, high: bool) -> Column:
        # The group itself breaks ties: the lowest name wins in both directions.
        value = F.when(F.col("dimension") == dimension, F.col(measure))
        key = F.struct((-value if high else value).alias("v"), F.col("slice_value").alias("n"))
        return F.min_by("slice_value", F.when(value.isNotNull(), key))

    return contexts.agg(
        top(entity, f"{demand}_mean", True).alias("highest_demand_entity"),
        top(hour, f"{demand}_mean", True).alias("peak_hour"),
        top(condition, f"{speed}_mean", False).alias("slowest_condition"),
    )


def filter_history(df: DataFrame, entity: str, ts: str, entities: Sequence[str], start: Column, end: Column) -> DataFrame:
    """Rows of the entities between two local dates, both included, in time order."""
    day_after = F.date_add(F.to_date(end), 1).cast("timestamp_ntz")
    inside = (F.col(ts) >= F.to_date(start).cast("timestamp_ntz")) & (F.col(ts) < day_after)
    return df.filter(F.col(entity).isin(*entities) & inside).orderBy(ts, entity)


def default_range(df: DataFrame, ts: str, days: int = 14) -> tuple[Column, Column]:
    """First and last date of the latest ``days`` days, as scalar subqueries."""
    last = df.agg(F.to_date(F.max(ts)).alias("d"))
    return last.select(F.date_sub("d", days - 1)).scalar(), last.scalar()


def batch_snapshot(df: DataFrame, entity: str, label: str, high: Sequence[str], mean_of: str, max_of: str) -> DataFrame:
    """Entities, high-class rows, mean and maximum; zeros for an empty batch."""
    zero = F.lit(0.0)
    return df.agg(
        F.count_distinct(entity).alias("entities"), F.count_if(F.col(label).isin(*high)).alias("high_class_rows"),
        F.coalesce(F.avg(mean_of), zero).alias("mean_value"), F.coalesce(F.max(max_of).cast("double"), zero).alias("max_value"),
    )


def latest_timestamps(df: DataFrame, ts: str, n: int) -> DataFrame:
    return df.select(ts).distinct().orderBy(F.desc(ts)).limit(n)


def severity_matrix(df: DataFrame, entity: str, ts: str, label: str, order: Sequence[str], n: int = 96) -> DataFrame:
    """Severity codes of the latest ``n`` timestamps per entity, oldest first (``n`` cells a row)."""
    recent = df.join(latest_timestamps(df, ts, n), ts, "left_semi")
    code = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(label)) - 1
    cells = F.array_sort(F.collect_list(F.struct(F.col(ts).alias("at"), F.when(code >= 0, code).cast("int").alias("severity"))))
    return recent.groupBy(entity).agg(cells.alias("cells"))


def severity_pivot(df: DataFrame, entity: str, ts: str, label: str, order: Sequence[str], n: int = 96) -> DataFrame:
    """The same as one column per timestamp; ``n`` bounds the columns."""
    recent = df.join(latest_timestamps(df, ts, n), ts, "left_semi")
    code = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(label)) - 1
    return recent.groupBy(entity).pivot(ts).agg(F.first(F.when(code >= 0, code)))


def entity_summary(df: DataFrame, keys: Sequence[str], demand: str, means: Sequence[str], label: str, severe: str, events: str) -> DataFrame:
    """Mean, peak, severe share and event windows per entity, busiest first."""
    return df.groupBy(*keys).agg(
        F.avg(demand).alias("mean_demand"), F.max(demand).alias("peak_demand"), *[F.avg(m).alias(f"mean_{m}") for m in means],
        share(F.col(label) == severe).alias("severe_share"), F.count_if(F.col(events) > 0).alias("event_windows"),
        rows().alias("windows"),
    ).orderBy(F.desc("mean_demand"), *keys)


def top_features(importance: DataFrame, task: str, horizon: int, n: int = 15) -> DataFrame:
    kept = importance.filter((F.col("task") == task) & (F.col("horizon") == horizon))
    return kept.orderBy("rank", "feature").limit(n)


def top_features_by_task(importance: DataFrame, keys: Sequence[str], n: int = 15) -> DataFrame:
    """The first ``n`` features of every task at once."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("rank", "feature"))
    return importance.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def half_hour_profile(df: DataFrame, entity: str, ts: str, measures: Sequence[str]) -> DataFrame:
    return df.groupBy(entity, F.date_format(ts, "HH:mm").alias("time_of_day")).agg(*[F.avg(m).alias(f"mean_{m}") for m in measures])


def condition_summary(df: DataFrame, condition: str, measures: Sequence[str], events: str) -> DataFrame:
    """Windows, means and event rate per condition; an unknown event counts as none."""
    return df.filter(F.col(condition).isNotNull()).groupBy(condition).agg(
        rows().alias("windows"), *[F.avg(m).alias(f"mean_{m}") for m in measures], share(F.col(events) > 0).alias("event_rate")
    )


def top_per_group(df: DataFrame, keys: Sequence[str], measure: str, tie: str, columns: Sequence[str]) -> DataFrame:
    """Row with the highest measure per group, ties to the lowest ``tie``; map-side combined."""
    order = F.struct((-F.col(measure)).alias("m"), F.col(tie).alias("t"))
    known = df.filter(F.col(measure).isNotNull())
    return known.groupBy(*keys).agg(F.min_by(F.struct(*columns), order).alias("b")).select(*keys, "b.*")


def class_counts(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    return df.groupBy(*keys, label).agg(rows().alias("entities"))


def batch_totals(df: DataFrame, entity: str, horizon: str, measures: Sequence[str]) -> DataFrame:
    return df.agg(
        F.count_distinct(entity).alias("entities"), F.count_distinct(horizon).alias("horizons"), rows().alias("rows"),
        *[F.avg(m).alias(f"mean_{m}") for m in measures],
    )


def class_shares(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(rows().alias("rows"))
    total = counts.agg(F.sum("rows")).scalar()
    return counts.withColumn("share", ratio(F.col("rows"), total))


def pressure_ranking(df: DataFrame, entity: str, label: str, high: Sequence[str]) -> DataFrame:
    return df.groupBy(entity).agg(share(F.col(label).isin(*high)).alias("pressure")).orderBy(F.desc("pressure"), entity)


def peak_row(df: DataFrame, measure: str, columns: Sequence[str]) -> DataFrame:
    """Row with the largest measure, ties to the first of ``columns``."""
    best = F.struct((-F.col(measure)).alias("m"), *columns)
    return df.filter(F.col(measure).isNotNull()).agg(F.min_by(F.struct(*columns, measure), best).alias("b")).select("b.*")


def slowest_entity(df: DataFrame, entity: str, speed: str) -> DataFrame:
    means = df.groupBy(entity).agg(F.avg(speed).alias("mean_speed"))
    return means.agg(F.min_by(F.struct(entity, "mean_speed"), F.struct("mean_speed", entity)).alias("b")).select("b.*")


def condition_contrast(df: DataFrame, rain: Column, low_visibility: Column, speed: str, condition: str) -> DataFrame:
    """Mean speed with and without rain, their difference, and the shares of both states."""
    wet = F.coalesce(rain, F.lit(False))
    return df.agg(
        rows().alias("windows"), F.count_distinct(condition).alias("conditions"), share(rain).alias("rain_share"),
        share(low_visibility).alias("low_visibility_share"), F.avg(F.when(wet, F.col(speed))).alias("rain_speed"),
        F.avg(F.when(~wet, F.col(speed))).alias("dry_speed"),
    ).withColumn("speed_difference", F.col("rain_speed") - F.col("dry_speed"))


def calibration_summary(reliability: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Calibration error and populated bins per group, with the worst group marked."""
    out = reliability.groupBy(*keys).agg(
        F.max("expected_calibration_error").alias("expected_calibration_error"), F.count_if(F.col("rows") > 0).alias("populated_bins")
    )
    worst = out.agg(F.min_by(F.struct(*keys), F.struct((-F.col("expected_calibration_error")).alias("e"), *keys))).scalar()
    return out.withColumn("is_worst", F.struct(*keys) == worst)


def latest_window_rmse(paired: DataFrame, keys: Sequence[str], ts: str, n: int = 192) -> DataFrame:
    """Both models' RMSE over the latest ``n`` rows of each group.

    Days are counted first and only days that can hold one of the latest ``n`` rows are ranked, so
    no group is sorted as a whole.
    """
    dated = paired.withColumn("_day", F.to_date(ts))
    days = dated.groupBy(*keys, "_day").agg(rows().alias("_n"))
    later = Window.partitionBy(*keys).orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_after", F.coalesce(F.sum("_n").over(later), F.lit(0))).filter(F.col("_after") < n)
    inside = Window.partitionBy(*keys, "_day").orderBy(F.desc(ts))
    kept = dated.join(days.drop("_n"), [*keys, "_day"]).withColumn(
        "_r", F.col("_after") + F.row_number().over(inside)
    ).filter(F.col("_r") <= n)
    y = F.col("actual")
    a, b = F.col("prediction_first") - y, F.col("prediction_second") - y
    return kept.groupBy(*keys).agg(
        rows().alias("rows"), F.sqrt(F.avg(a * a)).alias("rmse_first"), F.sqrt(F.avg(b * b)).alias("rmse_second")
    )


def priority_queue(df: DataFrame, risk: str, demand: str, tie: str, n: int | None = None) -> DataFrame:
    out = df.orderBy(F.desc(risk), F.desc(demand), tie)
    return out if n is None else out.limit(n)


def slowest_in_group(df: DataFrame, keys: Sequence[str], speed: str, entity: str) -> DataFrame:
    """Entity of the lowest speed per group and that speed; ties to the lowest name, nulls take no part."""
    order = F.struct(F.col(speed).alias("s"), F.col(entity).alias("e"))
    return df.filter(F.col(speed).isNotNull()).groupBy(*keys).agg(F.min(order).alias("_m")).select(
        *keys, F.col("_m.e").alias("slowest"), F.col("_m.s").alias("slowest_speed")
    )


def best_picks(summary: DataFrame, entity: str) -> DataFrame:
    """Busiest, fastest and most severe entity; ties to the lowest name."""

    def top(measure: str) -> Column:
        return F.min_by(entity, F.struct((-F.col(measure)).alias("m"), F.col(entity).alias("e")))

    return summary.agg(
        rows().alias("compared"), top("mean_demand").alias("busiest"), top("mean_speed").alias("fastest"),
        top("severe_share").alias("most_severe"),
    )


def acceptance_kpis(scoreboard: DataFrame) -> DataFrame:
    """Registered jobs, jobs that met their target, and whether every job of a target did."""
    met = F.coalesce(F.col("met"), F.lit(False))
    return scoreboard.groupBy("target").agg(
        rows().alias("jobs"), F.count_if(met).alias("met_jobs"), F.every(met).alias("all_met")
    )


def coverage_kpis(coverage: DataFrame, horizons: Sequence[int], split: str = "test") -> DataFrame:
    """Mean empirical and nominal coverage and the lowest-coverage row per target."""
    kept = coverage.filter((F.col("split") == split) & F.col("horizon").isin(*horizons))
    low = F.min_by(F.struct("horizon", "model_version", "interval_coverage"), F.struct("interval_coverage", "horizon", "model_version"))
    return kept.groupBy("target").agg(
        rows().alias("groups"), F.avg("interval_coverage").alias("mean_coverage"), F.avg("confidence_level").alias("nominal"),
        low.alias("b"),
    ).select(
        "target", "groups", "mean_coverage", "nominal", F.col("b.horizon").alias("lowest_horizon"),
        F.col("b.model_version").alias("lowest_model"), F.col("b.interval_coverage").alias("lowest_coverage"),
    )

