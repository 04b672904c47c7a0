"""Model registry tables, served batches and output contracts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .uncertainty import RISK_BANDS

AT_MOST, AT_LEAST = "less_than_or_equal", "greater_than_or_equal"


def unpivot_metrics(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Metric table to ``keys, metric, value``."""
    typed = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics])
    return typed.unpivot(list(keys), list(metrics), "metric", "value")


def acceptance(values: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``met`` of each (target, metric) value against its threshold; null without one."""
    joined = values.join(thresholds, ["target", "metric"], "left")
    met = F.when(F.col("operator") == AT_MOST, F.col("value") <= F.col("threshold")).when(
        F.col("operator") == AT_LEAST, F.col("value") >= F.col("threshold")
    )
    return joined.withColumn("met", met)


def acceptance_summary(decided: DataFrame) -> DataFrame:
    return decided.filter(F.col("met").isNotNull()).groupBy("target").agg(
        F.count(F.lit(1)).alias("evaluated"), F.count_if("met").alias("met_jobs"), F.every("met").alias("all_met")
    )


def scoreboard(jobs: DataFrame, metrics_long: DataFrame, splits: Sequence[str] = ("validation", "test")) -> DataFrame:
    """One row per job with its own primary metric in each split; ``finite`` flags unusable values."""
    joined = jobs.join(metrics_long, "job_id").filter("metric = primary_metric")
    wide = joined.groupBy(*jobs.columns).agg(
        *[F.max(F.when(F.col("split") == s, F.col("value"))).alias(f"{s}_primary_metric") for s in splits]
    )
    finite = F.lit(True)
    for s in splits:
        value = F.col(f"{s}_primary_metric")
        finite = finite & value.isNotNull() & ~F.isnan(value)
    return wide.withColumn("finite", F.coalesce(finite, F.lit(False)))


def prediction_index(predictions: DataFrame, job: str = "job_id") -> DataFrame:
    """Rows per job and split."""
    return predictions.groupBy(job).agg(
        F.count_if(F.col("split") == "validation").alias("validation_rows"),
        F.count_if(F.col("split") == "test").alias("test_rows"),
    ).withColumn("total_rows", F.col("validation_rows") + F.col("test_rows"))


def index_problems(index: DataFrame, registry: DataFrame, job: str = "job_id") -> DataFrame:
    """Unregistered jobs, jobs without predictions and jobs with an empty split."""
    parts = [
        index.join(registry, job, "left_anti").select(job, F.lit("unregistered").alias("problem")),
        registry.join(index, job, "left_anti").select(job, F.lit("no_predictions").alias("problem")),
        index.filter("validation_rows = 0 OR test_rows = 0").select(job, F.lit("empty_split").alias("problem")),
    ]
    return reduce(DataFrame.unionByName, parts)


def route(requests: DataFrame, registry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Model of each request; ``candidates`` other than one means the route fails."""
    per_key = registry.groupBy(*keys).agg(F.count(F.lit(1)).alias("candidates"), F.min("model").alias("model"))
    joined = requests.join(per_key, list(keys), "left")
    n = F.coalesce("candidates", F.lit(0))
    return joined.withColumns({"candidates": n, "model": F.when(n == 1, F.col("model")), "routed": n == 1})


def served_batch(
    regression: DataFrame, classes: DataFrame, targets: Sequence[str], labels: Sequence[str], versions: dict[str, str],
) -> DataFrame:
    """Wide rows per entity, origin and horizon: predictions, intervals, probabilities, bands, versions.

    ``regression`` has ``target, prediction, interval_lower, interval_upper``; ``classes`` has
    ``task, probabilities, event_probability, operating_threshold, confidence_band, risk_band``.
    """
    key = ["entity", "origin", "horizon"]
    numbers = []
    for t in targets:
        own = F.col("target") == t
        for c in ("prediction", "interval_lower", "interval_upper", "model_version"):
            numbers.append(F.max(F.when(own, F.col(c))).alias(f"{t}_{c}"))
    wide = regression.groupBy(*key).agg(*numbers)
    level, event = F.col("task") == "level", F.col("task") == "incident"
    p = F.max(F.when(level, F.col("probabilities")))
    marks = classes.groupBy(*key).agg(
        p.alias("_p"), F.max(F.when(level, F.col("confidence_band"))).alias("level_confidence_band"),
        F.max(F.when(event, F.col("event_probability"))).alias("event_probability"),
        F.max(F.when(event, F.col("operating_threshold"))).alias("operating_threshold"),
        F.max(F.when(event, F.col("confidence_band"))).alias("event_confidence_band"),
        F.max(F.when(event, F.col("risk_band"))).alias("event_risk_band"),
    )
    place = F.array_position("_p", F.array_max("_p")).cast("int")
    marks = marks.withColumns(
        {
            **{f"probability_{i}": F.col("_p")[i] for i in range(len(labels))},
            "level_prediction": F.element_at(F.array(*[F.lit(x) for x in labels]), place),
            "no_event_probability": 1 - F.col("event_probability"),
        }
    ).drop("_p")
    return wide.join(marks, key).withColumns({k: F.lit(v) for k, v in versions.items()})


def output_contract(
    batch: DataFrame, targets: Sequence[str], labels: Sequence[str], lineage: Sequence[str], requested: Column | None = None
) -> DataFrame:
    """Violations per output rule, in one aggregate over rows reduced per key."""
    probabilities = [F.col(f"probability_{i}") for i in range(len(labels))]
    numbers = [F.col(f"{t}_{c}") for t in targets for c in ("prediction", "interval_lower", "interval_upper")]

    def any_of(checks: Sequence[Column]) -> Column:
        return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(True)) for c in checks])

    total = sum(probabilities[1:], probabilities[0])
    rules = {
        "non_finite": any_of([c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")) for c in numbers + probabilities]),
        "negative": any_of([c < 0 for c in numbers]),
        "interval_order": any_of(
            [
                (F.col(f"{t}_interval_lower") > F.col(f"{t}_prediction")) | (F.col(f"{t}_interval_upper") < F.col(f"{t}_prediction"))
                for t in targets
            ]
        ),
        "probability_range": any_of([(p < 0) | (p > 1) for p in probabilities]),
        "level_sum": any_of([F.abs(total - 1) > 1e-6]),
        "event_sum": any_of([F.abs(F.col("event_probability") + F.col("no_event_probability") - 1) > 1e-6]),
        "level_vocabulary": any_of([~F.col("level_prediction").isin(*labels)]),
        "risk_vocabulary": any_of([~F.col("event_risk_band").isin(*RISK_BANDS)]),
        "confidence_vocabulary": any_of([~F.col(c).isin("low", "medium", "high") for c in ("level_confidence_band", "event_confidence_band")]),
        "missing_lineage": any_of([F.col(c).isNull() for c in lineage]),
    }
    per_key = batch.groupBy("entity", "origin", "horizon").agg(
        F.count(F.lit(1)).alias("_k"), *[F.count_if(c).alias(n) for n, c in rules.items()]
    )
    n = F.coalesce(F.sum("_k"), F.lit(0))
    sums = per_key.agg(
        *[F.coalesce(F.sum(n_), F.lit(0)).alias(n_) for n_ in rules], F.coalesce(F.sum(F.col("_k") - 1), F.lit(0)).alias("duplicate_keys"),
        (F.abs(n - requested) if requested is not None else F.lit(0)).cast("long").alias("row_count"),
    )
    names = [*rules, "duplicate_keys", "row_count"]
    return sums.unpivot([], names, "rule", "violations")


def request_ids(requests: DataFrame, fields: Sequence[str], version: str) -> DataFrame:
    """First 16 hex digits of the SHA-256 of the sorted compact JSON of a request."""
    payload = {**{f: F.col(f) for f in fields}, "inference_version": F.lit(version)}
    text = F.to_json(F.struct(*[payload[k].alias(k) for k in sorted(payload)]))
    return requests.withColumn("request_id", F.substring(F.sha2(text, 256), 1, 16))


def compare_metrics(left: DataFrame, right: DataFrame, keys: Sequence[str], tolerance: float, ignored: Sequence[str] = ()) -> DataFrame:
    """Full outer comparison of two ``keys, metric, value`` tables within a tolerance."""
    skip = F.col("metric").isin(*ignored) if ignored else F.lit(False)
    by = [*keys, "metric"]
    a = left.filter(~skip).select(*by, F.col("value").alias("a"), F.lit(True).alias("_a"))
    b = right.filter(~skip).select(*by, F.col("value").alias("b"), F.lit(True).alias("_b"))
    joined = a.join(b, by, "full")
    delta = F.abs(F.col("a") - F.col("b"))
    limit = F.greatest(F.lit(tolerance), F.lit(tolerance) * F.greatest(F.abs("a"), F.abs("b")))
    both_null = F.col("a").isNull() & F.col("b").isNull()
    present = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    same = present & F.coalesce(delta <= limit, both_null)
    return joined.select(*by, "a", "b", delta.alias("delta"), same.alias("same"))


def comparison_summary(compared: DataFrame) -> DataFrame:
    return compared.agg(
        F.count(F.lit(1)).alias("metrics"), F.count_if(~F.col("same")).alias("different"),
        F.coalesce(F.max("delta"), F.lit(0.0)).alias("max_delta"),
    )


def flatten_records(df: DataFrame, record: str) -> DataFrame:
    """Struct fields to columns; nested structs, arrays and maps become JSON text."""
    out = []
    for field in df.schema[record].dataType.fields:
        col = F.col(f"{record}.{field.name}")
        nested = field.dataType.typeName() in ("struct", "array", "map")
        out.append((F.to_json(col) if nested else col).alias(field.name))
    return df.select(*[c for c in df.columns if c != record], *out)
