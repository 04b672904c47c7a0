"""Panel, feature and prediction frames derived from the input tables.

``events`` plays the fact log: one entity per event type, half-hour windows of ``ts``; the entity's
group, an hourly and a daily context and prediction tables are derived from it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keyed import shared_dir
from ..functions.windows import PanelSpec
from ..operators.features import FeaturePlan

SPEC = PanelSpec()
PLAN = FeaturePlan(rain_above=20.0, low_visibility_below=60.0, temperature_bounds=(30.0, 50.0, 70.0))
# Ordered classes and their probability centres; bands of demand over capacity.
LEVELS = ("Free-flow", "Moderate", "Heavy", "Severe")
GROUPS = {"click": "browse", "view": "browse", "purchase": "convert", "signup": "convert"}
INCIDENT_VALUE = 150.0
HORIZONS = (1, 2, 3, 4)


def group_of(entity: Column) -> Column:
    out = None
    for name, group in GROUPS.items():
        out = (F if out is None else out).when(entity == name, group)
    return out.otherwise("ops")


# Frames stored once per application and data folder: path and schema; bounds by value.
_STORED: dict[tuple[str, str, str], tuple] = {}


class Tables:
    """Views over one data folder; frames that many queries start from are derived and stored once."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.path = path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    def kept(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A frame stored in the shared folder on first use, so that no query derives it again."""
        key = (self.spark.sparkContext.applicationId, self.path, name)
        if key not in _STORED:
            df = build()
            path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
            df.write.parquet(path)
            _STORED[key] = (path, df.schema)
        path, schema = _STORED[key]
        return self.spark.read.schema(schema).parquet(path)

    # -- fact panel ---------------------------------------------------------------------
    def observed(self) -> DataFrame:
        """Half-hour panel of observed windows only."""
        return self.kept("observed", self._observed)

    def _observed(self) -> DataFrame:
        return (
            self.events.groupBy(
                F.col("event_type").alias("entity"), F.window("ts", "30 minutes").alias("w")
            )
            .agg(
                F.min("event_id").alias("row_id"),
                F.count(F.lit(1)).alias("volume"),
                F.round(F.avg("value"), 6).alias("speed"),
                F.round(F.sum("value"), 2).alias("load"),
                F.count_if(F.col("value") >= INCIDENT_VALUE).alias("incidents"),
            )
            .select(
                "entity",
                group_of(F.col("entity")).alias("grp"),
                F.col("w.start").alias("ts"),
                "row_id",
                "volume",
                "speed",
                "load",
                "incidents",
            )
        )

    def panel(self) -> DataFrame:
        """Observed panel with the entity's static hourly capacity."""
        observed = self.observed()
        capacity = observed.groupBy("entity").agg(
            F.round(F.avg("load") * 3).cast("long").alias("capacity")
        )
        return observed.join(capacity, "entity")

    def grid(self) -> DataFrame:
        from ..operators import clean

        return clean.complete_grid(self.panel(), SPEC, ["grp", "capacity"], **self.bounds())

    def bounds(self) -> dict[str, Column]:
        """First and last window of the panel's calendar, read off the log itself."""
        from ..operators import clean

        key = (self.spark.sparkContext.applicationId, self.path, "bounds")
        if key not in _STORED:
            found = self.spark.range(1).select(*[c.alias(n) for n, c in clean.day_bounds(self.events, SPEC).items()]).first()
            _STORED[key] = tuple(found.asDict().items())
        # A log without rows has no bounds.
        return {n: F.lit(v).cast("timestamp_ntz") for n, v in _STORED[key]}

    def clean(self) -> DataFrame:
        """Gap-free panel, filled from yesterday's window and then at most three steps forward."""
        from ..operators import clean

        return self.kept("clean", lambda: clean.fill_fields(self.grid(), SPEC, ["volume", "speed", "load"], 48, 3))

    def hourly(self) -> DataFrame:
        """Hourly context per group: condition label, temperature, rainfall, visibility."""
        return (
            self.events.withColumn("grp", group_of(F.col("event_type")))
            .groupBy("grp", F.window("ts", "1 hour").alias("w"))
            .agg(
                F.round(F.avg("value"), 6).alias("temperature"),
                F.round(F.min("value"), 2).alias("rainfall"),
                F.round(F.max("value"), 2).alias("visibility"),
                F.min("event_id").alias("hour_row_id"),
                F.count(F.lit(1)).alias("n"),
            )
            .select(
                "grp",
                F.col("w.start").alias("hour"),
                F.when(F.col("n") >= 8, " RAIN").when(F.col("n") >= 5, "cloudy").when(
                    F.col("n") >= 3, "Foggy"
                ).otherwise("Clear ").alias("condition"),
                "temperature",
                "rainfall",
                "visibility",
                "hour_row_id",
            )
        )

    def daily(self) -> DataFrame:
        """Daily context: holiday, event and roadwork style flags with names."""
        day = self.events.groupBy(F.to_date("ts").alias("date")).agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") >= 200).alias("peaks")
        )
        weekend = F.weekday("date") == 6
        busy = F.pmod(F.col("n"), F.lit(7)) == 0
        return day.select(
            "date",
            weekend.cast("int").alias("public_holiday"),
            F.when(weekend, F.lit(" Sunday ")).alias("holiday_name"),
            busy.cast("int").alias("event_flag"),
            F.when(busy, F.lit("fair")).otherwise(F.lit("  ")).alias("event_name"),
            (F.col("peaks") >= 4).cast("int").alias("roadwork_flag"),
        )

    def merged(self) -> DataFrame:
        """Clean panel with hourly and daily context."""
        from ..operators import clean, enrich

        hourly = clean.canonical_labels(self.hourly(), "condition", clean.CONDITION_MAP).select(
            "grp", "hour", "condition", "temperature", "rainfall", "visibility", "hour_row_id"
        )
        out = enrich.join_hourly(self.clean(), hourly, group="grp", ts="ts")
        return enrich.join_daily(out, self.daily(), ts="ts")

    def features(self) -> DataFrame:
        from ..operators import features

        return features.engineer(self.merged(), SPEC, PLAN)

    def targets(self) -> DataFrame:
        from ..operators import clean, features

        panel = self.clean().withColumn(
            "level", clean.capacity_band(F.col("load"), F.col("capacity"))
        ).withColumn("observed", ~F.col("inserted"))
        return features.add_targets(panel, SPEC, TARGETS, HORIZONS)

    # -- prediction tables ---------------------------------------------------------------
    def splits(self) -> DataFrame:
        """Partition bounds over the calendar, which the completed panel fills."""
        from ..operators import clean, splits

        return self.kept("splits", lambda: splits.partition_bounds(clean.calendar(self.events, SPEC, **self.bounds()), "ts"))

    def forecasts(self) -> DataFrame:
        """Two baseline forecasters per horizon in long form, with their split."""
        from ..operators import forecasts

        return self.kept("forecasts", lambda: forecasts.baselines(self.clean(), SPEC, "load", HORIZONS, self.splits()))

    def context(self) -> DataFrame:
        """Origin-time context of every panel row and the future class per horizon."""
        from ..operators import forecasts

        return self.kept("context", lambda: forecasts.origin_context(self.clean(), self.hourly(), SPEC, HORIZONS))

    def classified(self) -> DataFrame:
        """Class probabilities for the level task and the incident task in long form."""
        from ..operators import forecasts

        return self.kept("classified", lambda: forecasts.class_scores(self.clean(), SPEC, HORIZONS, self.splits()))

    def scored(self) -> DataFrame:
        """Labelled documents with a bounded score and two coarse slices."""
        docs = self.documents.select("doc_id", "lang", "source", "n_chars")
        score = F.round(F.col("n_chars") / (F.col("n_chars") + 1500.0), 2)
        return self.labels.join(docs, "doc_id").select(
            "doc_id",
            "lang",
            "source",
            F.col("quality").cast("int").alias("actual"),
            score.alias("score"),
        )

    def raw(self) -> DataFrame:
        """Text form of the event log with the defects a raw feed shows, chosen by the second."""
        sec = F.second("ts")
        kind = F.col("event_type")
        share = F.get_json_object("props", "$.k").cast("double") / 100
        rest = F.format_string("%.2f", F.lit(1.0) - share)
        shares = F.concat(
            F.lit('{"a": '), F.format_string("%.2f", share), F.lit(', "b": '), rest, F.lit("}")
        )
        return self.events.select(
            F.col("event_id").alias("source_row"),
            F.when(sec == 1, "  ").when(sec == 2, "unknown").otherwise(kind).alias("entity"),
            F.when(sec == 3, F.lit(None)).otherwise(F.concat(F.lit("s"), F.col("user_id").cast("string"))).alias("station"),
            F.when(sec == 4, F.date_format("ts", "d/M/yyyy")).when(sec == 5, "2024-02-30").otherwise(
                F.date_format("ts", "yyyy-MM-dd")
            ).alias("date"),
            F.when(sec == 6, F.date_format("ts", "HH:mm")).otherwise(
                F.date_format(F.window("ts", "30 minutes").start, "HH:mm")
            ).alias("time"),
            F.when(sec == 7, "-5").when(sec == 8, "7.5").when(sec == 9, "n/a").when(sec == 10, "").otherwise(
                F.get_json_object("props", "$.k")
            ).alias("volume"),
            F.when(sec == 11, "Infinity").otherwise(F.col("value").cast("string")).alias("speed"),
            F.when(sec == 12, '{"a": 0.5}').when(sec == 13, "not json").when(
                sec == 14, '{"a": true, "b": 0.5}'
            ).when(sec == 15, '{"a": 1.4, "b": -0.4}').when(sec == 16, '{"a": 0.5, "b": 0.4}').otherwise(shares).alias("mix"),
            F.when(sec == 17, "").when(sec == 18, " heavy ").when(sec == 19, "Jammed").otherwise("Heavy").alias("level"),
            F.when(sec == 20, "2").when(sec < 30, "1").otherwise("0").alias("flag"),
            F.when((sec < 29) | (sec == 31), "works").alias("flag_name"),
            F.lit("events").alias("source_file"),
        )


# name, source column, kind, observation flag
TARGETS = (
    ("load", "load", "regression", None),
    ("level", "level", "multiclass", None),
    ("incident", "incidents", "binary", "observed"),
)
