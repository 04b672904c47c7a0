"""Counters that the stages' own jobs gather while they run."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from ..functions.keyed import stored


def session_of_its_own(spark: SparkSession) -> SparkSession:
    """A session to run counted stages in, on the same cluster with the same settings.

    A session that has observed anything holds a listener that can't be serialised, and closures of
    MLlib's margin models hold their session; such models still work in the session they came from.
    """
    other = spark.newSession()
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        value = spark.conf.get(name, None)
        if value is not None:
            other.conf.set(name, value)
    return other


class StageCounters:
    """Stores each stage's result once and keeps what was counted on its way in and out.

    A counter is an observed aggregate of the job that writes the stage, so nothing is read a second
    time to be counted, and a stage that loses rows is counted as it really ran.
    """

    def __init__(self) -> None:
        self._held: list[tuple[str, dict[str, str], Observation]] = []

    def watch(self, stage: str, df: DataFrame, **counters: Column) -> DataFrame:
        """``df`` with aggregates that the next job over it will fill in."""
        seen = Observation(f"{stage}-{uuid.uuid4().hex}")
        names = {f"c{i}": name for i, name in enumerate(counters)}
        self._held.append((stage, names, seen))
        return df.observe(seen, *[expr.cast("long").alias(f"c{i}") for i, expr in enumerate(counters.values())])

    def run(self, stage: str, df: DataFrame, **counters: Column) -> DataFrame:
        """The stage's result, stored by one job that also fills the counters watched so far."""
        return stored(self.watch(stage, df, **counters))

    def table(self, spark: SparkSession) -> DataFrame:
        """``stage, counter, value`` of everything that ran; a few rows for each stage."""
        rows = []
        for stage, names, seen in self._held:
            found = seen.get
            rows += [(stage, name, found.get(key)) for key, name in names.items()]
        return spark.createDataFrame(rows, "stage string, counter string, value bigint")
