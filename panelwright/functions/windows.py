"""Entity-ordered windows that do not put a whole entity into one task.

A gap-free panel has one row per entity and cadence step, so a frame of ``k`` rows is also a
frame of ``k`` steps.  ``over_chunks`` uses that: each entity's timeline is cut into fixed chunks,
the few rows a neighbouring chunk needs are copied to it (the halo), and the window runs per
``(entity, chunk)``.  Task size is then ``chunk_steps`` plus the halo however long or hot an
entity is.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PanelSpec:
    """Key and cadence of a panel; ``chunk_steps=None`` means plain entity windows."""

    entity: str = "entity"
    ts: str = "ts"
    cadence_minutes: int = 30
    chunk_steps: int | None = 1344

    def plain(self) -> "PanelSpec":
        return PanelSpec(self.entity, self.ts, self.cadence_minutes, None)


def wall_minutes(ts: Column) -> Column:
    """Wall-clock minutes since 1970-01-01, free of session-zone shifts."""
    return F.unix_date(F.to_date(ts)).cast("long") * 1440 + F.hour(ts) * 60 + F.minute(ts)


def step_of(spec: PanelSpec, ts: Column | None = None) -> Column:
    """Index of a timestamp on the cadence grid."""
    minutes = wall_minutes(F.col(spec.ts) if ts is None else ts)
    return F.floor(minutes / F.lit(spec.cadence_minutes))


def plus_steps(ts: Column, steps: int, spec: PanelSpec) -> Column:
    return ts + F.expr(f"INTERVAL '{steps * spec.cadence_minutes}' MINUTE")


def entity_window(spec: PanelSpec) -> WindowSpec:
    return Window.partitionBy(spec.entity).orderBy(spec.ts)


Build = Callable[[WindowSpec], dict[str, Column]]


def over_chunks(
    df: DataFrame, spec: PanelSpec, *builds: Build, back: int = 0, ahead: int = 0
) -> DataFrame:
    """Add window columns reaching ``back`` rows behind and ``ahead`` rows in front.

    Several ``builds`` run in order over one exchange and sort; a later one may read the columns of
    an earlier one, and the reaches then add up.  Exact on a gap-free panel; pass ``spec.plain()``
    for panels with gaps, where a row frame and a time frame differ.
    """
    if spec.chunk_steps is None:
        for build in builds:
            df = df.withColumns(build(entity_window(spec)))
        return df
    size = spec.chunk_steps
    if max(back, ahead) > size:
        raise ValueError("The halo may not exceed the chunk")
    step = step_of(spec)
    home = F.floor(step / F.lit(size))
    offset = step - home * size
    copies = [home]
    if back:
        copies.append(F.when(offset >= size - back, home + 1))
    if ahead:
        copies.append(F.when(offset < ahead, home - 1))
    spread = df.withColumn("_home", home).withColumn("_chunk", F.explode(F.array_compact(F.array(*copies))))
    window = Window.partitionBy(spec.entity, "_chunk").orderBy(spec.ts)
    for build in builds:
        spread = spread.withColumns(build(window))
    return spread.filter("_chunk = _home").drop("_chunk", "_home")


def last_known_marker(
    df: DataFrame, spec: PanelSpec, marker: Column, out: str
) -> DataFrame:
    """Latest non-null ``marker`` (a timestamp) at or before each row of the entity.

    Per-chunk running maximum plus the maximum of all earlier chunks.  The second part is a window
    over one row per entity and chunk, not over the rows.
    """
    size = spec.chunk_steps or 1344
    chunked = df.withColumn("_chunk", F.floor(step_of(spec) / F.lit(size))).withColumn("_mark", marker)
    sums = chunked.groupBy(spec.entity, "_chunk").agg(F.max("_mark").alias("_top"))
    earlier = Window.partitionBy(spec.entity).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = sums.select(spec.entity, "_chunk", F.max("_top").over(earlier).alias("_carry"))
    inside = Window.partitionBy(spec.entity, "_chunk").orderBy(spec.ts).rowsBetween(
        Window.unboundedPreceding, 0
    )
    joined = chunked.join(carried, [spec.entity, "_chunk"])
    return joined.withColumn(
        out, F.coalesce(F.max("_mark").over(inside), F.col("_carry"))
    ).drop("_chunk", "_mark", "_carry")
