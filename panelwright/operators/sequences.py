"""Contiguous histories, eligible endpoints and fixed-length sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import PanelSpec, last_known_marker, over_chunks, plus_steps, step_of


def run_lengths(df: DataFrame, spec: PanelSpec, within: Sequence[str] = (), out: str = "run_length") -> DataFrame:
    """Rows since the last time gap, counted per entity (and per ``within`` columns).

    A row starts a run when nothing lies exactly one step before it; the halo of one step settles
    that inside a chunk, and the latest run start is carried over chunk boundaries.
    """
    line = PanelSpec("_line", spec.ts, spec.cadence_minutes, spec.chunk_steps)
    keyed = df.withColumn("_line", F.struct(spec.entity, *within))

    def build(w):
        return {"_prev": F.lag(spec.ts).over(w)}

    seen = over_chunks(keyed, line, build, back=1)
    follows = F.coalesce(plus_steps(F.col("_prev"), 1, spec) == F.col(spec.ts), F.lit(False))
    marked = last_known_marker(seen, line, F.when(~follows, F.col(spec.ts)), "_start")
    length = step_of(spec) - step_of(spec, F.col("_start")) + 1
    return marked.withColumn(out, length.cast("long")).drop("_line", "_prev", "_start")


def endpoint_mask(horizons: Sequence[int], target: str, spec: PanelSpec) -> Column:
    """All horizons known, inside the split, finite and exactly placed."""
    ok = F.lit(True)
    for h in horizons:
        value = F.col(f"target_{target}_h{h}").cast("double")
        ok = (
            ok
            & F.col(f"target_{target}_h{h}_available")
            & F.col(f"target_within_split_h{h}")
            & (F.abs(value) < float("inf"))
            & (F.col(f"target_ts_h{h}") == plus_steps(F.col(spec.ts), h, spec))
        )
    return F.coalesce(ok, F.lit(False))


def endpoints(df: DataFrame, spec: PanelSpec, length: int, mask: Column) -> DataFrame:
    """Eligible rows with at least ``length`` contiguous rows in their entity and split."""
    return run_lengths(df, spec, ["split"]).filter(mask & (F.col("run_length") >= length))


def feature_sequences(df: DataFrame, spec: PanelSpec, features: Sequence[str], length: int, out: str = "sequence") -> DataFrame:
    """``length`` x features array ending at each row of a gap-free panel; short histories are dropped."""
    row = F.array(*[F.col(f).cast("double") for f in features])

    def build(w):
        return {out: F.collect_list("_row").over(w.rowsBetween(-(length - 1), 0))}

    wide = over_chunks(df.withColumn("_row", row), spec, build, back=length - 1).drop("_row")
    return wide.filter(F.size(out) == length)


def fit_target_scaler(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation (0 becomes 1) per target column."""
    row = train.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.when(F.min(c) == F.max(c), F.lit(1.0)).otherwise(F.stddev_pop(c)).alias(f"s_{c}") for c in columns],
    )
    records = [
        F.struct(F.lit(c).alias("column"), F.col(f"m_{c}").alias("mean"), F.col(f"s_{c}").alias("scale")) for c in columns
    ]
    return row.select(F.explode(F.array(*records)).alias("r")).select("r.*")


def scale_targets(df: DataFrame, scaler: DataFrame, columns: Sequence[str], inverse: bool = False) -> DataFrame:
    from .prep import as_map

    out = df.withColumn("_fit", as_map(scaler))
    done = {}
    for c in columns:
        fit = F.col("_fit")[c]
        done[c] = F.col(c) * fit["scale"] + fit["mean"] if inverse else (F.col(c) - fit["mean"]) / fit["scale"]
    return out.withColumns(done).drop("_fit")


def sequence_manifest(df: DataFrame, spec: PanelSpec, length: int) -> DataFrame:
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("sequences"), F.lit(length).cast("int").alias("sequence_length"),
        F.count_distinct(spec.entity).alias("entities"), F.min(spec.ts).alias("origin_start"),
        F.max(spec.ts).alias("origin_end"),
    )


def full_timestamps(df: DataFrame, spec: PanelSpec, entities: DataFrame | None = None) -> DataFrame:
    """Timestamps that hold every entity (of the given table, or of the panel)."""
    keys = df.select(spec.entity, spec.ts).distinct()
    if entities is not None:
        keys = keys.join(entities.select(spec.entity).distinct(), spec.entity, "left_semi")
    wanted = (keys if entities is None else entities).agg(F.count_distinct(spec.entity)).scalar()
    return keys.groupBy(spec.ts).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == wanted).select(spec.ts)


def latest_common_origin(df: DataFrame, spec: PanelSpec, entities: DataFrame | None = None) -> DataFrame:
    return full_timestamps(df, spec, entities).agg(F.max(spec.ts).alias("origin"))


def eligible_origins(df: DataFrame, spec: PanelSpec, length: int) -> DataFrame:
    """Full-panel timestamps with ``length`` contiguous full-panel steps behind them."""
    series = full_timestamps(df, spec).withColumn("_all", F.lit(1))
    line = PanelSpec("_all", spec.ts, spec.cadence_minutes, spec.chunk_steps)
    return run_lengths(series, line).filter(F.col("run_length") >= length).select(spec.ts)


def origin_rows(df: DataFrame, spec: PanelSpec, requests: DataFrame) -> DataFrame:
    """One row per requested (entity, origin)."""
    return requests.join(df.withColumnRenamed(spec.ts, "origin"), [spec.entity, "origin"])


def missing_origins(df: DataFrame, spec: PanelSpec, requests: DataFrame) -> DataFrame:
    return requests.join(df.withColumnRenamed(spec.ts, "origin"), [spec.entity, "origin"], "left_anti")


def resolve_origins(requests: DataFrame, text: str, fmt: str, eligible: DataFrame, spec: PanelSpec) -> DataFrame:
    """Parsed request time and whether it is on the cadence and an eligible origin."""
    parsed = F.try_to_timestamp(F.col(text), F.lit(fmt)).cast("timestamp_ntz")
    out = requests.withColumn("origin", parsed)
    known = eligible.select(F.col(spec.ts).alias("origin"), F.lit(True).alias("_known"))
    aligned = (F.minute("origin") % spec.cadence_minutes == 0) & (F.second("origin") == 0)
    return out.join(known, "origin", "left").select(
        *requests.columns, "origin", F.coalesce(aligned, F.lit(False)).alias("aligned"),
        F.col("_known").isNotNull().alias("eligible"),
    )
