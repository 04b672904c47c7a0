"""Grid reconstruction, causal filling with donor lineage, label and dimension cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import stored
from ..functions.order_stats import quantiles
from ..functions.scalars import array_sum, blank_to_null, close_to, is_blank, rounded, to_number
from ..functions.windows import PanelSpec, last_known_marker, over_chunks, plus_steps

# Condition vocabulary, band limits over window capacity and method names.
CONDITION_MAP = {
    "clear": "Clear",
    "cloudy": "Cloudy",
    "overcast": "Cloudy",
    "rain": "Rain",
    "rainy": "Rain",
    "fog": "Fog",
    "foggy": "Fog",
}
OBSERVED = "observed"
SAME_ROW = "same_row_"
PREVIOUS = "previous_day_same_window"
FORWARD = "same_road_causal_forward_fill"
PEERS = "same_timestamp_station_median"


def day_bounds(df: DataFrame, spec: PanelSpec) -> dict[str, Column]:
    """Start of the first day and last step of the last day, from one scalar subquery."""
    ends = df.agg(F.to_date(F.min(spec.ts)).alias("lo"), F.to_date(F.max(spec.ts)).alias("hi")).select(
        F.struct(
            F.col("lo").cast("timestamp_ntz").alias("lo"),
            plus_steps(F.date_add("hi", 1).cast("timestamp_ntz"), -1, spec).alias("hi"),
        )
    )
    return {"start": ends.scalar().getField("lo"), "end": ends.scalar().getField("hi")}


def calendar(df: DataFrame, spec: PanelSpec, start: Column, end: Column) -> DataFrame:
    """Every timestamp of the configured range."""
    step = F.expr(f"INTERVAL '{spec.cadence_minutes}' MINUTE")
    return df.sparkSession.range(1).select(F.explode(F.sequence(start, end, step)).alias(spec.ts))


def metadata_conflicts(df: DataFrame, spec: PanelSpec, fields: Sequence[str]) -> DataFrame:
    """Entities whose static fields do not have exactly one value (null counts as a value)."""
    distinct = [F.count_distinct(F.struct(F.col(f))).alias(f) for f in fields]
    counted = df.groupBy(spec.entity).agg(*distinct)
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("values")) for f in fields])
    return counted.select(spec.entity, F.explode(pairs).alias("r")).select(spec.entity, "r.*").filter(
        F.col("values") != 1
    )


def grid_problems(df: DataFrame, spec: PanelSpec, static: Sequence[str], entities: int | None = None) -> DataFrame:
    """What forbids a grid: (problem, entity, n) for repeated keys, conflicting static fields, a wrong entity count."""
    keys = [spec.entity, spec.ts]
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = repeated.groupBy(spec.entity).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("repeated_key").alias("problem"), F.col(spec.entity).cast("string").alias("entity"), "n"
    )
    if static:
        conflicts = metadata_conflicts(df, spec, static).filter(F.col("values") > 1)
        found = found.unionByName(conflicts.select(
            F.concat(F.lit("conflicting_"), "field").alias("problem"), F.col(spec.entity).cast("string").alias("entity"), F.col("values").alias("n")
        ))
    if entities is not None:
        count = df.agg(F.count_distinct(spec.entity).alias("n")).filter(F.col("n") != entities)
        found = found.unionByName(count.select(F.lit("entity_count").alias("problem"), F.lit(None).cast("string").alias("entity"), "n"))
    return found


def complete_grid(
    df: DataFrame, spec: PanelSpec, static: Sequence[str], start: Column, end: Column,
    strict: bool = False, entities: int | None = None,
) -> DataFrame:
    """Every entity x cadence step; ``inserted`` marks steps without a source row.

    Static fields are back-filled per entity from its own observed rows, the smallest value where
    they differ. ``strict`` refuses panels with ``grid_problems``.
    """
    if strict and (bad := grid_problems(df, spec, static, entities).limit(5).collect()):
        raise ValueError("no grid over this panel: " + "; ".join(f"{r['problem']} {r['entity']} ({r['n']})" for r in bad))
    step = F.expr(f"INTERVAL '{spec.cadence_minutes}' MINUTE")
    # Distinct combinations hash-aggregate map-side; picking a text value needs a sort, so it runs
    # on these few rows only.
    entities = df.select(spec.entity, *static).distinct()
    if static:
        kept = [F.min(c).alias(c) for c in static]
        entities = entities.groupBy(spec.entity).agg(*kept)
    cells = entities.select(spec.entity, *static, F.explode(F.sequence(start, end, step)).alias(spec.ts))
    facts = df.drop(*static).withColumn("_present", F.lit(True))
    joined = cells.join(facts, [spec.entity, spec.ts], "left")
    order = [c for c in df.columns]
    return joined.select(*order, F.col("_present").isNull().alias("inserted"))


def describe_inserted(df: DataFrame, spec: PanelSpec, status: str | None = None) -> DataFrame:
    """Date and time text, validation status and event-observed flag of every grid cell."""
    known = F.col(status) if status else F.when(~F.col("inserted"), F.lit("valid"))
    return df.withColumns(
        {
            "date": F.date_format(spec.ts, "yyyy-MM-dd"),
            "time": F.date_format(spec.ts, "HH:mm"),
            "validation_status": F.coalesce(known, F.lit("reconstructed_missing_window")),
            "event_observed": ~F.col("inserted"),
        }
    )


def source_state_flags(
    df: DataFrame, issues: DataFrame, reasons: dict[str, tuple[str | None, str | None]], row_id: str
) -> DataFrame:
    """``<field>_original_missing`` and ``<field>_physical_invalid`` from the issue ledger."""
    flags = {}
    for field, (missing, invalid) in reasons.items():
        for suffix, reason in (("original_missing", missing), ("physical_invalid", invalid)):
            hit = (F.col("field") == field) & (F.col("reason_code") == reason) if reason else F.lit(False)
            flags[f"{field}_{suffix}"] = F.bool_or(hit)
    ledger = issues.groupBy(F.col("source_row").alias(row_id)).agg(
        *[flag.alias(name) for name, flag in flags.items()]
    )
    joined = df.join(ledger, row_id, "left")
    return joined.withColumns({n: F.coalesce(F.col(n), F.lit(False)) for n in flags})


def _donor(value: Column, row: Column, ts: Column) -> Column:
    return F.when(value.isNotNull(), F.struct(value.alias("value"), row.alias("row"), ts.alias("at")))


def causal_fill(
    df: DataFrame,
    spec: PanelSpec,
    field: str,
    *,
    row_id: str = "row_id",
    same_row: str | None = None,
    lag_steps: int = 48,
    forward_limit: int = 1,
    peers: str | None = None,
    peer_text: bool = True,
) -> DataFrame:
    """Fill one field from the past only, with the method and donor of every cell.

    Order: an equivalent column of the same row, the value ``lag_steps`` earlier, at most
    ``forward_limit`` steps forward, the median of the peer group at the same timestamp.  Value,
    donor row and donor time travel as one struct, so each step is one window over one exchange.
    """
    row, ts = F.col(row_id), F.col(spec.ts)
    own = _donor(F.col(field), row, ts)
    base = df.withColumn("_d0", own)
    if same_row:
        # The donor row id may be null on an inserted row; the value is what counts.
        base = base.withColumn("_d1", F.coalesce("_d0", _donor(F.col(same_row).cast(dict(df.dtypes)[field]), row, ts)))
    else:
        base = base.withColumn("_d1", F.col("_d0"))

    def previous(w):
        return {"_d2": F.coalesce("_d1", F.lag("_d1", lag_steps).over(w))}

    def forward(w):
        return {"_d3": F.last("_d2", ignorenulls=True).over(w.rowsBetween(-forward_limit, 0))}

    base = over_chunks(base, spec, previous, forward, back=lag_steps + forward_limit)
    value = F.col("_d3.value")
    method = (
        F.when(F.col("_d0").isNotNull(), OBSERVED)
        .when(F.col("_d1").isNotNull(), f"{SAME_ROW}{same_row}")
        .when(F.col("_d2").isNotNull(), PREVIOUS)
        .when(F.col("_d3").isNotNull(), FORWARD)
    )
    donors = F.when(F.col("_d3.row").isNotNull(), F.array(F.col("_d3.row")))
    at = F.col("_d3.at")
    if peers:
        open_cells = base.filter(F.col("_d3").isNull()).select(spec.ts, peers).distinct()
        near = base.select(spec.ts, peers, F.col("_d3.value").cast("double").alias("_v"), row_id).join(
            open_cells, [spec.ts, peers], "left_semi"
        ).filter(F.col("_v").isNotNull())
        middle = quantiles(near, [spec.ts, peers], "_v", {"_peer": 0.5})
        base = base.join(middle, [spec.ts, peers], "left")
        gap = F.col("_d3").isNull() & F.col("_peer").isNotNull()
        kind = dict(df.dtypes)[field]
        peer_value = F.col("_peer") if kind == "double" else F.rint("_peer").cast(kind)
        value = F.when(gap, peer_value).otherwise(value)
        method = F.when(gap, PEERS).otherwise(method)
        donors = F.when(~gap, donors)
        at = F.when(gap, ts).otherwise(at)
    method = F.coalesce(method, F.lit("unresolved"))
    imputed = method != OBSERVED
    out = base.withColumns(
        {
            "_value": value,
            f"{field}_method": method,
            f"{field}_donor_row": F.when(imputed & (method != PEERS), F.col("_d3.row")),
            f"{field}_donor_ts": F.when(imputed, at),
            f"{field}_donor_rows": F.when(imputed, F.to_json(donors)),
        }
    ).withColumn(field, F.col("_value"))
    out = out.drop("_value", "_d0", "_d1", "_d2", "_d3", "_peer")
    if not peers or not peer_text:
        return out
    out = stored(out)
    return with_donor_text(out, donor_edges(out, spec, field, peers, row_id), spec, field, peers)


def donor_edges(filled: DataFrame, spec: PanelSpec, field: str, peers: str, row_id: str = "row_id") -> DataFrame:
    """(timestamp, group, donor row) of the groups that gave a peer median, one row for each donor.

    Cells refer to their donors by timestamp and group, so nothing is repeated for every cell.
    """
    key, method = [spec.ts, peers], F.col(f"{field}_method")
    asked = filled.filter(method == PEERS).select(*key).distinct()
    givers = filled.filter((method != PEERS) & F.col(field).isNotNull() & F.col(row_id).isNotNull())
    return givers.select(*key, F.col(row_id).alias("donor_row")).join(asked, key, "left_semi").distinct()


def with_donor_text(cells: DataFrame, edges: DataFrame, spec: PanelSpec, field: str, peers: str) -> DataFrame:
    """``cells`` with the JSON list of the donors of their peer medians; only their own groups are put together."""
    key = [spec.ts, peers]
    wanted = cells.filter(F.col(f"{field}_method") == PEERS).select(*key).distinct()
    texts = edges.join(wanted, key, "left_semi").groupBy(*key).agg(F.to_json(F.array_sort(F.collect_list("donor_row"))).alias("_text"))
    joined = cells.join(texts, key, "left")
    text = F.when(F.col(f"{field}_method") == PEERS, F.col("_text")).otherwise(F.col(f"{field}_donor_rows"))
    return joined.withColumn(f"{field}_donor_rows", text).drop("_text")


def fill_fields(
    df: DataFrame, spec: PanelSpec, fields: Sequence[str], lag_steps: int, forward_limit: int
) -> DataFrame:
    """Previous-period then bounded forward fill of several fields over one exchange."""

    def previous(w):
        return {f: F.coalesce(f, F.lag(f, lag_steps).over(w)) for f in fields}

    def forward(w):
        return {f: F.last(f, ignorenulls=True).over(w.rowsBetween(-forward_limit, 0)) for f in fields}

    return over_chunks(df, spec, previous, forward, back=lag_steps + forward_limit)


def forward_fill(df: DataFrame, spec: PanelSpec, field: str, limit: int, row_id: str) -> DataFrame:
    """Bounded forward fill of one hourly field with its donor row (observed cells: no donor)."""
    with_donor = df.withColumn("_d", _donor(F.col(field), F.col(row_id), F.col(spec.ts)))

    def build(w):
        return {"_f": F.last("_d", ignorenulls=True).over(w.rowsBetween(-limit, 0))}

    filled = over_chunks(with_donor, spec, build, back=limit)
    missing = F.col(field).isNull()
    return filled.withColumns(
        {
            f"{field}_was_missing": missing,
            f"{field}_method": F.when(missing, "station_forward_fill").otherwise(OBSERVED),
            f"{field}_from_row": F.when(missing, F.col("_f.row")),
            "_value": F.col("_f.value"),
        }
    ).withColumn(field, F.col("_value")).drop("_value", "_d", "_f")


def unresolved_gaps(df: DataFrame, spec: PanelSpec, fields: Sequence[str]) -> DataFrame:
    """Cells still missing after filling, one row per cell."""
    pairs = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields]))
    return df.select(spec.entity, spec.ts, F.explode(pairs).alias("field"))


def require_filled(df: DataFrame, spec: PanelSpec, fields: Sequence[str]) -> None:
    """Fail when any gap lies outside the policy, naming at most ten cells."""
    sample = unresolved_gaps(df, spec, fields).limit(10).collect()
    if sample:
        raise ValueError(f"Gaps outside the fill policy: {[tuple(r) for r in sample]}")


def longest_missing_run(df: DataFrame, spec: PanelSpec, fields: Sequence[str]) -> DataFrame:
    """Longest run of consecutive missing rows per entity and field of a gap-free panel."""
    long = df.select(
        spec.entity,
        spec.ts,
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).isNull().alias("gap")) for f in fields])).alias("r"),
    ).select(spec.entity, spec.ts, "r.*")
    # Entity and field form one timeline each.
    keyed = long.withColumn("_line", F.struct(spec.entity, "field"))
    line = PanelSpec("_line", spec.ts, spec.cadence_minutes, spec.chunk_steps)
    marked = last_known_marker(keyed, line, F.when(~F.col("gap"), F.col(spec.ts)), "_seen")
    runs = (
        marked.filter("gap").groupBy(spec.entity, "field", "_seen").agg(F.count(F.lit(1)).alias("run"))
        .groupBy(spec.entity, "field").agg(F.max("run").alias("longest_run"))
    )
    every = keyed.select(spec.entity, "field").distinct()
    return every.join(runs, [spec.entity, "field"], "left").select(
        spec.entity, "field", F.coalesce("longest_run", F.lit(0)).cast("long").alias("longest_run")
    )


def fill_summary(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Cells per field and method, with what is still missing."""
    pairs = F.array(
        *[
            F.struct(F.lit(f).alias("field"), F.col(f"{f}_method").alias("method"), F.col(f).isNull().alias("open"))
            for f in fields
        ]
    )
    return (
        df.select(F.explode(pairs).alias("r")).select("r.*")
        .groupBy("field", "method")
        .agg(F.count(F.lit(1)).alias("cells"), F.count_if("open").alias("remaining_missing"))
    )


def fill_report(grid: DataFrame, filled: DataFrame, spec: PanelSpec, fields: Sequence[str]) -> DataFrame:
    """Per field: cells, missing after the grid was completed, still missing, and the longest missing run."""

    def missing(df: DataFrame, name: str) -> DataFrame:
        row = df.agg(F.count(F.lit(1)).alias("cells"), *[F.count_if(F.col(f).isNull()).alias(f) for f in fields])
        return row.unpivot(["cells"], list(fields), "field", name)

    runs = longest_missing_run(grid, spec, fields).groupBy("field").agg(F.max("longest_run").alias("longest_missing_run"))
    before, after = missing(grid, "missing_after_grid"), missing(filled, "missing_after_fill").drop("cells")
    return before.join(after, "field").join(runs, "field")


def daily_summary(df: DataFrame, day: str, flags: Sequence[str]) -> DataFrame:
    """Rows, coverage, days of each flag and its nulls in one row."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(day).alias("unique_days"), F.min(day).alias("first_day"), F.max(day).alias("last_day"),
        (F.date_diff(F.max(day), F.min(day)) + 1 - F.count_distinct(day)).cast("long").alias("missing_days"),
        *[F.count_if(F.col(f) == 1).alias(f"{f}_days") for f in flags], *[F.count_if(F.col(f).isNull()).alias(f"{f}_nulls") for f in flags],
    )


def expand_shares(df: DataFrame, column: str, keys: Sequence[str], tolerance: float) -> DataFrame:
    """JSON shares to columns divided by their sum; invalid text gives nulls and ``shares_valid``."""
    parsed = F.from_json(column, "map<string,double>")
    raw = F.col("_shares")
    values = F.transform(F.array(*[F.lit(k) for k in keys]), lambda k: F.element_at(raw, k))
    total = array_sum(values)
    out = df.withColumn("_shares", parsed)
    valid = (
        (F.array_sort(F.map_keys(raw)) == F.array(*[F.lit(k) for k in sorted(keys)]))
        & F.forall(F.map_values(raw), lambda v: v.between(0, 1))
        & (F.abs(total - 1.0) <= tolerance + 1e-12)
    )
    out = out.withColumn("shares_valid", F.coalesce(valid, F.lit(False)))
    ok = F.col("shares_valid")
    out = out.withColumns(
        {
            "share_sum": F.when(ok, total),
            "shares_normalized": F.when(ok, ~close_to(total, F.lit(1.0))),
            **{f"share_{k}": F.when(ok, F.element_at(raw, F.lit(k)) / total) for k in keys},
        }
    )
    return out.drop("_shares")


def share_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    output = sum((F.col(f"share_{k}") for k in keys[1:]), F.col(f"share_{keys[0]}"))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("shares_valid").alias("valid_rows"),
        F.count_if("shares_normalized").alias("normalized_rows"),
        rounded(F.min("share_sum")).alias("input_sum_min"),
        rounded(F.max("share_sum")).alias("input_sum_max"),
        rounded(F.min(output)).alias("output_sum_min"),
        rounded(F.max(output)).alias("output_sum_max"),
    )


def capacity_band(demand: Column, hourly_capacity: Column, windows_per_hour: int = 2) -> Column:
    """Half-open bands of demand over window capacity: 0.50, 0.80 and 1.00; unknown is Severe."""
    use = F.try_divide(demand.cast("double"), hourly_capacity / F.lit(float(windows_per_hour)))
    return F.when(use < 0.5, "Free-flow").when(use < 0.8, "Moderate").when(use < 1.0, "Heavy").otherwise("Severe")


def settle_label(df: DataFrame, source: str, derived: Column) -> DataFrame:
    """Keep the source label, else the derived one, and say which."""
    present = F.col(source).isNotNull()
    return df.withColumns(
        {
            f"{source}_derived": derived,
            f"{source}_was_derived": ~present,
            f"{source}_method": F.when(present, "source").otherwise("derived_volume_capacity"),
            f"{source}_disagrees": present & (F.col(source) != derived),
        }
    ).withColumn(source, F.coalesce(F.col(source), F.col(f"{source}_derived")))


def label_summary(df: DataFrame, source: str) -> DataFrame:
    return df.groupBy(source).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~F.col(f"{source}_was_derived")).alias("kept"),
        F.count_if(f"{source}_was_derived").alias("derived"),
        F.count_if(f"{source}_disagrees").alias("disagreements"),
    )


def cleaning_status(methods: Sequence[str], inserted: Column | None = None) -> Column:
    """unchanged / imputed / reconstructed from the fill methods of a row."""
    changed = F.lit(False)
    for method in methods:
        changed = changed | (F.col(method) != OBSERVED)
    out = F.when(changed, "imputed").otherwise("unchanged")
    return out if inserted is None else F.when(inserted, "reconstructed").otherwise(out)


def canonical_labels(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """Controlled vocabulary by trimmed lower-case lookup; the source text stays beside it."""
    pairs = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    source = F.col(column)
    return df.withColumn(f"{column}_source", source).withColumn(
        column, F.try_element_at(pairs, F.lower(F.trim(source)))
    )


def label_mapping_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per source and canonical label; an unknown label shows a null canonical."""
    return df.groupBy(F.col(f"{column}_source").alias("source_label"), F.col(column).alias("canonical_label")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def unknown_labels(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull() & F.col(f"{column}_source").isNotNull()).select(f"{column}_source").distinct()


def normalize_daily(df: DataFrame, date: str, flags: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Dates, 0/1 flags and trimmed names; ``problems`` lists what breaks the trusted contract."""
    day = F.to_date(date)
    numbers = {f: to_number(F.col(f)) for f in flags}
    names = {name: blank_to_null(F.col(name)) for _, name in pairs}
    found = [F.when(day.isNull(), F.lit("invalid_date"))]
    found += [F.when(~F.coalesce(n.isin(0, 1), F.lit(False)), F.lit(f"invalid_flag:{f}")) for f, n in numbers.items()]
    for flag, name in pairs:
        blank = is_blank(F.col(name))
        found.append(F.when((numbers[flag] == 1) & blank, F.lit(f"missing_name:{name}")))
        found.append(F.when((numbers[flag] == 0) & ~blank, F.lit(f"unexpected_name:{name}")))
    out = df.withColumn("problems", F.array_compact(F.array(*found)))
    return out.withColumns({date: day, **{f: n.cast("tinyint") for f, n in numbers.items()}, **names})


def context_summary(df: DataFrame, group: str, ts: str, measures: Sequence[str]) -> DataFrame:
    """Rows, coverage, ranges and remaining nulls per group."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(ts).alias("unique_hours"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        *[F.count_if(F.col(m).isNull()).alias(f"{m}_nulls") for m in measures],
        *[F.min(m).alias(f"{m}_min") for m in measures],
        *[F.max(m).alias(f"{m}_max") for m in measures],
    )


def invariant_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows breaking each named rule."""
    row = df.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
    return row.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])).alias("r")
    ).select("r.*")


