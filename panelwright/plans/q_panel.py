"""Queries over grid reconstruction, causal filling and context joins (CL, JN)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..operators import clean, contracts, enrich, uncertainty
from .frames import HORIZONS, SPEC, Tables
from .q_contracts import RAW
from .registry import query
from .sql import LEVEL, cte, r, with_ctes

_KEY = ["entity", "ts"]
_PAIR_KEY = ["entity", "ts", "target_ts", "split", "horizon", "horizon_minutes"]

# One field through every fill step, with donors.
cte(
    "fill_steps",
    """SELECT g.*, d1v, d1r, d1t, CASE WHEN d1v IS NOT NULL THEN d1v ELSE lag(d1v, 48) OVER w END AS d2v,
      CASE WHEN d1v IS NOT NULL THEN d1r ELSE lag(d1r, 48) OVER w END AS d2r, CASE WHEN d1v IS NOT NULL THEN d1t ELSE lag(d1t, 48) OVER w END AS d2t
    FROM (SELECT *, volume AS d1v, CASE WHEN volume IS NOT NULL THEN row_id END AS d1r, CASE WHEN volume IS NOT NULL THEN ts END AS d1t FROM grid) g
    WINDOW w AS (PARTITION BY entity ORDER BY ts)""",
    "grid",
)
cte(
    "fill_forward",
    """SELECT *, last_value(d2v IGNORE NULLS) OVER w AS d3v,
      last_value(CASE WHEN d2v IS NOT NULL THEN {'r': d2r, 't': d2t} END IGNORE NULLS) OVER w AS d3
    FROM fill_steps WINDOW w AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
    "fill_steps",
)
cte(
    "filled",
    """SELECT f.entity, f.ts, f.grp, f.volume AS raw_volume, f.inserted,
      CASE WHEN d3v IS NOT NULL THEN d3v WHEN p.mid IS NOT NULL THEN CAST(round_even(p.mid, 0) AS BIGINT) END AS volume,
      CASE WHEN f.volume IS NOT NULL THEN 'observed' WHEN d2v IS NOT NULL THEN 'previous_day_same_window'
        WHEN d3v IS NOT NULL THEN 'same_road_causal_forward_fill' WHEN p.mid IS NOT NULL THEN 'same_timestamp_station_median'
        ELSE 'unresolved' END AS volume_method,
      CASE WHEN f.volume IS NULL AND d3v IS NOT NULL THEN d3.r END AS volume_donor_row,
      CASE WHEN f.volume IS NOT NULL THEN NULL WHEN d3v IS NOT NULL THEN d3.t WHEN p.mid IS NOT NULL THEN f.ts END AS volume_donor_ts,
      CASE WHEN f.volume IS NOT NULL THEN NULL WHEN d3v IS NOT NULL THEN '[' || d3.r || ']'
        WHEN p.mid IS NOT NULL THEN '[' || array_to_string(p.ids, ',') || ']' END AS volume_donor_rows
    FROM fill_forward f LEFT JOIN (SELECT ts, grp, quantile_cont(d3v, 0.5) AS mid, list_sort(list(DISTINCT row_id) FILTER (row_id IS NOT NULL)) AS ids
      FROM fill_forward WHERE d3v IS NOT NULL GROUP BY 1, 2) p ON p.ts = f.ts AND p.grp = f.grp""",
    "fill_forward",
)


def _filled(t: Tables) -> DataFrame:
    return t.kept("filled", lambda: clean.causal_fill(t.grid(), SPEC, "volume", lag_steps=48, forward_limit=2, peers="grp", peer_text=False))


@query("CL1_complete_grid", with_ctes("grid", "SELECT entity, grp, ts, row_id, volume, speed, load, incidents, capacity, inserted FROM grid"))
def _(t: Tables) -> DataFrame:
    return t.grid()


@query(
    "CL2_metadata_conflicts",
    "SELECT entity, field, n AS values FROM (SELECT o_orderpriority AS entity, 'o_orderstatus' AS field, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 1) WHERE n <> 1",
)
def _(t: Tables) -> DataFrame:
    spec = type(SPEC)("o_orderpriority", "o_orderdate")
    out = clean.metadata_conflicts(t.orders.withColumn("fixed", F.lit(1)), spec, ["o_orderstatus", "fixed"])
    return out.withColumnRenamed("o_orderpriority", "entity")


@query("CL3_backfilled_metadata", with_ctes("grid", "SELECT entity, ts, grp, capacity FROM grid WHERE inserted"))
def _(t: Tables) -> DataFrame:
    return t.grid().filter("inserted").select("entity", "ts", "grp", "capacity")


@query(
    "CL4_inserted_descriptions",
    with_ctes(
        "grid",
        "SELECT entity, ts, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:%M') AS time, "
        "CASE WHEN inserted THEN 'reconstructed_missing_window' ELSE 'valid' END AS validation_status, NOT inserted AS event_observed FROM grid",
    ),
)
def _(t: Tables) -> DataFrame:
    return clean.describe_inserted(t.grid(), SPEC).select("entity", "ts", "date", "time", "validation_status", "event_observed")


@query(
    "CL5_source_state_flags",
    with_ctes(
        "va_issues va_parsed",
        """SELECT p.source_row, coalesce(bool_or(field = 'volume' AND reason_code = 'missing_value'), FALSE) AS volume_original_missing,
        coalesce(bool_or(field = 'volume' AND reason_code = 'invalid_numeric_range'), FALSE) AS volume_physical_invalid,
        coalesce(bool_or(field = 'speed' AND reason_code = 'missing_value'), FALSE) AS speed_original_missing,
        coalesce(bool_or(field = 'speed' AND reason_code = 'excessive_speed'), FALSE) AS speed_physical_invalid
        FROM va_parsed p LEFT JOIN va_issues i USING (source_row)
        WHERE p.source_row NOT IN (SELECT source_row FROM va_issues WHERE disposition = 'row_rejected') GROUP BY 1""",
    ),
)
def _(t: Tables) -> DataFrame:
    result = contracts.validate(t.raw(), RAW)
    reasons = {"volume": ("missing_value", "invalid_numeric_range"), "speed": ("missing_value", "excessive_speed")}
    out = clean.source_state_flags(result.valid.select("source_row"), result.issues, reasons, "source_row")
    return out


@query(
    "CL6_same_row_fill",
    with_ctes(
        "grid",
        "SELECT entity, ts, coalesce(row_id, volume) AS row_id_filled, CASE WHEN volume > 2 THEN NULL ELSE volume END IS NULL AND incidents IS NOT NULL AS from_same_row, "
        "coalesce(CASE WHEN volume > 2 THEN NULL ELSE volume END, incidents) AS volume FROM grid",
    ),
)
def _(t: Tables) -> DataFrame:
    grid = t.grid().withColumn("volume", F.when(F.col("volume") <= 2, F.col("volume")))
    out = clean.causal_fill(grid, SPEC, "volume", same_row="incidents", lag_steps=48, forward_limit=1)
    same = F.col("volume_method") == "same_row_incidents"
    kept = same | (F.col("volume_method") == "observed")
    return out.select(
        "entity", "ts", F.col("row_id").alias("row_id_filled"), same.alias("from_same_row"),
        F.when(kept, F.col("volume")).alias("volume"),
    )


@query(
    "CL7_previous_period_fill",
    with_ctes("fill_steps", "SELECT entity, ts, d2v AS volume, volume IS NULL AND d2v IS NOT NULL AS used FROM fill_steps WHERE d2v IS NOT NULL"),
)
def _(t: Tables) -> DataFrame:
    out = clean.causal_fill(t.grid(), SPEC, "volume", lag_steps=48, forward_limit=1)
    used = F.col("volume_method") == clean.PREVIOUS
    return out.filter(used | (F.col("volume_method") == clean.OBSERVED)).select("entity", "ts", "volume", used.alias("used"))


@query("CL8_bounded_forward_fill", with_ctes("fill_forward", "SELECT entity, ts, d3v AS volume FROM fill_forward"))
def _(t: Tables) -> DataFrame:
    return clean.causal_fill(t.grid(), SPEC, "volume", lag_steps=48, forward_limit=2).select("entity", "ts", "volume")


@query(
    "CL8b_hourly_forward_fill",
    with_ctes(
        "hourly",
        """SELECT grp, hour, was AS temperature_was_missing, CASE WHEN was THEN f ELSE temperature END AS temperature,
        CASE WHEN was THEN 'station_forward_fill' ELSE 'observed' END AS temperature_method, CASE WHEN was THEN fr END AS temperature_from_row
        FROM (SELECT *, temperature IS NULL AS was, last_value(temperature IGNORE NULLS) OVER w AS f,
          last_value(CASE WHEN temperature IS NOT NULL THEN hour_row_id END IGNORE NULLS) OVER w AS fr
          FROM (SELECT c.grp, s.hour, h.hour_row_id, CASE WHEN h.temperature <= 60 THEN h.temperature END AS temperature
            FROM (SELECT DISTINCT grp FROM hourly) c CROSS JOIN (SELECT unnest(generate_series((SELECT date_trunc('day', min(ts)) FROM events),
              (SELECT date_trunc('day', max(ts)) + INTERVAL '23 hours' FROM events), INTERVAL '1 hour')) AS hour) s
            LEFT JOIN hourly h ON h.grp = c.grp AND h.hour = s.hour)
          WINDOW w AS (PARTITION BY grp ORDER BY hour ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))""",
    ),
)
def _(t: Tables) -> DataFrame:
    spec = type(SPEC)("grp", "hour", 60, 672)
    hourly = t.hourly().select("grp", "hour", "hour_row_id", F.when(F.col("temperature") <= 60, F.col("temperature")).alias("temperature"))
    grid = clean.complete_grid(hourly, spec, [], **clean.day_bounds(hourly, spec))
    out = clean.forward_fill(grid, spec, "temperature", 2, "hour_row_id")
    return out.select("grp", "hour", "temperature_was_missing", "temperature", "temperature_method", "temperature_from_row")


@query("CL9_peer_median", with_ctes("filled", "SELECT entity, ts, volume FROM filled WHERE volume_method = 'same_timestamp_station_median'"))
def _(t: Tables) -> DataFrame:
    return _filled(t).filter(F.col("volume_method") == clean.PEERS).select("entity", "ts", "volume")


@query("CL10_method_labels", with_ctes("filled", "SELECT entity, ts, volume, volume_method FROM filled"))
def _(t: Tables) -> DataFrame:
    return _filled(t).select("entity", "ts", "volume", "volume_method")


@query(
    "CL11_donor_lineage",
    with_ctes("filled", "SELECT entity, ts, volume_donor_row, volume_donor_ts, volume_donor_rows FROM filled WHERE volume_method <> 'observed'"),
)
def _(t: Tables) -> DataFrame:
    cells = _filled(t).filter(F.col("volume_method") != clean.OBSERVED)
    edges = clean.donor_edges(_filled(t), SPEC, "volume", "grp")
    return clean.with_donor_text(cells, edges, SPEC, "volume", "grp").select("entity", "ts", "volume_donor_row", "volume_donor_ts", "volume_donor_rows")


@query(
    "CL11b_donor_edges",
    with_ctes(
        "filled",
        "SELECT DISTINCT ts, grp, CAST(unnest(from_json(volume_donor_rows, '[\"BIGINT\"]')) AS BIGINT) AS donor_row FROM filled WHERE volume_method = 'same_timestamp_station_median'",
    ),
)
def _(t: Tables) -> DataFrame:
    """Donors of the peer medians, once for each timestamp and group."""
    return clean.donor_edges(_filled(t), SPEC, "volume", "grp")


@query(
    "CL12_unresolved_gaps",
    with_ctes("clean", " UNION ALL ".join(f"SELECT entity, ts, '{f}' AS field FROM clean WHERE {f} IS NULL" for f in ("volume", "speed", "load"))),
)
def _(t: Tables) -> DataFrame:
    return clean.unresolved_gaps(t.clean(), SPEC, ["volume", "speed", "load"])


@query(
    "CL13_longest_missing_run",
    with_ctes(
        "grid",
        " UNION ALL ".join(
            f"""SELECT entity, '{f}' AS field, coalesce(max(n), 0) AS longest_run FROM (SELECT entity, count(*) FILTER (gap) AS n FROM
            (SELECT entity, {f} IS NULL AS gap, count({f}) OVER (PARTITION BY entity ORDER BY ts) AS island FROM grid) GROUP BY entity, island) GROUP BY 1"""
            for f in ("volume", "load")
        ),
    ),
)
def _(t: Tables) -> DataFrame:
    return clean.longest_missing_run(t.grid(), SPEC, ["volume", "load"])


@query(
    "CL14_fill_summary",
    with_ctes("filled", "SELECT 'volume' AS field, volume_method AS method, count(*) AS cells, count(*) FILTER (volume IS NULL) AS remaining_missing FROM filled GROUP BY 2"),
)
def _(t: Tables) -> DataFrame:
    return clean.fill_summary(_filled(t), ["volume"])


_FIELDS = ("volume", "speed", "load")


@query(
    "CL14b_fill_report",
    with_ctes(
        "grid clean",
        " UNION ALL ".join(
            f"""SELECT '{f}' AS field, (SELECT count(*) FROM grid) AS cells, (SELECT count(*) FROM grid WHERE {f} IS NULL) AS missing_after_grid,
            (SELECT count(*) FROM clean WHERE {f} IS NULL) AS missing_after_fill, coalesce(max(n), 0) AS longest_missing_run FROM (SELECT entity, count(*) FILTER (gap) AS n FROM
            (SELECT entity, {f} IS NULL AS gap, count({f}) OVER (PARTITION BY entity ORDER BY ts) AS island FROM grid) GROUP BY entity, island)"""
            for f in _FIELDS
        ),
    ),
)
def _(t: Tables) -> DataFrame:
    return clean.fill_report(t.grid(), t.clean(), SPEC, _FIELDS)


_SHARES = """SELECT source_row, mix_ok AS shares_valid, CASE WHEN mix_ok THEN a + b END AS share_sum,
    CASE WHEN mix_ok THEN abs(a + b - 1) > 1e-8 + 1e-5 END AS shares_normalized, CASE WHEN mix_ok THEN a / (a + b) END AS share_a,
    CASE WHEN mix_ok THEN b / (a + b) END AS share_b FROM (SELECT *, try_cast(CASE WHEN mix_ok THEN json_extract_string(mix, '$.a') END AS DOUBLE) AS a,
    try_cast(CASE WHEN mix_ok THEN json_extract_string(mix, '$.b') END AS DOUBLE) AS b FROM va_parsed)"""
cte("shares", _SHARES, "va_parsed")


@query(
    "CL15_expand_shares",
    with_ctes("shares", f"SELECT source_row, shares_valid, {r('share_sum')} AS share_sum, shares_normalized, {r('share_a')} AS share_a, {r('share_b')} AS share_b FROM shares"),
)
def _(t: Tables) -> DataFrame:
    out = clean.expand_shares(t.raw(), "mix", ["a", "b"], 0.02)
    return out.select(
        "source_row", "shares_valid", "shares_normalized", *[rounded(F.col(x)).alias(x) for x in ("share_sum", "share_a", "share_b")]
    )


@query(
    "CL15b_share_summary",
    with_ctes(
        "shares",
        f"SELECT count(*) AS rows, count(*) FILTER (shares_valid) AS valid_rows, count(*) FILTER (shares_normalized) AS normalized_rows, "
        f"{r('min(share_sum)')} AS input_sum_min, {r('max(share_sum)')} AS input_sum_max, {r('min(share_a + share_b)')} AS output_sum_min, "
        f"{r('max(share_a + share_b)')} AS output_sum_max FROM shares",
    ),
)
def _(t: Tables) -> DataFrame:
    return clean.share_summary(clean.expand_shares(t.raw(), "mix", ["a", "b"], 0.02), ["a", "b"])


@query("CL16_capacity_band", with_ctes("panel", f"SELECT entity, ts, {LEVEL.format('load', 'capacity')} AS level FROM panel"))
def _(t: Tables) -> DataFrame:
    return t.panel().select("entity", "ts", clean.capacity_band(F.col("load"), F.col("capacity")).alias("level"))


_SETTLED = f"""SELECT *, coalesce(src, d) AS level, src IS NULL AS derived, src IS NOT NULL AND src <> d AS differs FROM
    (SELECT *, {LEVEL.format('load', 'capacity')} AS d, CASE WHEN volume = 1 THEN 'Free-flow' WHEN volume = 3 THEN 'Heavy' END AS src FROM panel)"""


def _settled(t: Tables) -> DataFrame:
    source = F.when(F.col("volume") == 1, "Free-flow").when(F.col("volume") == 3, "Heavy")
    panel = t.panel().withColumn("level", source)
    return clean.settle_label(panel, "level", clean.capacity_band(F.col("load"), F.col("capacity")))


@query(
    "CL17_label_precedence",
    with_ctes(
        "panel",
        f"SELECT level, count(*) AS rows, count(*) FILTER (NOT derived) AS kept, count(*) FILTER (derived) AS derived, count(*) FILTER (differs) AS disagreements FROM ({_SETTLED}) GROUP BY 1",
    ),
)
def _(t: Tables) -> DataFrame:
    return clean.label_summary(_settled(t), "level")


@query(
    "CL18_cleaning_status",
    with_ctes(
        "filled",
        "SELECT entity, ts, CASE WHEN inserted THEN 'reconstructed' WHEN volume_method <> 'observed' THEN 'imputed' ELSE 'unchanged' END AS status FROM filled",
    ),
)
def _(t: Tables) -> DataFrame:
    return _filled(t).select("entity", "ts", clean.cleaning_status(["volume_method"], F.col("inserted")).alias("status"))


@query(
    "CL19_canonical_labels",
    with_ctes(
        "hourly hourly_clean",
        "SELECT h.condition AS source_label, c.condition AS canonical_label, count(*) AS rows FROM hourly h JOIN hourly_clean c USING (grp, hour) GROUP BY 1, 2",
    ),
)
def _(t: Tables) -> DataFrame:
    return clean.label_mapping_counts(clean.canonical_labels(t.hourly(), "condition", clean.CONDITION_MAP), "condition")


@query(
    "CL20_daily_normalisation",
    with_ctes(
        "daily",
        "SELECT date, CAST(public_holiday AS TINYINT) AS public_holiday, nullif(trim(holiday_name), '') AS holiday_name, "
        "CAST(event_flag AS TINYINT) AS event_flag, nullif(trim(event_name), '') AS event_name, CAST(roadwork_flag AS TINYINT) AS roadwork_flag, "
        "'' AS problems FROM daily",
    ),
)
def _(t: Tables) -> DataFrame:
    flags, pairs = ["public_holiday", "event_flag", "roadwork_flag"], [("public_holiday", "holiday_name"), ("event_flag", "event_name")]
    out = clean.normalize_daily(t.daily(), "date", flags, pairs)
    return out.withColumn("problems", F.array_join("problems", "|"))


cte(
    "seeded_daily",
    "SELECT date, CASE WHEN day(date) % 5 = 0 THEN 2 ELSE public_holiday END AS p, CASE WHEN day(date) % 2 = 0 THEN ' ' ELSE holiday_name END AS h, "
    "event_flag AS e, CASE WHEN day(date) % 3 = 0 THEN 'x' ELSE event_name END AS n, roadwork_flag AS w FROM daily",
    "daily",
)


@query(
    "CL20b_daily_problems",
    with_ctes(
        "seeded_daily",
        "SELECT date, CAST(p AS TINYINT) AS public_holiday, nullif(trim(h), '') AS holiday_name, CAST(e AS TINYINT) AS event_flag, nullif(trim(n), '') AS event_name, CAST(w AS TINYINT) AS roadwork_flag, "
        "concat_ws('|', CASE WHEN p NOT IN (0, 1) THEN 'invalid_flag:public_holiday' END, CASE WHEN p = 1 AND coalesce(trim(h), '') = '' THEN 'missing_name:holiday_name' END, "
        "CASE WHEN p = 0 AND coalesce(trim(h), '') <> '' THEN 'unexpected_name:holiday_name' END, CASE WHEN e = 1 AND coalesce(trim(n), '') = '' THEN 'missing_name:event_name' END, "
        "CASE WHEN e = 0 AND coalesce(trim(n), '') <> '' THEN 'unexpected_name:event_name' END) AS problems FROM seeded_daily",
    ),
)
def _(t: Tables) -> DataFrame:
    """The same with defects in the flags and names of certain days."""
    flags, pairs = ["public_holiday", "event_flag", "roadwork_flag"], [("public_holiday", "holiday_name"), ("event_flag", "event_name")]
    day = F.dayofmonth("date")
    seeded = t.daily().withColumns({
        "public_holiday": F.when(day % 5 == 0, 2).otherwise(F.col("public_holiday")),
        "holiday_name": F.when(day % 2 == 0, " ").otherwise(F.col("holiday_name")),
        "event_name": F.when(day % 3 == 0, "x").otherwise(F.col("event_name")),
    })
    return clean.normalize_daily(seeded, "date", flags, pairs).withColumn("problems", F.array_join("problems", "|"))


@query(
    "CL21_context_summary",
    with_ctes(
        "hourly",
        "SELECT grp, count(*) AS rows, count(DISTINCT hour) AS unique_hours, min(hour) AS first_ts, max(hour) AS last_ts, "
        "count(*) - count(temperature) AS temperature_nulls, count(*) - count(visibility) AS visibility_nulls, "
        "min(temperature) AS temperature_min, min(visibility) AS visibility_min, max(temperature) AS temperature_max, max(visibility) AS visibility_max FROM hourly GROUP BY 1",
    ),
)
def _(t: Tables) -> DataFrame:
    return clean.context_summary(t.hourly(), "grp", "hour", ["temperature", "visibility"])


@query(
    "CL21b_daily_summary",
    with_ctes(
        "daily",
        "SELECT count(*) AS rows, count(DISTINCT date) AS unique_days, min(date) AS first_day, max(date) AS last_day, CAST(max(date) - min(date) + 1 - count(DISTINCT date) AS BIGINT) AS missing_days, "
        + ", ".join(f"count(*) FILTER ({f} = 1) AS {f}_days, count(*) - count({f}) AS {f}_nulls" for f in ("public_holiday", "event_flag", "roadwork_flag")) + " FROM daily",
    ),
)
def _(t: Tables) -> DataFrame:
    return clean.daily_summary(t.daily(), "date", ["public_holiday", "event_flag", "roadwork_flag"])


@query(
    "JN1_hourly_context",
    with_ctes("merged", "SELECT entity, ts, aligned_hour, condition, temperature, rainfall, visibility, hour_row_id, hourly_join_status FROM merged"),
)
def _(t: Tables) -> DataFrame:
    labels = clean.canonical_labels(t.hourly(), "condition", clean.CONDITION_MAP).drop("condition_source")
    return enrich.join_hourly(t.clean(), labels, "grp", "ts").select(
        "entity", "ts", "aligned_hour", "condition", "temperature", "rainfall", "visibility", "hour_row_id", "hourly_join_status"
    )


@query(
    "JN2_daily_context",
    with_ctes("merged", "SELECT entity, ts, calendar_date, public_holiday, event_flag, roadwork_flag, daily_join_status FROM merged"),
)
def _(t: Tables) -> DataFrame:
    return enrich.join_daily(t.clean(), t.daily(), "ts").select(
        "entity", "ts", "calendar_date", "public_holiday", "event_flag", "roadwork_flag", "daily_join_status"
    )


@query(
    "JN3_join_status",
    with_ctes(
        "merged",
        "SELECT 'hourly_join_status' AS \"join\", hourly_join_status AS status, count(*) AS rows FROM merged GROUP BY 2 UNION ALL "
        "SELECT 'daily_join_status', daily_join_status, count(*) FROM merged GROUP BY 2",
    ),
)
def _(t: Tables) -> DataFrame:
    return enrich.status_counts(t.merged(), ["hourly_join_status", "daily_join_status"])


@query(
    "JN4_join_proof",
    with_ctes(
        "merged clean",
        "SELECT count(*) AS rows, count(*) - count(DISTINCT (entity, ts)) AS duplicate_keys, count(*) FILTER (aligned_hour <> date_trunc('hour', ts)) AS misaligned, "
        "count(*) FILTER (condition IS NULL) AS null_condition, count(*) FILTER (public_holiday IS NULL) AS null_public_holiday, "
        "count(*) - (SELECT count(*) FROM clean) AS row_change FROM merged",
    ),
)
def _(t: Tables) -> DataFrame:
    return enrich.join_proof(t.clean(), t.merged(), _KEY, "ts", ["condition", "public_holiday"])


@query(
    "JN5_origin_context",
    with_ctes("in_context", "SELECT entity, ts, horizon, model_version, origin_hour, weekday, weekday_type, peak_status, condition, actual_level FROM in_context"),
)
def _(t: Tables) -> DataFrame:
    out = enrich.add_context(t.forecasts(), t.context(), _KEY, [f"level_h{h}" for h in HORIZONS], "horizon")
    return out.select(
        "entity", "ts", "horizon", "model_version", "origin_hour", "weekday", "weekday_type", "peak_status", "condition", "actual_level"
    )


@query("JN6_interval_width", with_ctes("forecasts widths", f"SELECT f.entity, f.ts, f.horizon, f.model_version, w.calibration_rows, {r('w.width')} AS width FROM forecasts f LEFT JOIN widths w USING (model_version, target, horizon, horizon_minutes)"))
def _(t: Tables) -> DataFrame:
    preds = t.forecasts()
    widths = uncertainty.conformal_widths(preds, 0.9)
    enrich.require_widths(preds, widths, uncertainty.CALIBRATION_KEY)
    out = enrich.attach_width(preds, widths, uncertainty.CALIBRATION_KEY)
    return out.select("entity", "ts", "horizon", "model_version", "calibration_rows", rounded(F.col("width")).alias("width"))


@query(
    "JN6b_missing_widths",
    with_ctes("forecasts", "SELECT model_version, target, horizon, count(*) AS rows FROM forecasts WHERE horizon = 4 GROUP BY 1, 2, 3"),
)
def _(t: Tables) -> DataFrame:
    """Keys of predictions for which no width was calibrated."""
    preds = t.forecasts()
    widths = uncertainty.conformal_widths(preds, 0.9).filter("horizon <> 4")
    out = enrich.attach_width(preds, widths, uncertainty.CALIBRATION_KEY)
    return enrich.keys_without_width(out, ["model_version", "target", "horizon"])


@query("JN7_paired_models", with_ctes("paired", "SELECT entity, ts, horizon, split, actual, prediction_first, prediction_second, FALSE AS actual_differs, FALSE AS key_repeated FROM paired"))
def _(t: Tables) -> DataFrame:
    out = enrich.pair_models(t.forecasts(), "last_value", "same_window_yesterday", _PAIR_KEY, ["prediction"])
    return out.select("entity", "ts", "horizon", "split", "actual", "prediction_first", "prediction_second", "actual_differs", "key_repeated")


@query(
    "JN8_forecast_mapping",
    with_ctes(
        "forecasts",
        "SELECT a.horizon, count(*) AS rows, count(b.prediction) AS mapped_rows, count(*) FILTER (coalesce(a.target_ts = b.target_ts, FALSE)) AS same_target_rows, "
        "count(*) FILTER (coalesce(a.actual = b.actual, FALSE)) AS same_actual_rows FROM (SELECT * FROM forecasts WHERE model_version = 'same_window_yesterday' AND split = 'test') a "
        "LEFT JOIN (SELECT * FROM forecasts WHERE model_version = 'last_value' AND split = 'test') b USING (entity, ts, horizon) GROUP BY 1",
    ),
)
def _(t: Tables) -> DataFrame:
    test = t.forecasts().filter("split = 'test'")
    out = enrich.compare_forecasts(
        test.filter("model_version = 'same_window_yesterday'"), test.filter("model_version = 'last_value'"), ["entity", "ts", "horizon"]
    )
    return out.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("mapped").alias("mapped_rows"),
        F.count_if("same_target_ts").alias("same_target_rows"), F.count_if("same_actual").alias("same_actual_rows"),
    )


@query(
    "JN9_nearest_event",
    with_ctes("daily", "SELECT d.date, CAST(min(abs(date_diff('day', d.date, e.date))) AS INTEGER) AS days_to_nearest_event FROM daily d LEFT JOIN (SELECT date FROM daily WHERE event_flag = 1) e ON TRUE GROUP BY 1"),
)
def _(t: Tables) -> DataFrame:
    return enrich.nearest_event_days(t.daily(), "date", F.col("event_flag") == 1)


@query(
    "JN10_common_origins",
    with_ctes(
        "forecasts",
        "SELECT entity, ts, count(*) AS rows FROM forecasts WHERE (entity, ts) IN (SELECT (entity, ts) FROM forecasts WHERE model_version = 'last_value' AND horizon = 4 "
        "INTERSECT SELECT (entity, ts) FROM forecasts WHERE model_version = 'same_window_yesterday' AND horizon = 4) GROUP BY 1, 2",
    ),
)
def _(t: Tables) -> DataFrame:
    preds = t.forecasts()
    last = preds.filter("model_version = 'last_value' AND horizon = 4")
    day = preds.filter("model_version = 'same_window_yesterday' AND horizon = 4")
    kept = enrich.restrict(preds, enrich.common_keys([last, day], _KEY), _KEY)
    return kept.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "JN11_partition_rows",
    with_ctes("clean cuts", "SELECT entity, ts, load, 'validation' AS split FROM clean, cuts WHERE ts > train_last AND ts <= val_last"),
)
def _(t: Tables) -> DataFrame:
    from ..operators import splits

    panel = t.clean()
    assigned = splits.assign(panel.select(*_KEY), "ts", t.splits())
    return enrich.attach_partition(panel, assigned, _KEY, "validation").select("entity", "ts", "load", "split")
