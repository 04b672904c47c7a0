"""SQL twins of the derived frames, as named CTEs with dependencies."""

from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (needs, body)


def with_ctes(needs: str, body: str) -> str:
    """``WITH`` clause for the space-separated CTE names and what they build on, then ``body``."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for other in CTES[name][0]:
            visit(other)
        if name not in ordered:
            ordered.append(name)

    for name in needs.split():
        visit(name)
    parts = ", ".join(f"{name} AS ({CTES[name][1]})" for name in ordered)
    text = body.strip()
    if text.upper().startswith("WITH "):
        return f"WITH {parts}, {text[5:]}"
    return f"WITH {parts} {text}"


def r(expr: str, digits: int = 6) -> str:
    """Rounded double without negative zero."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0)"


# Shown means are moved off exact decimal ties before rounding, alike in Spark and SQL.
NUDGE = 2.9e-11


def nudged(expr: str) -> str:
    return r(f"{expr} + CAST({NUDGE} AS DOUBLE)", 9)


GRP = (
    "CASE WHEN {0} IN ('click','view') THEN 'browse' "
    "WHEN {0} IN ('purchase','signup') THEN 'convert' ELSE 'ops' END"
)
LEVEL = (
    "CASE WHEN {0} / ({1} / 2.0) < 0.5 THEN 'Free-flow' WHEN {0} / ({1} / 2.0) < 0.8 THEN 'Moderate' "
    "WHEN {0} / ({1} / 2.0) < 1.0 THEN 'Heavy' ELSE 'Severe' END"
)

cte(
    "observed",
    f"""SELECT event_type AS entity, {GRP.format('event_type')} AS grp,
    time_bucket(INTERVAL '30 minutes', ts) AS ts, min(event_id) AS row_id, count(*) AS volume,
    round(avg(value), 6) AS speed, round(sum(value), 2) AS load,
    CAST(sum(CASE WHEN value >= 150 THEN 1 ELSE 0 END) AS BIGINT) AS incidents
    FROM events GROUP BY 1, 2, 3""",
)
cte(
    "caps",
    "SELECT entity, grp, CAST(round(avg(load) * 3) AS BIGINT) AS capacity FROM observed GROUP BY 1, 2",
    "observed",
)
cte("panel", "SELECT o.*, c.capacity FROM observed o JOIN caps c USING (entity, grp)", "observed", "caps")
cte(
    "steps",
    """SELECT unnest(generate_series(date_trunc('day', min(ts)),
    date_trunc('day', max(ts)) + INTERVAL '1 day' - INTERVAL '30 minutes', INTERVAL '30 minutes')) AS ts
    FROM observed""",
    "observed",
)
cte(
    "grid",
    """SELECT c.entity, c.grp, s.ts, o.row_id, o.volume, o.speed, o.load, o.incidents, c.capacity,
    o.row_id IS NULL AS inserted
    FROM caps c CROSS JOIN steps s LEFT JOIN observed o ON o.entity = c.entity AND o.ts = s.ts""",
    "observed",
    "caps",
    "steps",
)
cte(
    "filled7",
    """SELECT *, coalesce(volume, lag(volume, 48) OVER w) AS v7, coalesce(speed, lag(speed, 48) OVER w) AS s7,
    coalesce(load, lag(load, 48) OVER w) AS l7
    FROM grid WINDOW w AS (PARTITION BY entity ORDER BY ts)""",
    "grid",
)
cte(
    "clean",
    """SELECT entity, grp, ts, row_id, incidents, capacity, inserted,
    last_value(v7 IGNORE NULLS) OVER w AS volume, last_value(s7 IGNORE NULLS) OVER w AS speed,
    last_value(l7 IGNORE NULLS) OVER w AS load
    FROM filled7 WINDOW w AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""",
    "filled7",
)
cte(
    "hourly",
    f"""SELECT {GRP.format('event_type')} AS grp, date_trunc('hour', ts) AS hour,
    CASE WHEN count(*) >= 8 THEN ' RAIN' WHEN count(*) >= 5 THEN 'cloudy' WHEN count(*) >= 3 THEN 'Foggy'
    ELSE 'Clear ' END AS condition, round(avg(value), 6) AS temperature, round(min(value), 2) AS rainfall,
    round(max(value), 2) AS visibility, min(event_id) AS hour_row_id FROM events GROUP BY 1, 2""",
)
cte(
    "hourly_clean",
    """SELECT grp, hour, CASE lower(trim(condition)) WHEN 'rain' THEN 'Rain' WHEN 'cloudy' THEN 'Cloudy'
    WHEN 'foggy' THEN 'Fog' WHEN 'clear' THEN 'Clear' END AS condition, temperature, rainfall, visibility,
    hour_row_id FROM hourly""",
    "hourly",
)
cte(
    "daily",
    """SELECT date, CAST(isodow(date) = 7 AS INTEGER) AS public_holiday,
    CASE WHEN isodow(date) = 7 THEN ' Sunday ' END AS holiday_name,
    CAST(n % 7 = 0 AS INTEGER) AS event_flag, CASE WHEN n % 7 = 0 THEN 'fair' ELSE '  ' END AS event_name,
    CAST(peaks >= 4 AS INTEGER) AS roadwork_flag
    FROM (SELECT CAST(ts AS DATE) AS date, count(*) AS n, count(*) FILTER (value >= 200) AS peaks
    FROM events GROUP BY 1)""",
)
cte(
    "merged",
    """SELECT c.*, h.condition, h.temperature, h.rainfall, h.visibility, h.hour_row_id,
    CASE WHEN h.hour_row_id IS NULL THEN 'left_only' ELSE 'both' END AS hourly_join_status,
    date_trunc('hour', c.ts) AS aligned_hour, CAST(c.ts AS DATE) AS calendar_date,
    d.public_holiday, d.holiday_name, d.event_flag, d.event_name, d.roadwork_flag,
    CASE WHEN d.date IS NULL THEN 'left_only' ELSE 'both' END AS daily_join_status
    FROM clean c LEFT JOIN hourly_clean h ON h.grp = c.grp AND h.hour = date_trunc('hour', c.ts)
    LEFT JOIN daily d ON d.date = CAST(c.ts AS DATE)""",
    "clean",
    "hourly_clean",
    "daily",
)
cte(
    "raw",
    """SELECT event_id AS source_row,
    CASE second(ts) WHEN 1 THEN '  ' WHEN 2 THEN 'unknown' ELSE event_type END AS entity,
    CASE second(ts) WHEN 3 THEN NULL ELSE 's' || CAST(user_id AS VARCHAR) END AS station,
    CASE second(ts) WHEN 4 THEN strftime(ts, '%-d/%-m/%Y') WHEN 5 THEN '2024-02-30' ELSE strftime(ts, '%Y-%m-%d') END AS date,
    CASE second(ts) WHEN 6 THEN strftime(ts, '%H:%M') ELSE strftime(time_bucket(INTERVAL '30 minutes', ts), '%H:%M') END AS time,
    CASE second(ts) WHEN 7 THEN '-5' WHEN 8 THEN '7.5' WHEN 9 THEN 'n/a' WHEN 10 THEN '' ELSE json_extract_string(props, '$.k') END AS volume,
    CASE second(ts) WHEN 11 THEN 'Infinity' ELSE CAST(value AS VARCHAR) END AS speed,
    CASE second(ts) WHEN 12 THEN '{"a": 0.5}' WHEN 13 THEN 'not json' WHEN 14 THEN '{"a": true, "b": 0.5}'
      WHEN 15 THEN '{"a": 1.4, "b": -0.4}' WHEN 16 THEN '{"a": 0.5, "b": 0.4}'
      ELSE '{"a": ' || printf('%.2f', CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100) || ', "b": '
        || printf('%.2f', 1.0 - CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100) || '}' END AS mix,
    CASE second(ts) WHEN 17 THEN '' WHEN 18 THEN ' heavy ' WHEN 19 THEN 'Jammed' ELSE 'Heavy' END AS level,
    CASE WHEN second(ts) = 20 THEN '2' WHEN second(ts) < 30 THEN '1' ELSE '0' END AS flag,
    CASE WHEN second(ts) < 29 OR second(ts) = 31 THEN 'works' END AS flag_name, 'events' AS source_file
    FROM events""",
)

cte(
    "cuts",
    """SELECT max(CASE WHEN rk < n1 THEN ts END) AS train_last, max(CASE WHEN rk < n1 + n2 THEN ts END) AS val_last, max(ts) AS test_last
    FROM (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS rk FROM (SELECT DISTINCT ts FROM clean)),
    (SELECT floor(e1) + CASE WHEN (f2 > f1)::INT + (f3 > f1)::INT < rem THEN 1 ELSE 0 END AS n1,
      floor(e2) + CASE WHEN (f1 >= f2)::INT + (f3 > f2)::INT < rem THEN 1 ELSE 0 END AS n2
      FROM (SELECT *, n - floor(e1) - floor(e2) - floor(e3) AS rem, e1 - floor(e1) AS f1, e2 - floor(e2) AS f2, e3 - floor(e3) AS f3
        FROM (SELECT n, n * CAST(0.7 AS DOUBLE) AS e1, n * CAST(0.15 AS DOUBLE) AS e2, n * CAST(0.15 AS DOUBLE) AS e3
          FROM (SELECT count(DISTINCT ts) AS n FROM clean))))""",
    "clean",
)
SPLIT = "CASE WHEN {0} <= train_last THEN 'train' WHEN {0} <= val_last THEN 'validation' ELSE 'test' END"
SPLIT_END = "CASE WHEN {0} <= train_last THEN train_last WHEN {0} <= val_last THEN val_last ELSE test_last END"
cte(
    "forecasts",
    f"""SELECT entity, ts, horizon, CAST(horizon * 30 AS INTEGER) AS horizon_minutes, target_ts, model_version, actual, prediction,
    {SPLIT.format('ts')} AS split, 'load' AS target, actual - prediction AS residual
    FROM (SELECT entity, ts, CAST(h AS INTEGER) AS horizon, ts + h * INTERVAL '30 minutes' AS target_ts, m AS model_version,
        CASE h WHEN 1 THEN a1 WHEN 2 THEN a2 WHEN 3 THEN a3 ELSE a4 END AS actual,
        CASE WHEN m = 'last_value' THEN load ELSE CASE h WHEN 1 THEN y1 WHEN 2 THEN y2 WHEN 3 THEN y3 ELSE y4 END END AS prediction
      FROM (SELECT entity, ts, load, lead(load, 1) OVER w AS a1, lead(load, 2) OVER w AS a2, lead(load, 3) OVER w AS a3,
          lead(load, 4) OVER w AS a4, lag(load, 47) OVER w AS y1, lag(load, 46) OVER w AS y2, lag(load, 45) OVER w AS y3,
          lag(load, 44) OVER w AS y4 FROM clean WINDOW w AS (PARTITION BY entity ORDER BY ts)),
        (VALUES (1), (2), (3), (4)) hh(h), (VALUES ('last_value'), ('same_window_yesterday')) mm(m)), cuts
    WHERE actual IS NOT NULL AND prediction IS NOT NULL AND target_ts <= {SPLIT_END.format('ts')}""",
    "clean",
    "cuts",
)
cte(
    "context",
    f"""SELECT c.entity, c.ts, CAST(hour(c.ts) AS INTEGER) AS origin_hour, dayname(c.ts) AS weekday,
    CASE WHEN isodow(c.ts) >= 6 THEN 'weekend' ELSE 'weekday' END AS weekday_type,
    CASE WHEN hour(c.ts) BETWEEN 7 AND 9 THEN 'morning_peak' WHEN hour(c.ts) BETWEEN 17 AND 19 THEN 'evening_peak' ELSE 'off_peak' END AS peak_status,
    h.condition, level_h1, level_h2, level_h3, level_h4
    FROM (SELECT entity, grp, ts, lead(level, 1) OVER w AS level_h1, lead(level, 2) OVER w AS level_h2, lead(level, 3) OVER w AS level_h3,
      lead(level, 4) OVER w AS level_h4 FROM (SELECT *, {LEVEL.format('load', 'capacity')} AS level FROM clean)
      WINDOW w AS (PARTITION BY entity ORDER BY ts)) c
    LEFT JOIN hourly_clean h ON h.grp = c.grp AND h.hour = date_trunc('hour', c.ts)""",
    "clean",
    "hourly_clean",
)
cte(
    "leveled",
    f"""SELECT *, {LEVEL.format('load', 'capacity')} AS level, NOT inserted AS observed FROM clean""",
    "clean",
)
_H = (1, 2, 3, 4)
cte(
    "targets",
    "SELECT entity, grp, ts, row_id, incidents, capacity, inserted, volume, speed, load, level, observed, "
    + ", ".join(
        f"target_ts_h{h}, target_load_h{h}, target_load_h{h} IS NOT NULL AS target_load_h{h}_available, target_level_h{h}, "
        f"target_level_h{h} IS NOT NULL AS target_level_h{h}_available, "
        f"CASE WHEN o{h} AND i{h} IS NOT NULL THEN i{h} > 0 END AS target_incident_h{h}, "
        f"coalesce(o{h}, FALSE) AND i{h} IS NOT NULL AS target_incident_h{h}_available"
        for h in _H
    )
    + " FROM (SELECT *, "
    + ", ".join(
        f"lead(ts, {h}) OVER w AS target_ts_h{h}, lead(load, {h}) OVER w AS target_load_h{h}, lead(level, {h}) OVER w AS target_level_h{h}, "
        f"lead(incidents, {h}) OVER w AS i{h}, lead(observed, {h}) OVER w AS o{h}"
        for h in _H
    )
    + " FROM leveled WINDOW w AS (PARTITION BY entity ORDER BY ts))",
    "leveled",
)
cte(
    "target_long",
    " UNION ALL ".join(
        f"SELECT entity, ts, '{n}_h{h}' AS target, '{k}' AS kind, CAST({h} AS INTEGER) AS horizon, target_ts_h{h} AS target_ts, "
        f"target_{n}_h{h}_available AS available, CAST(target_{n}_h{h} AS VARCHAR) AS value FROM targets"
        for h in _H
        for n, k in (("load", "regression"), ("level", "multiclass"), ("incident", "binary"))
    ),
    "targets",
)
_CLASS = "CASE level WHEN 'Free-flow' THEN 0 WHEN 'Moderate' THEN 1 WHEN 'Heavy' THEN 2 ELSE 3 END"
cte(
    "classified",
    f"""SELECT *, CASE WHEN task = 'level' THEN list_position(probabilities, list_max(probabilities)) - 1
      ELSE CAST(probabilities[2] >= operating_threshold AS INTEGER) END AS predicted_class_index,
      CASE WHEN task = 'incident' THEN probabilities[2] END AS event_probability, 'closeness_v1' AS model_version
    FROM (SELECT s.*, {SPLIT.format('ts')} AS split FROM (
      SELECT entity, ts, CAST(h AS INTEGER) AS horizon, CAST(h * 30 AS INTEGER) AS horizon_minutes, ts + h * INTERVAL '30 minutes' AS target_ts, 'level' AS task,
        CASE h WHEN 1 THEN l1 WHEN 2 THEN l2 WHEN 3 THEN l3 ELSE l4 END AS actual_class_index,
        list_transform(ws, lambda w: w / list_sum(ws)) AS probabilities, CAST(NULL AS DOUBLE) AS operating_threshold
      FROM (SELECT *, [CAST(1.0 AS DOUBLE) / (CAST(0.05 AS DOUBLE) * h + abs(use - CAST(0.25 AS DOUBLE))), CAST(1.0 AS DOUBLE) / (CAST(0.05 AS DOUBLE) * h + abs(use - CAST(0.65 AS DOUBLE))),
          CAST(1.0 AS DOUBLE) / (CAST(0.05 AS DOUBLE) * h + abs(use - CAST(0.9 AS DOUBLE))), CAST(1.0 AS DOUBLE) / (CAST(0.05 AS DOUBLE) * h + abs(use - CAST(1.3 AS DOUBLE)))] AS ws FROM lead_classes WHERE use IS NOT NULL)
      UNION ALL
      SELECT entity, ts, CAST(h AS INTEGER), CAST(h * 30 AS INTEGER), ts + h * INTERVAL '30 minutes', 'incident',
        CASE h WHEN 1 THEN e1 WHEN 2 THEN e2 WHEN 3 THEN e3 ELSE e4 END, [1 - p, p], CAST(0.1 AS DOUBLE) + CAST(0.005 AS DOUBLE) * h
      FROM (SELECT *, round(speed / (speed + 400.0 + 50 * h), 3) AS p FROM lead_classes WHERE speed IS NOT NULL)) s, cuts
    WHERE actual_class_index IS NOT NULL AND target_ts <= {SPLIT_END.format('ts')})""",
    "lead_classes",
    "cuts",
)
cte(
    "lead_classes",
    f"""SELECT * FROM (SELECT entity, ts, speed, load / (capacity / 2.0) AS use, """
    + ", ".join(
        f"lead({_CLASS}, {h}) OVER w AS l{h}, lead(CASE WHEN NOT inserted THEN CAST(incidents > 0 AS INTEGER) END, {h}) OVER w AS e{h}" for h in _H
    )
    + " FROM leveled WINDOW w AS (PARTITION BY entity ORDER BY ts)), (VALUES (1), (2), (3), (4)) hh(h)",
    "leveled",
)
cte(
    "scored",
    """SELECT doc_id, lang, source, CAST(quality AS INTEGER) AS actual, round(n_chars / (n_chars + 1500.0), 2) AS score
    FROM labels JOIN documents USING (doc_id)""",
)
cte(
    "in_context",
    "SELECT f.*, c.origin_hour, c.weekday, c.weekday_type, c.peak_status, c.condition, "
    "CASE horizon WHEN 1 THEN level_h1 WHEN 2 THEN level_h2 WHEN 3 THEN level_h3 ELSE level_h4 END AS actual_level "
    "FROM forecasts f LEFT JOIN context c USING (entity, ts)",
    "forecasts",
    "context",
)
cte(
    "paired",
    "SELECT a.entity, a.ts, a.target_ts, a.split, a.horizon, a.horizon_minutes, a.actual, a.prediction AS prediction_first, b.prediction AS prediction_second, "
    "abs(a.prediction - a.actual) AS absolute_error_first, abs(b.prediction - b.actual) AS absolute_error_second "
    "FROM forecasts a JOIN forecasts b USING (entity, ts, target_ts, split, horizon, horizon_minutes) "
    "WHERE a.model_version = 'last_value' AND b.model_version = 'same_window_yesterday'",
    "forecasts",
)
cte(
    "widths",
    """SELECT model_version, target, horizon, horizon_minutes, max(n) AS calibration_rows, max(rk) AS finite_sample_rank,
    max(CASE WHEN rn = rk THEN e END) AS width FROM (SELECT *, least(n, CAST(ceil((n + 1) * CAST(0.9 AS DOUBLE)) AS BIGINT)) AS rk FROM (
      SELECT model_version, target, horizon, horizon_minutes, abs(residual) AS e, count(*) OVER g AS n,
      row_number() OVER (PARTITION BY model_version, target, horizon, horizon_minutes ORDER BY abs(residual)) AS rn
      FROM forecasts WHERE split = 'validation' WINDOW g AS (PARTITION BY model_version, target, horizon, horizon_minutes)))
    GROUP BY 1, 2, 3, 4""",
    "forecasts",
)
