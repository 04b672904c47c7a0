"""Queries over analytical aggregates, registry tables and cross-cutting functions (AG, RT, SO, SE, FN)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions.keyed import durable
from ..functions.order_stats import quantiles
from ..operators import aggregates as ag
from ..operators import clean, enrich, metrics, registry, slices, uncertainty
from . import q_models
from .frames import LEVELS, PLAN, Tables
from .q_metrics import enriched, paired, scored_classes
from .registry import query, tidy
from .sql import LEVEL, cte, nudged, r, with_ctes

DIMS = ("entity", "local_hour", "weekday", "condition", "public_holiday", "event_flag", "roadwork_flag")
_PEAK = "(hour(ts) BETWEEN 7 AND 9 OR hour(ts) BETWEEN 17 AND 19)"
cte(
    "history_rows",
    f"SELECT *, {LEVEL.format('load', 'capacity')} AS level, NOT inserted AS observed, CAST(hour(ts) AS INTEGER) AS local_hour, dayname(ts) AS weekday, {_PEAK} AS is_peak, visibility < 60 AS is_low_visibility FROM merged",
    "merged",
)


def history(t: Tables) -> DataFrame:
    from ..operators import features

    ts = F.col("ts")
    return t.merged().withColumns(
        {
            "level": clean.capacity_band(F.col("load"), F.col("capacity")),
            "observed": ~F.col("inserted"),
            "local_hour": F.hour(ts),
            "weekday": F.date_format(ts, "EEEE"),
            "is_peak": features.peak_columns(ts, PLAN)["is_peak"],
            "is_low_visibility": F.col("visibility") < PLAN.low_visibility_below,
        }
    )


_CTX = " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, coalesce(CAST({d} AS VARCHAR), 'null') AS slice_value, * FROM history_rows" for d in DIMS
)
cte(
    "contexts",
    "SELECT dimension, slice_value, count(*) AS rows, avg(load) AS load_mean, avg(speed) AS speed_mean, quantile_cont(load, 0.5) AS load_median, count(*) FILTER (observed) AS observed_rows, "
    "count(*) FILTER (observed AND incidents > 0) AS positive_rows, count(*) FILTER (observed AND incidents > 0) / nullif(count(*) FILTER (observed), 0) AS positive_rate, "
    + ", ".join(f"count(*) FILTER (level = '{x}') AS level_{x.lower().replace('-', '_')}_rows" for x in LEVELS) + f" FROM ({_CTX}) GROUP BY 1, 2",
    "history_rows",
)


def contexts(t: Tables) -> DataFrame:
    return ag.context_aggregates(history(t), DIMS, "load", ["speed"], "incidents", "observed", "level", LEVELS)


def _n(*names: str) -> str:
    return ", ".join(f"{nudged(x)} AS {x}" for x in names)


@query("AG1_context_aggregates", with_ctes("contexts", f"SELECT * EXCLUDE (load_mean, speed_mean, load_median, positive_rate), {_n('load_mean', 'speed_mean', 'load_median', 'positive_rate')} FROM contexts"))
def _(t: Tables) -> DataFrame:
    return tidy(contexts(t))


_COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "total")
cte("lines", "SELECT *, l_extendedprice * (1 - l_discount) AS total, l_returnflag <> 'N' AS returned FROM lineitem")


def _lines(t: Tables) -> DataFrame:
    return t.lineitem.withColumns(
        {"total": F.col("l_extendedprice") * (1 - F.col("l_discount")), "returned": F.col("l_returnflag") != "N"}
    )


def _matrix(fn: str, name: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {r(f'{fn}({a}, {b})', 5)} AS {name} FROM lines" for i, a in enumerate(_COLS) for b in _COLS[i:]
    )


def _five(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, sc.rounded(F.col(name), 5))


@query("AG2_correlation_matrix", with_ctes("lines", _matrix("corr", "correlation")))
def _(t: Tables) -> DataFrame:
    return _five(ag.correlation_matrix(_lines(t), _COLS), "correlation")


@query("AG3_covariance_matrix", with_ctes("lines", _matrix("covar_samp", "covariance").replace(", 5)", ", 2)")).replace("), 5) + 0) AS covariance", "), 2) + 0) AS covariance"))
def _(t: Tables) -> DataFrame:
    out = ag.covariance_matrix(_lines(t), _COLS)
    return out.withColumn("covariance", sc.rounded(F.col("covariance"), 2))


@query("AG4_redundant_pairs", with_ctes("lines", f"SELECT * FROM ({_matrix('corr', 'correlation')}) WHERE feature_a <> feature_b AND abs(correlation) >= 0.9"))
def _(t: Tables) -> DataFrame:
    return _five(ag.redundant_pairs(ag.correlation_matrix(_lines(t), _COLS), 0.9), "correlation")


_FEATS = ("l_quantity", "l_discount", "l_tax")
cte("target_corr", " UNION ALL ".join(f"SELECT '{f}' AS feature, count({f}) FILTER (returned) AS observations, corr({f}, total) FILTER (returned) AS correlation FROM lines" for f in _FEATS), "lines")


@query("AG5_target_correlations", with_ctes("target_corr", f"SELECT feature, observations, {r('correlation', 5)} AS correlation, CAST(row_number() OVER (ORDER BY abs(correlation) DESC, feature) AS INTEGER) AS rank FROM target_corr"))
def _(t: Tables) -> DataFrame:
    return _five(ag.target_correlations(_lines(t), _FEATS, "total", "returned"), "correlation")


@query(
    "AG6_findings",
    with_ctes(
        "contexts",
        "SELECT (SELECT slice_value FROM contexts WHERE dimension = 'entity' ORDER BY load_mean DESC, 1 LIMIT 1) AS highest_demand_entity, (SELECT slice_value FROM contexts WHERE dimension = 'local_hour' ORDER BY load_mean DESC, 1 LIMIT 1) AS peak_hour, "
        "(SELECT slice_value FROM contexts WHERE dimension = 'condition' ORDER BY speed_mean, 1 LIMIT 1) AS slowest_condition",
    ),
)
def _(t: Tables) -> DataFrame:
    return ag.findings(contexts(t), "load", "speed", "entity", "local_hour", "condition")


@query("AG7_filtered_history", with_ctes("clean", "SELECT entity, ts, load FROM clean WHERE entity IN ('click', 'view') AND ts >= (SELECT date_trunc('day', max(ts)) - INTERVAL '13 days' FROM clean)"))
def _(t: Tables) -> DataFrame:
    panel = t.clean()
    first, last = ag.default_range(panel, "ts")
    return ag.filter_history(panel, "entity", "ts", ["click", "view"], first, last).select("entity", "ts", "load")


@query("AG8_batch_snapshot", with_ctes("history_rows", f"SELECT count(DISTINCT entity) AS entities, count(*) FILTER (level IN ('Heavy', 'Severe')) AS high_class_rows, {_n('mean_value')}, max_value FROM (SELECT *, avg(speed) OVER () AS mean_value, CAST(max(incidents) OVER () AS DOUBLE) AS max_value FROM history_rows) GROUP BY mean_value, max_value".replace(", max_value FROM (", f", {nudged('max_value')} AS max_value FROM (", 1)))
def _(t: Tables) -> DataFrame:
    return tidy(ag.batch_snapshot(history(t), "entity", "level", ["Heavy", "Severe"], "speed", "incidents"))


_CODE = "CASE level WHEN 'Free-flow' THEN 0 WHEN 'Moderate' THEN 1 WHEN 'Heavy' THEN 2 ELSE 3 END"


@query("AG9_severity_matrix", with_ctes("leveled", f"SELECT entity, array_to_string(list({_CODE} ORDER BY ts), ',') AS cells FROM leveled WHERE ts IN (SELECT DISTINCT ts FROM leveled ORDER BY ts DESC LIMIT 96) GROUP BY 1"))
def _(t: Tables) -> DataFrame:
    rows = t.clean().withColumn("level", clean.capacity_band(F.col("load"), F.col("capacity")))
    out = ag.severity_matrix(rows, "entity", "ts", "level", LEVELS)
    return out.select("entity", F.array_join(F.transform("cells", lambda c: c["severity"].cast("string")), ",").alias("cells"))


cte(
    "summary_rows",
    "SELECT entity, grp, avg(load) AS mean_demand, max(load) AS peak_demand, avg(speed) AS mean_speed, avg(volume) AS mean_volume, avg(CAST(level = 'Severe' AS INTEGER)) AS severe_share, count(*) FILTER (incidents > 0) AS event_windows, count(*) AS windows FROM leveled GROUP BY 1, 2",
    "leveled",
)


def _summary(t: Tables) -> DataFrame:
    rows = t.clean().withColumn("level", clean.capacity_band(F.col("load"), F.col("capacity")))
    return ag.entity_summary(rows, ["entity", "grp"], "load", ["speed", "volume"], "level", "Severe", "incidents")


@query("AG10_entity_summary", with_ctes("summary_rows", f"SELECT entity, grp, event_windows, windows, {_n('mean_demand', 'peak_demand', 'mean_speed', 'mean_volume', 'severe_share')} FROM summary_rows"))
def _(t: Tables) -> DataFrame:
    return tidy(_summary(t))


def _importance(t: Tables) -> DataFrame:
    """Importance per flag (the task) and feature: absolute correlations in one aggregation over all flags."""
    lines = _lines(t).groupBy(F.col("l_returnflag").alias("task")).agg(*[F.abs(F.corr(f, "total")).alias(f) for f in _FEATS])
    long = lines.select("task", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("importance")) for f in _FEATS])).alias("x"))
    place = F.row_number().over(Window.partitionBy("task").orderBy(F.col("x.importance").desc(), "x.feature"))
    return long.select("task", F.lit(1).alias("horizon"), "x.feature", place.cast("int").alias("rank"), "x.importance")


@query(
    "AG11_top_features",
    with_ctes(
        "lines",
        f"SELECT task, CAST(1 AS INTEGER) AS horizon, feature, rank, {r('importance', 5)} AS importance FROM (SELECT *, CAST(row_number() OVER (PARTITION BY task ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM ("
        + " UNION ALL ".join(f"SELECT l_returnflag AS task, '{f}' AS feature, abs(corr({f}, total)) AS importance FROM lines GROUP BY 1" for f in _FEATS)
        + ")) WHERE rank <= 2",
    ),
)
def _(t: Tables) -> DataFrame:
    return _five(ag.top_features_by_task(_importance(t), ["task", "horizon"], 2), "importance")


@query("AG12_half_hour_profile", with_ctes("clean", f"SELECT entity, time_of_day, {_n('mean_load', 'mean_speed')} FROM (SELECT entity, strftime(ts, '%H:%M') AS time_of_day, avg(load) AS mean_load, avg(speed) AS mean_speed FROM clean GROUP BY 1, 2)"))
def _(t: Tables) -> DataFrame:
    return tidy(ag.half_hour_profile(t.clean(), "entity", "ts", ["load", "speed"]))


_SIX = ("load", "speed", "volume", "rainfall", "visibility", "temperature")


@query(
    "AG13_condition_summary",
    with_ctes(
        "history_rows",
        f"SELECT condition, windows, {_n(*[f'mean_{m}' for m in _SIX], 'event_rate')} FROM (SELECT condition, count(*) AS windows, " + ", ".join(f"avg({m}) AS mean_{m}" for m in _SIX)
        + ", avg(CAST(coalesce(incidents > 0, FALSE) AS INTEGER)) AS event_rate FROM history_rows WHERE condition IS NOT NULL GROUP BY 1)",
    ),
)
def _(t: Tables) -> DataFrame:
    return tidy(ag.condition_summary(history(t), "condition", _SIX, "incidents"))


def _batch(t: Tables) -> DataFrame:
    """Test-split batch: last-value demand with event probability per entity, origin and horizon."""
    demand = t.forecasts().filter("split = 'test' AND model_version = 'last_value'").select("entity", "ts", "horizon", "prediction")
    events = t.classified().filter("split = 'test' AND task = 'incident'").select("entity", "ts", "horizon", "event_probability")
    return demand.join(events, ["entity", "ts", "horizon"])


cte("batch", "SELECT f.entity, f.ts, f.horizon, f.prediction, c.event_probability FROM (SELECT * FROM forecasts WHERE split = 'test' AND model_version = 'last_value') f JOIN (SELECT * FROM classified WHERE split = 'test' AND task = 'incident') c USING (entity, ts, horizon)", "forecasts", "classified")


def _best(measure: str) -> str:
    return f"SELECT ts, horizon, entity, {measure} FROM (SELECT *, row_number() OVER (PARTITION BY ts, horizon ORDER BY {measure} DESC, entity) AS rn FROM batch) WHERE rn = 1"


@query("AG14_top_risk_per_horizon", with_ctes("batch", f"SELECT * FROM ({_best('event_probability')}) a JOIN (SELECT ts, horizon, entity AS busiest, prediction AS busiest_prediction FROM ({_best('prediction')})) b USING (ts, horizon)"))
def _(t: Tables) -> DataFrame:
    batch = _batch(t)
    risk = ag.top_per_group(batch, ["ts", "horizon"], "event_probability", "entity", ["entity", "event_probability"])
    busy = ag.top_per_group(batch, ["ts", "horizon"], "prediction", "entity", ["entity", "prediction"])
    return risk.join(busy.select("ts", "horizon", F.col("entity").alias("busiest"), F.col("prediction").alias("busiest_prediction")), ["ts", "horizon"])


@query("AG15_class_counts", with_ctes("classified", "SELECT horizon, predicted_class_index, count(*) AS entities FROM classified WHERE task = 'level' AND split = 'test' GROUP BY 1, 2"))
def _(t: Tables) -> DataFrame:
    return ag.class_counts(t.classified().filter("task = 'level' AND split = 'test'"), ["horizon"], "predicted_class_index")


@query("AG15b_batch_totals", with_ctes("batch", f"SELECT entities, horizons, rows, {_n('mean_prediction', 'mean_event_probability')} FROM (SELECT count(DISTINCT entity) AS entities, count(DISTINCT horizon) AS horizons, count(*) AS rows, avg(prediction) AS mean_prediction, avg(event_probability) AS mean_event_probability FROM batch)"))
def _(t: Tables) -> DataFrame:
    return tidy(ag.batch_totals(_batch(t), "entity", "horizon", ["prediction", "event_probability"]))


@query("AG16_class_shares", with_ctes("leveled", f"SELECT level, rows, {_n('share')} FROM (SELECT level, count(*) AS rows, count(*) / (SELECT count(*) FROM leveled) AS share FROM leveled GROUP BY 1)"))
def _(t: Tables) -> DataFrame:
    return tidy(ag.class_shares(t.clean().withColumn("level", clean.capacity_band(F.col("load"), F.col("capacity"))), "level"))


@query("AG16b_pressure_ranking", with_ctes("leveled", f"SELECT entity, {_n('pressure')} FROM (SELECT entity, avg(CAST(level IN ('Heavy', 'Severe') AS INTEGER)) AS pressure FROM leveled GROUP BY 1)"))
def _(t: Tables) -> DataFrame:
    rows = t.clean().withColumn("level", clean.capacity_band(F.col("load"), F.col("capacity")))
    return tidy(ag.pressure_ranking(rows, "entity", "level", ["Heavy", "Severe"]))


@query(
    "AG17_peak_and_slowest",
    with_ctes(
        "history_rows",
        f"SELECT peak_entity, peak_ts, {_n('peak_load')}, slowest, {_n('slowest_speed', 'peak_share')} FROM (SELECT entity AS peak_entity, ts AS peak_ts, load AS peak_load FROM history_rows WHERE load IS NOT NULL ORDER BY load DESC, entity, ts LIMIT 1), "
        "(SELECT entity AS slowest, avg(speed) AS slowest_speed FROM history_rows GROUP BY 1 ORDER BY 2, 1 LIMIT 1), (SELECT avg(CAST(is_peak AS INTEGER)) AS peak_share FROM history_rows)",
    ),
)
def _(t: Tables) -> DataFrame:
    rows = history(t)
    peak = ag.peak_row(rows, "load", ["entity", "ts"]).select(
        F.col("entity").alias("peak_entity"), F.col("ts").alias("peak_ts"), F.col("load").alias("peak_load")
    )
    slow = ag.slowest_entity(rows, "entity", "speed").select(F.struct("*")).scalar()
    share = rows.agg(ag.share(F.col("is_peak"))).scalar()
    return tidy(
        peak.select("*", slow["entity"].alias("slowest"), slow["mean_speed"].alias("slowest_speed"), share.alias("peak_share"))
    )


@query(
    "AG18_condition_contrast",
    with_ctes(
        "history_rows",
        f"SELECT windows, conditions, {_n('rain_share', 'low_visibility_share', 'rain_speed', 'dry_speed')}, {nudged('rain_speed - dry_speed')} AS speed_difference FROM (SELECT count(*) AS windows, count(DISTINCT condition) AS conditions, avg(CAST(coalesce(rainfall > 20, FALSE) AS INTEGER)) AS rain_share, "
        "avg(CAST(coalesce(is_low_visibility, FALSE) AS INTEGER)) AS low_visibility_share, avg(speed) FILTER (coalesce(rainfall > 20, FALSE)) AS rain_speed, avg(speed) FILTER (NOT coalesce(rainfall > 20, FALSE)) AS dry_speed FROM history_rows)",
    ),
)
def _(t: Tables) -> DataFrame:
    return tidy(ag.condition_contrast(history(t), F.col("rainfall") > 20, F.col("is_low_visibility"), "speed", "condition"))


@query(
    "AG19_calibration_summary",
    with_ctes(
        "rel",
        f"SELECT horizon, {r('e')} AS expected_calibration_error, populated_bins, row_number() OVER (ORDER BY e DESC, horizon) = 1 AS is_worst FROM (SELECT horizon, max(ece) AS e, count(*) FILTER (rows > 0) AS populated_bins FROM rel WHERE task = 'level' AND split = 'test' GROUP BY 1)",
    ),
)
def _(t: Tables) -> DataFrame:
    rows = uncertainty.reliability_rows(t.classified().filter("task = 'level' AND split = 'test'"))
    return ag.calibration_summary(uncertainty.reliability_table(rows, ["horizon"], 10), ["horizon"])


@query(
    "AG20_latest_window_rmse",
    with_ctes(
        "paired",
        f"SELECT entity, horizon, rows, {_n('rmse_first', 'rmse_second')} FROM (SELECT entity, horizon, count(*) AS rows, sqrt(avg((prediction_first - actual) * (prediction_first - actual))) AS rmse_first, sqrt(avg((prediction_second - actual) * (prediction_second - actual))) AS rmse_second "
        "FROM (SELECT *, row_number() OVER (PARTITION BY entity, horizon ORDER BY ts DESC) AS rn FROM paired) WHERE rn <= 192 GROUP BY 1, 2)",
    ),
)
def _(t: Tables) -> DataFrame:
    return tidy(ag.latest_window_rmse(paired(t), ["entity", "horizon"], "ts"))


@query("AG21_priority_queue", with_ctes("batch", "SELECT entity, ts, horizon, event_probability, prediction FROM batch ORDER BY event_probability DESC, prediction DESC, entity, ts, horizon"))
def _(t: Tables) -> DataFrame:
    batch = _batch(t).withColumn("tie", F.struct("entity", "ts", "horizon"))
    return ag.priority_queue(batch, "event_probability", "prediction", "tie").select("entity", "ts", "horizon", "event_probability", "prediction")


@query(
    "AG21b_slowest_entity",
    with_ctes("clean", "SELECT ts, entity AS slowest, speed AS slowest_speed FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY speed, entity) AS rn FROM clean WHERE speed IS NOT NULL) WHERE rn = 1"),
)
def _(t: Tables) -> DataFrame:
    return ag.slowest_in_group(t.clean(), ["ts"], "speed", "entity")


@query(
    "AG22_best_picks",
    with_ctes(
        "summary_rows",
        "SELECT (SELECT count(*) FROM summary_rows) AS compared, (SELECT entity FROM summary_rows ORDER BY mean_demand DESC, 1 LIMIT 1) AS busiest, (SELECT entity FROM summary_rows ORDER BY mean_speed DESC, 1 LIMIT 1) AS fastest, (SELECT entity FROM summary_rows ORDER BY severe_share DESC, 1 LIMIT 1) AS most_severe",
    ),
)
def _(t: Tables) -> DataFrame:
    return ag.best_picks(_summary(t), "entity")


# -- registry ------------------------------------------------------------------------------------
_RMSE = r("sqrt(avg((prediction - actual) * (prediction - actual)))", 10)
_MAE = r("avg(abs(prediction - actual))", 10)
cte(
    "job_metrics",
    f"""SELECT 'load' AS target, model_version || '_h' || horizon AS job_id, split, unnest(['rmse', 'mae']) AS metric, unnest([rmse, mae]) AS value
    FROM (SELECT model_version, horizon, split, {_RMSE} AS rmse, {_MAE} AS mae FROM forecasts GROUP BY 1, 2, 3)""",
    "forecasts",
)
cte("thresholds", "SELECT 'load' AS target, 'rmse' AS metric, 'less_than_or_equal' AS operator, round(max(value) * 0.95, 6) AS threshold FROM job_metrics WHERE metric = 'rmse' AND split = 'test'", "job_metrics")
cte("decided", "SELECT m.*, operator, threshold, CASE operator WHEN 'less_than_or_equal' THEN value <= threshold END AS met FROM (SELECT * FROM job_metrics WHERE split = 'test') m LEFT JOIN thresholds USING (target, metric)", "job_metrics", "thresholds")


def _job_metrics(t: Tables) -> DataFrame:
    per = metrics.regression_metrics(t.forecasts(), ["model_version", "horizon", "split"])
    long = registry.unpivot_metrics(per, ["model_version", "horizon", "split"], ["rmse", "mae"])
    return long.select(
        F.lit("load").alias("target"), F.concat("model_version", F.lit("_h"), F.col("horizon").cast("string")).alias("job_id"), "split", "metric", "value"
    )


def _decided(t: Tables) -> DataFrame:
    test = _job_metrics(t).filter("split = 'test'")
    limits = test.filter("metric = 'rmse'").groupBy("target", "metric").agg(F.round(F.max("value") * 0.95, 6).alias("threshold"))
    return registry.acceptance(test, limits.withColumn("operator", F.lit(registry.AT_MOST)))


@query("RT1_acceptance", with_ctes("decided", "SELECT target, job_id, metric, value, threshold, met FROM decided"))
def _(t: Tables) -> DataFrame:
    return _decided(t).select("target", "job_id", "metric", "value", "threshold", "met")


@query("RT1b_acceptance_summary", with_ctes("decided", "SELECT target, count(*) AS evaluated, count(*) FILTER (met) AS met_jobs, bool_and(met) AS all_met FROM decided WHERE met IS NOT NULL GROUP BY 1"))
def _(t: Tables) -> DataFrame:
    return registry.acceptance_summary(_decided(t))


@query("AG23_acceptance_kpis", with_ctes("decided", "SELECT target, count(*) AS jobs, count(*) FILTER (met) AS met_jobs, bool_and(coalesce(met, FALSE)) AS all_met FROM decided WHERE metric = 'rmse' GROUP BY 1"))
def _(t: Tables) -> DataFrame:
    return ag.acceptance_kpis(_decided(t).filter("metric = 'rmse'"))


@query(
    "AG24_coverage_kpis",
    with_ctes(
        "enriched",
        f"""SELECT target, count(*) AS groups, {nudged('avg(c)')} AS mean_coverage, {nudged('CAST(0.9 AS DOUBLE)')} AS nominal, max(CASE WHEN rn = 1 THEN horizon END) AS lowest_horizon, max(CASE WHEN rn = 1 THEN model_version END) AS lowest_model, {nudged('min(c)')} AS lowest_coverage
        FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY c, horizon, model_version) AS rn FROM (SELECT target, horizon, model_version, {r('avg(CAST(interval_covered AS INTEGER))', 10)} AS c FROM enriched WHERE split = 'test' AND horizon IN (1, 2, 3) GROUP BY 1, 2, 3)) GROUP BY 1""",
    ),
)
def _(t: Tables) -> DataFrame:
    table = slices.regression_coverage(enriched(t), ["model_version", "target", "horizon", "split"])
    table = table.withColumn("interval_coverage", sc.rounded(F.col("interval_coverage"), 10))
    return tidy(ag.coverage_kpis(table, [1, 2, 3]))


@query(
    "RT2_scoreboard",
    with_ctes(
        "job_metrics",
        "SELECT job_id, 'rmse' AS primary_metric, max(CASE WHEN split = 'validation' THEN value END) AS validation_primary_metric, max(CASE WHEN split = 'test' THEN value END) AS test_primary_metric, TRUE AS finite FROM job_metrics WHERE metric = 'rmse' GROUP BY 1",
    ),
)
def _(t: Tables) -> DataFrame:
    values = _job_metrics(t)
    jobs = values.select("job_id").distinct().withColumn("primary_metric", F.lit("rmse"))
    return registry.scoreboard(jobs, values.select("job_id", "split", "metric", "value"))


cte("job_rows", "SELECT model_version || '_h' || horizon AS job_id, split FROM forecasts", "forecasts")


def _job_rows(t: Tables) -> DataFrame:
    return t.forecasts().select(F.concat("model_version", F.lit("_h"), F.col("horizon").cast("string")).alias("job_id"), "split")


@query("RT3_prediction_index", with_ctes("job_rows", "SELECT job_id, count(*) FILTER (split = 'validation') AS validation_rows, count(*) FILTER (split = 'test') AS test_rows, count(*) FILTER (split <> 'train') AS total_rows FROM job_rows GROUP BY 1"))
def _(t: Tables) -> DataFrame:
    return registry.prediction_index(_job_rows(t))


@query("RT3b_index_problems", with_ctes("job_rows", "SELECT DISTINCT job_id, 'unregistered' AS problem FROM job_rows WHERE job_id LIKE '%_h4' UNION ALL SELECT DISTINCT job_id || '0', 'no_predictions' FROM job_rows WHERE job_id LIKE '%_h1'"))
def _(t: Tables) -> DataFrame:
    index = registry.prediction_index(_job_rows(t))
    jobs = index.select("job_id")
    extra = jobs.filter("job_id LIKE '%_h1'").select(F.concat("job_id", F.lit("0")).alias("job_id"))
    return registry.index_problems(index, jobs.filter("job_id NOT LIKE '%_h4'").unionByName(extra))


@query(
    "RT4_route_requests",
    "SELECT event_id, event_type, CAST(1 + user_id % 5 AS INTEGER) AS horizon, CASE WHEN user_id % 5 = 4 THEN 0 WHEN user_id % 5 = 3 AND event_type = 'view' THEN 2 ELSE 1 END AS candidates, "
    "CASE WHEN user_id % 5 = 4 OR (user_id % 5 = 3 AND event_type = 'view') THEN NULL ELSE 'model_' || event_type || '_' || (1 + user_id % 5) END AS model, NOT (user_id % 5 = 4 OR (user_id % 5 = 3 AND event_type = 'view')) AS routed FROM events".replace("THEN 0 WHEN", "THEN CAST(0 AS BIGINT) WHEN"),
)
def _(t: Tables) -> DataFrame:
    horizon = (F.pmod("user_id", F.lit(5)) + 1).cast("int")
    requests = t.events.select("event_id", "event_type", horizon.alias("horizon"))
    kinds = t.events.select("event_type").distinct()
    entries = kinds.select("event_type", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("horizon"))
    entries = entries.withColumn("model", F.concat(F.lit("model_"), "event_type", F.lit("_"), F.col("horizon").cast("string")))
    twice = entries.filter("horizon = 4 AND event_type = 'view'")
    return registry.route(requests, entries.unionByName(twice), ["event_type", "horizon"]).select(
        "event_id", "event_type", "horizon", "candidates", "model", "routed"
    )


_VERSIONS = {"registry_version": "registry_v1", "confidence_version": "confidence_v1"}


def _served(t: Tables) -> DataFrame:
    numbers = enriched(t).filter("split = 'test' AND model_version = 'last_value'").withColumnRenamed("ts", "origin")
    marks = scored_classes(t).filter("split = 'test'").withColumnRenamed("ts", "origin")
    return registry.served_batch(numbers, marks, ["load"], LEVELS, _VERSIONS)


cte(
    "served",
    "SELECT f.entity, f.ts AS origin, f.horizon, f.prediction AS load_prediction, f.interval_lower AS load_interval_lower, f.interval_upper AS load_interval_upper, f.model_version AS load_model_version, l.probabilities AS ps, "
    "l.predicted_class_index AS pi, l.confidence_band AS level_confidence_band, i.event_probability, 1 - i.event_probability AS no_event_probability, i.operating_threshold, i.confidence_band AS event_confidence_band, i.risk_band AS event_risk_band "
    "FROM (SELECT * FROM enriched WHERE split = 'test' AND model_version = 'last_value') f JOIN (SELECT entity, ts, horizon FROM cls_ctx WHERE split = 'test' GROUP BY 1, 2, 3) k USING (entity, ts, horizon) "
    "LEFT JOIN (SELECT * FROM cls_ctx WHERE task = 'level' AND split = 'test') l USING (entity, ts, horizon) LEFT JOIN (SELECT * FROM cls_ctx WHERE task = 'incident' AND split = 'test') i USING (entity, ts, horizon)",
    "enriched",
    "cls_ctx",
)
_NAME = "CASE pi " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(LEVELS)) + " END"


@query(
    "RT5_served_batch",
    with_ctes(
        "served",
        f"SELECT entity, origin, horizon, load_model_version, level_confidence_band, event_confidence_band, event_risk_band, {_NAME} AS level_prediction, 'registry_v1' AS registry_version, 'confidence_v1' AS confidence_version, "
        + _n("load_prediction", "load_interval_lower", "load_interval_upper", "event_probability", "no_event_probability", "operating_threshold") + ", " + ", ".join(f"{nudged(f'ps[{i + 1}]')} AS probability_{i}" for i in range(4)) + " FROM served",
    ),
)
def _(t: Tables) -> DataFrame:
    return tidy(_served(t))


def served_models(t: Tables) -> DataFrame:
    """Both targets by their chosen models with conformal intervals, beside the calibrated class models."""
    numbers = q_models.served_numbers(t)
    widths = uncertainty.conformal_widths(numbers, 0.9)
    numbers = enrich.attach_width(numbers, widths, uncertainty.CALIBRATION_KEY).withColumns(uncertainty.interval_columns())
    marks = q_models.class_marks(t).filter("split = 'test'").withColumnRenamed("ts", "origin")
    return registry.served_batch(numbers.filter("split = 'test'").withColumnRenamed("ts", "origin"), marks, ["load", "speed"], LEVELS, _VERSIONS)


@query("RT5b_served_models")
def _(t: Tables) -> DataFrame:
    return t.kept("served_models", lambda: tidy(served_models(t)))


@query(
    "RT6b_served_models_contract",
    "SELECT v.x AS rule, CAST(0 AS BIGINT) AS violations FROM (VALUES ('non_finite'),('negative'),('interval_order'),('probability_range'),('level_sum'),('event_sum'),"
    "('level_vocabulary'),('risk_vocabulary'),('confidence_vocabulary'),('missing_lineage'),('duplicate_keys'),('row_count')) v(x)",
)
def _(t: Tables) -> DataFrame:
    """The rules over the rows that the chosen models served, counted against the requests."""
    batch = t.kept("served_models", lambda: tidy(served_models(t)))
    asked = q_models.job_table(t).filter("split = 'test'").select(
        F.explode(F.array(*[F.when(F.col("labels")[i].isNotNull() | F.col("labels")[i + 4].isNotNull(), F.lit(1)) for i in range(4)])).alias("x")
    )
    wanted = asked.agg(F.count("x")).scalar()
    versions = [f"{x}_model_version" for x in ("load", "speed")]
    return registry.output_contract(batch, ["load", "speed"], LEVELS, [*versions, *_VERSIONS], wanted)


@query(
    "RT6_output_contract",
    with_ctes(
        "served",
        "SELECT v.x AS rule, CASE WHEN v.x = 'event_sum' THEN no_event WHEN v.x IN ('risk_vocabulary', 'confidence_vocabulary') THEN no_event ELSE 0 END AS violations FROM (SELECT count(*) FILTER (event_probability IS NULL) AS no_event FROM served), (VALUES ('non_finite'),('negative'),('interval_order'),"
        "('probability_range'),('level_sum'),('event_sum'),('level_vocabulary'),('risk_vocabulary'),('confidence_vocabulary'),('missing_lineage'),('duplicate_keys'),('row_count')) v(x)",
    ),
)
def _(t: Tables) -> DataFrame:
    batch = durable(_served(t))
    wanted = batch.agg(F.count(F.lit(1))).scalar()
    return registry.output_contract(batch, ["load"], LEVELS, ["load_model_version", *_VERSIONS], wanted)


@query(
    "RT6c_violated_contract",
    with_ctes(
        "served",
        "SELECT v.x AS rule, CAST(CASE v.x WHEN 'non_finite' THEN c3 WHEN 'negative' THEN c1 + c3 WHEN 'interval_order' THEN c1 + c2 + c3 WHEN 'probability_range' THEN c3 WHEN 'level_sum' THEN c3 "
        "WHEN 'level_vocabulary' THEN c1 WHEN 'missing_lineage' THEN c2 WHEN 'duplicate_keys' THEN c4 WHEN 'row_count' THEN c4 ELSE e END AS BIGINT) AS violations FROM "
        "(SELECT count(*) FILTER (horizon = 1) AS c1, count(*) FILTER (horizon = 2) AS c2, count(*) FILTER (horizon = 3) AS c3, count(*) FILTER (horizon = 4) AS c4, "
        "count(*) FILTER (event_probability IS NULL) + count(*) FILTER (event_probability IS NULL AND horizon = 4) AS e FROM served), (VALUES ('non_finite'),('negative'),('interval_order'),"
        "('probability_range'),('level_sum'),('event_sum'),('level_vocabulary'),('risk_vocabulary'),('confidence_vocabulary'),('missing_lineage'),('duplicate_keys'),('row_count')) v(x)",
    ),
)
def _(t: Tables) -> DataFrame:
    """A batch with a defect of its own at every horizon; each rule counts its rows."""
    good = durable(_served(t))
    h = F.col("horizon")
    bad = good.withColumns({
        "load_prediction": F.when(h == 1, -5.0).otherwise(F.col("load_prediction")),
        "level_prediction": F.when(h == 1, "Odd").otherwise(F.col("level_prediction")),
        "load_interval_lower": F.when(h == 2, F.col("load_prediction") + 1).otherwise(F.col("load_interval_lower")),
        "load_model_version": F.when(h != 2, F.col("load_model_version")),
        "probability_0": F.when(h == 3, 1.5).otherwise(F.col("probability_0")),
        "load_interval_upper": F.when(h != 3, F.col("load_interval_upper")),
    })
    bad = bad.unionByName(bad.filter("horizon = 4"))
    return registry.output_contract(bad, ["load"], LEVELS, ["load_model_version", *_VERSIONS], F.lit(good.count()))


@query(
    "RT7_request_ids",
    "SELECT o_orderkey, substr(sha256('{\"customer\":' || o_custkey || ',\"inference_version\":\"v1\",\"priority\":\"' || o_orderpriority || '\"}'), 1, 16) AS request_id FROM orders",
)
def _(t: Tables) -> DataFrame:
    asked = t.orders.select("o_orderkey", F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("priority"))
    return registry.request_ids(asked, ["customer", "priority"], "v1").select("o_orderkey", "request_id")


@query(
    "RT8_compare_metrics",
    with_ctes(
        "job_metrics",
        "SELECT coalesce(a.job_id, b.job_id) AS job_id, coalesce(a.metric, b.metric) AS metric, round(abs(a.value - b.value), 6) + 0 AS delta, coalesce(abs(a.value - b.value) <= greatest(1e-9, 1e-9 * greatest(abs(a.value), abs(b.value))), FALSE) AS same FROM "
        "(SELECT * FROM job_metrics WHERE split = 'test') a FULL JOIN (SELECT job_id, metric, CASE WHEN metric = 'mae' THEN value + 0.5 ELSE value END AS value FROM job_metrics WHERE split = 'test' AND job_id NOT LIKE '%_h4') b ON a.job_id = b.job_id AND a.metric = b.metric",
    ),
)
def _(t: Tables) -> DataFrame:
    test = _job_metrics(t).filter("split = 'test'").select("job_id", "metric", "value")
    moved = F.when(F.col("metric") == "mae", F.col("value") + 0.5).otherwise(F.col("value"))
    other = test.filter("job_id NOT LIKE '%_h4'").withColumn("value", moved)
    out = registry.compare_metrics(test, other, ["job_id"], 1e-9)
    return out.select("job_id", "metric", sc.rounded(F.col("delta")).alias("delta"), "same")


@query(
    "RT9_flattened_records",
    "SELECT o_orderkey, o_orderstatus AS status, '{\"total\":' || CAST(o_custkey AS VARCHAR) || ',\"priority\":\"' || o_orderpriority || '\"}' AS detail, '[' || o_custkey || ',' || o_orderkey || ']' AS ids FROM orders",
)
def _(t: Tables) -> DataFrame:
    record = F.struct(
        F.col("o_orderstatus").alias("status"),
        F.struct(F.col("o_custkey").alias("total"), F.col("o_orderpriority").alias("priority")).alias("detail"),
        F.array("o_custkey", "o_orderkey").alias("ids"),
    )
    return registry.flatten_records(t.orders.select("o_orderkey", record.alias("rec")), "rec")


# -- sorts, set operations, functions --------------------------------------------------------------


@query("SO1_stable_sort", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem")
def _(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SO2_mixed_direction_sort", "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders ORDER BY o_totalprice DESC, o_orderdate, o_orderkey")
def _(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice", "o_orderdate").orderBy(F.desc("o_totalprice"), F.asc("o_orderdate"), "o_orderkey")


@query(
    "SO3_head_and_tail",
    "SELECT 'head' AS side, * FROM (SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT 192) UNION ALL SELECT 'tail', * FROM (SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 192)",
)
def _(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "ts")
    head = rows.orderBy("ts", "event_id").limit(192).withColumn("side", F.lit("head"))
    tail = rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(192).withColumn("side", F.lit("tail"))
    return head.unionByName(tail)


@query(
    "SE1_union_by_name",
    "SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier",
)
def _(t: Tables) -> DataFrame:
    left = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    right = t.supplier.select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return left.unionByName(right, allowMissingColumns=True)


@query("SE2_distinct", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def _(t: Tables) -> DataFrame:
    return t.lineitem.select("l_partkey", "l_suppkey").dropDuplicates()


@query("SE3_key_difference", "SELECT o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(t: Tables) -> DataFrame:
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.join(lines, "o_orderkey", "left_anti").select(F.col("o_orderkey").alias("key"))


@query(
    "FN1_string_functions",
    "SELECT p_partkey, lower(trim(p_type)) AS folded, regexp_full_match(p_brand, 'Brand#[1-3]\\d') AS low_brand, regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '_', 'g') AS slug, replace(p_name, ' ', '-') AS dashed, p_brand || '|' || upper(p_type) AS joined FROM part",
)
def _(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey", F.lower(F.trim("p_type")).alias("folded"), F.col("p_brand").rlike(r"^Brand#[1-3]\d$").alias("low_brand"),
        sc.slug(F.col("p_type")).alias("slug"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("dashed"),
        F.array_join(F.array("p_brand", F.upper("p_type")), "|").alias("joined"),
    )


@query(
    "FN2_time_functions",
    "SELECT event_id, date_trunc('hour', ts) AS hour, CAST(ts AS DATE) AS day, date_trunc('day', ts) AS midnight, ts + INTERVAL '90 minutes' AS later, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, dayname(ts) AS day_name, strftime(ts, '%H:%M') AS clock, date_trunc('day', ts) AS parsed, "
    "ts + INTERVAL '330 minutes' AS kolkata FROM events",
)
def _(t: Tables) -> DataFrame:
    text = F.date_format("ts", "dd/MM/yyyy")
    zone = F.convert_timezone(F.lit("UTC"), F.lit("Asia/Kolkata"), F.col("ts"))
    return t.events.select(
        "event_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), F.to_date("ts").alias("day"),
        F.to_date("ts").cast("timestamp_ntz").alias("midnight"), (F.col("ts") + F.expr("INTERVAL 90 MINUTE")).alias("later"),
        F.weekday("ts").alias("weekday"), F.date_format("ts", "EEEE").alias("day_name"), F.date_format("ts", "HH:mm").alias("clock"),
        F.try_to_timestamp(text, F.lit("dd/MM/yyyy")).cast("timestamp_ntz").alias("parsed"), zone.alias("kolkata"),
    )


@query(
    "FN3_math_functions",
    f"SELECT event_id, {r('sin(value)')} AS sine, {r('cos(value)')} AS cosine, {r('sqrt(CASE WHEN value >= 0 THEN value END)')} AS root, abs(value - 50) AS distance, {r('ln(CASE WHEN value > -1 THEN value + 1 END)')} AS log1, CAST(ceil(value) AS BIGINT) AS up, CAST(floor(value) AS BIGINT) AS down, round(value, 1) AS near, "
    f"least(greatest(value, 10), 100) AS clipped, abs(value - round(value)) <= 0.05 + 1e-5 * abs(round(value)) AS whole, {r('value % 7')} AS rest FROM events".replace("round(value, 1) AS near", "floor(value * 2) / 2 AS near"),
)
def _(t: Tables) -> DataFrame:
    v = F.col("value")
    return t.events.select(
        "event_id", sc.rounded(F.sin(v)).alias("sine"), sc.rounded(F.cos(v)).alias("cosine"), sc.rounded(F.sqrt(F.when(v >= 0, v))).alias("root"),
        F.abs(v - 50).alias("distance"), sc.rounded(F.log(F.when(v > -1, v + 1))).alias("log1"), F.ceil(v).alias("up"), F.floor(v).alias("down"),
        (F.floor(v * 2) / 2).alias("near"), F.least(F.greatest(v, F.lit(10.0)), F.lit(100.0)).alias("clipped"),
        sc.close_to(v, F.round(v), 1e-5, 0.05).alias("whole"), sc.rounded(v % 7).alias("rest"),
    )


@query(
    "FN4_conditional_functions",
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount > 0.05 THEN l_discount END AS kept, coalesce(CASE WHEN l_tax < 0.04 THEN l_tax END, 0.0)::DOUBLE AS filled, CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 30 THEN 'mid' ELSE 'high' END AS size, l_quantity BETWEEN 5 AND 15 AS inside, l_returnflag IN ('A', 'R') AS back FROM lineitem",
)
def _(t: Tables) -> DataFrame:
    q = F.col("l_quantity")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_discount") > 0.05, F.col("l_discount")).alias("kept"),
        F.coalesce(F.when(F.col("l_tax") < 0.04, F.col("l_tax")), F.lit(0.0)).alias("filled"),
        F.when(q < 10, "low").when(q < 30, "mid").otherwise("high").alias("size"), q.between(5, 15).alias("inside"),
        F.col("l_returnflag").isin("A", "R").alias("back"),
    )


@query(
    "FN5_json_functions",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, '[' || event_id || ',' || user_id || ']' AS ids, '{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}' AS record FROM events",
)
def _(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id", F.element_at(F.from_json("props", "map<string,double>"), "k").alias("k"), F.to_json(F.array("event_id", "user_id")).alias("ids"),
        F.to_json(F.struct("event_type", "user_id")).alias("record"),
    )


@query(
    "FN6_array_functions",
    f"SELECT vec_id, CAST(len(embedding) AS INTEGER) AS size, {r('list_max(embedding)')} AS top, CAST(list_position(embedding, list_max(embedding)) AS BIGINT) AS top_place, {r('list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))')} AS total, {r('embedding[1]')} AS first_value FROM embeddings",
)
def _(t: Tables) -> DataFrame:
    e = F.transform("embedding", lambda x: x.cast("double"))
    return t.embeddings.select(
        "vec_id", F.size("embedding").alias("size"), sc.rounded(F.array_max("embedding")).alias("top"),
        F.array_position("embedding", F.array_max("embedding")).alias("top_place"), sc.rounded(sc.array_sum(e)).alias("total"),
        sc.rounded(F.element_at("embedding", 1)).alias("first_value"),
    )


@query(
    "FN7_exact_quantiles",
    "SELECT l_returnflag, " + ", ".join(f"{r(f'quantile_cont(l_extendedprice, {p})')} AS q{int(p * 100)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9)) + " FROM lineitem GROUP BY 1",
)
def _(t: Tables) -> DataFrame:
    cuts = {f"q{int(p * 100)}": p for p in (0.1, 0.25, 0.5, 0.75, 0.9)}
    out = quantiles(t.lineitem, ["l_returnflag"], "l_extendedprice", cuts)
    return out.select("l_returnflag", *[sc.rounded(F.col(c)).alias(c) for c in cuts])


