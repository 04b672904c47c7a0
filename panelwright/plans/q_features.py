"""Queries over features, targets, splits, preprocessing and sequences (FE, TG, SP, PP, SQ)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..operators import clean, features, prep, sequences, splits
from ..operators.profile import null_counts
from .frames import HORIZONS, LEVELS, PLAN, SPEC, TARGETS, Tables
from .registry import query
from .sql import LEVEL, SPLIT, SPLIT_END, cte, r, with_ctes

_KEY = ["entity", "ts"]


def _r(*names: str, digits: int = 6) -> list:
    return [rounded(F.col(n), digits).alias(n) for n in names]


@query(
    "FE1_clock_features",
    with_ctes("clean", "SELECT entity, ts, (hour(ts) * 60 + minute(ts)) / 60.0 AS hour_of_day, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, isodow(ts) >= 6 AS is_weekend FROM clean").replace("/ 60.0", "/ CAST(60 AS DOUBLE)"),
)
def _(t: Tables) -> DataFrame:
    return t.clean().select("entity", "ts").withColumns(features.clock_columns(F.col("ts")))


@query(
    "FE2_cyclic_encodings",
    with_ctes(
        "clean",
        f"SELECT entity, ts, {r('sin(2 * pi() * h / 24)')} AS hour_sin, {r('cos(2 * pi() * h / 24)')} AS hour_cos, {r('sin(2 * pi() * d / 7)')} AS day_of_week_sin, "
        f"{r('cos(2 * pi() * d / 7)')} AS day_of_week_cos FROM (SELECT *, hour(ts) + minute(ts) / 60 AS h, isodow(ts) - 1 AS d FROM clean)",
    ),
)
def _(t: Tables) -> DataFrame:
    out = t.clean().withColumns(features.clock_columns(F.col("ts"))).withColumns(features.cyclic_columns())
    return out.select("entity", "ts", *_r("hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos"))


_PEAKS = "hour(ts) BETWEEN 7 AND 9 AS is_morning_peak, hour(ts) BETWEEN 17 AND 19 AS is_evening_peak, (hour(ts) BETWEEN 7 AND 9 OR hour(ts) BETWEEN 17 AND 19) AS is_peak"


@query("FE3_peak_flags", with_ctes("clean", f"SELECT entity, ts, {_PEAKS} FROM clean"))
def _(t: Tables) -> DataFrame:
    return t.clean().select("entity", "ts").withColumns(features.peak_columns(F.col("ts"), PLAN))


_ROLL = {
    f"{m}_rolling_{s}_{k}": f"CASE WHEN count({m}) OVER w{k} = {k} THEN {fn}({m}) OVER w{k} END"
    for m in PLAN.measures for k in PLAN.rolling for s, fn in (("mean", "avg"), ("std", "stddev_samp"))
}
_LAG = {f"{m}_lag_{k}": f"lag({m}, {k}) OVER w" for m in PLAN.measures for k in PLAN.lags}
cte(
    "history",
    "SELECT *, " + ", ".join(f"{sql} AS {n}" for n, sql in {**_LAG, **_ROLL}.items())
    + " FROM clean WINDOW w AS (PARTITION BY entity ORDER BY ts), w4 AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), "
    "w8 AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)",
    "clean",
)
_FULL = " AND ".join(f"{n} IS NOT NULL" for n in (*_LAG, *_ROLL))


@query("FE4_lags", with_ctes("history", f"SELECT entity, ts, {', '.join(_LAG)} FROM history"))
def _(t: Tables) -> DataFrame:
    return features.add_history(t.clean(), SPEC, PLAN).select("entity", "ts", *features.lag_names(PLAN))


_MEANS = [n for n in _ROLL if "_mean_" in n]
_STDS = [n for n in _ROLL if "_std_" in n]


@query("FE5_rolling_means", with_ctes("history", f"SELECT entity, ts, {', '.join(f'{r(n, 10)} AS {n}' for n in _MEANS)} FROM history"))
def _(t: Tables) -> DataFrame:
    return features.add_history(t.clean(), SPEC, PLAN).select("entity", "ts", *_r(*_MEANS, digits=10))


@query("FE6_rolling_deviations", with_ctes("history", f"SELECT entity, ts, {', '.join(f'{r(n)} AS {n}' for n in _STDS)} FROM history"))
def _(t: Tables) -> DataFrame:
    return features.add_history(t.clean(), SPEC, PLAN).select("entity", "ts", *_r(*_STDS))


@query("FE7_history_available", with_ctes("history", f"SELECT entity, ts, ({_FULL}) AS history_available FROM history"))
def _(t: Tables) -> DataFrame:
    return features.add_history(t.clean(), SPEC, PLAN).select("entity", "ts", "history_available")


@query(
    "FE8_capacity",
    with_ctes("clean", f"SELECT entity, ts, capacity / CAST(2 AS DOUBLE) AS window_capacity, {r('load / (capacity / 2.0)')} AS capacity_ratio, {r('capacity / 2.0 - load')} AS capacity_headroom FROM clean"),
)
def _(t: Tables) -> DataFrame:
    out = t.clean().withColumns(features.capacity_columns(PLAN))
    return out.select("entity", "ts", "window_capacity", *_r("capacity_ratio", "capacity_headroom"))


@query("FE9_condition_flags", with_ctes("merged", "SELECT entity, ts, (rainfall > 20.0 OR condition = 'Rain') AS is_rain, visibility < 60.0 AS is_low_visibility FROM merged"))
def _(t: Tables) -> DataFrame:
    return t.merged().select("entity", "ts", *[c.alias(n) for n, c in features.condition_flags(PLAN).items()])


@query("FE10_condition_indicators", with_ctes("merged", "SELECT entity, ts, " + ", ".join(f"condition = '{c}' AS condition_is_{c.lower()}" for c in PLAN.conditions) + " FROM merged"))
def _(t: Tables) -> DataFrame:
    return t.merged().select("entity", "ts", *[c.alias(n) for n, c in features.condition_indicators(PLAN).items()])


@query(
    "FE11_numeric_bands",
    with_ctes("hourly", "SELECT grp, hour, CASE WHEN temperature < 30 THEN 'cool' WHEN temperature < 50 THEN 'mild' WHEN temperature < 70 THEN 'warm' WHEN temperature >= 70 THEN 'hot' END AS temperature_band FROM hourly"),
)
def _(t: Tables) -> DataFrame:
    band = features.banded(F.col("temperature"), PLAN.temperature_bounds, PLAN.temperature_labels)
    return t.hourly().select("grp", "hour", band.alias("temperature_band"))


@query("FE12_holiday_peak", with_ctes("merged", "SELECT entity, ts, public_holiday = 1 AND (hour(ts) BETWEEN 7 AND 9 OR hour(ts) BETWEEN 17 AND 19) AS holiday_peak FROM merged"))
def _(t: Tables) -> DataFrame:
    return t.features().select("entity", "ts", "holiday_peak")


@query(
    "FE13_event_proximity",
    with_ctes("merged daily", "SELECT m.entity, m.ts, n.d AS days_to_nearest_event, coalesce(n.d <= 1, FALSE) AS event_within_proximity FROM merged m LEFT JOIN (SELECT d.date, CAST(min(abs(date_diff('day', d.date, e.date))) AS INTEGER) AS d FROM daily d, (SELECT date FROM daily WHERE event_flag = 1) e GROUP BY 1) n ON n.date = m.calendar_date"),
)
def _(t: Tables) -> DataFrame:
    return t.features().select("entity", "ts", "days_to_nearest_event", "event_within_proximity")


@query("FE15_history_gaps", with_ctes("history", f"SELECT entity, count(*) AS rows, count(*) FILTER (NOT ({_FULL})) AS unavailable_rows FROM history GROUP BY 1"))
def _(t: Tables) -> DataFrame:
    return features.history_gaps(features.add_history(t.clean(), SPEC, PLAN), "entity")


@query("FE15b_feature_nulls", with_ctes("history", " UNION ALL ".join(f"SELECT '{n}' AS \"column\", count(*) - count({n}) AS nulls FROM history" for n in (*_LAG, *_ROLL))))
def _(t: Tables) -> DataFrame:
    return null_counts(features.add_history(t.clean(), SPEC, PLAN).select(*_LAG, *_ROLL))


@query(
    "TG1_future_timestamps",
    with_ctes("targets", " UNION ALL ".join(f"SELECT CAST({h} AS INTEGER) AS horizon, count(target_ts_h{h}) AS available_rows, count(*) FILTER (target_ts_h{h} <> ts + {h} * INTERVAL '30 minutes') AS misplaced_rows FROM targets" for h in HORIZONS)),
)
def _(t: Tables) -> DataFrame:
    return features.misplaced_targets(t.targets(), SPEC, HORIZONS)


@query(
    "TG2_future_values",
    with_ctes("targets", "SELECT entity, ts, " + ", ".join(f"target_load_h{h}, target_load_h{h}_available, target_level_h{h}, target_level_h{h}_available" for h in HORIZONS) + " FROM targets"),
)
def _(t: Tables) -> DataFrame:
    names = [f"target_{n}_h{h}{s}" for h in HORIZONS for n in ("load", "level") for s in ("", "_available")]
    return t.targets().select("entity", "ts", *names)


@query(
    "TG3_future_events",
    with_ctes("targets", "SELECT entity, ts, " + ", ".join(f"target_incident_h{h}, target_incident_h{h}_available" for h in HORIZONS) + " FROM targets"),
)
def _(t: Tables) -> DataFrame:
    return t.targets().select("entity", "ts", *[f"target_incident_h{h}{s}" for h in HORIZONS for s in ("", "_available")])


@query(
    "TG4_target_coverage",
    with_ctes(
        "target_long",
        "SELECT target, kind, count(*) FILTER (available) AS available_rows, count(*) FILTER (NOT available) AS unavailable_rows, count(*) - count(value) AS null_rows, "
        "count(*) FILTER (kind = 'binary' AND value = 'true') AS positive_rows, count(*) FILTER (kind = 'binary' AND value = 'false') AS negative_rows FROM target_long GROUP BY 1, 2",
    ),
)
def _(t: Tables) -> DataFrame:
    return features.target_coverage(t.targets(), TARGETS, HORIZONS)


@query("TG4b_target_classes", with_ctes("target_long", "SELECT target, value AS class, count(*) AS rows FROM target_long WHERE kind = 'multiclass' AND available GROUP BY 1, 2"))
def _(t: Tables) -> DataFrame:
    return features.target_class_counts(t.targets(), TARGETS, HORIZONS)


# -- splits ------------------------------------------------------------------------------------
_SP = f"SELECT entity, ts, {SPLIT.format('ts')} AS split FROM clean, cuts"


@query(
    "SP1_partition_bounds",
    with_ctes("clean cuts", f"SELECT split, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT ts) AS timestamps FROM ({_SP}) GROUP BY 1"),
)
def _(t: Tables) -> DataFrame:
    return splits.partition_bounds(t.clean(), "ts")


@query("SP2_chronological_split", with_ctes("clean cuts", _SP))
def _(t: Tables) -> DataFrame:
    return splits.assign(t.clean().select(*_KEY), "ts", t.splits())


_WITHIN = ", ".join(f"coalesce(target_ts_h{h} <= {SPLIT_END.format('ts')}, FALSE) AS target_within_split_h{h}" for h in HORIZONS)


def _assigned(t: Tables) -> DataFrame:
    return splits.assign(t.targets(), "ts", t.splits(), {h: f"target_ts_h{h}" for h in HORIZONS})


@query("SP3_target_within_split", with_ctes("targets cuts", f"SELECT entity, ts, {SPLIT.format('ts')} AS split, {_WITHIN} FROM targets, cuts"))
def _(t: Tables) -> DataFrame:
    return _assigned(t).select("entity", "ts", "split", *[f"target_within_split_h{h}" for h in HORIZONS])


@query(
    "SP4_split_summary",
    with_ctes("clean cuts", f"SELECT split, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT ts) AS timestamps, count(*) AS rows, {r('count(DISTINCT ts) / (SELECT count(DISTINCT ts) FROM clean)', 10)} AS timestamp_ratio FROM ({_SP}) GROUP BY 1"),
)
def _(t: Tables) -> DataFrame:
    return splits.split_summary(splits.assign(t.clean().select(*_KEY), "ts", t.splits()), "ts")


@query(
    "SP4b_split_coverage",
    with_ctes(
        "target_long cuts",
        f"SELECT target, split, count(*) AS origin_rows, count(*) FILTER (available AND within) AS eligible_rows, count(*) FILTER (NOT within) AS boundary_excluded_rows, "
        f"count(*) FILTER (within AND NOT available) AS label_unavailable_rows, count(*) FILTER (available AND within AND value = 'true') AS positive_rows "
        f"FROM (SELECT *, {SPLIT.format('ts')} AS split, coalesce(target_ts <= {SPLIT_END.format('ts')}, FALSE) AS within FROM target_long, cuts) GROUP BY 1, 2",
    ),
)
def _(t: Tables) -> DataFrame:
    long = features.target_long(t.targets(), TARGETS, HORIZONS, ["entity", "ts"])
    placed = splits.with_split(long, "ts", t.splits())
    return splits.split_coverage(placed.withColumn("within", F.coalesce(F.col("target_ts") <= F.col("_split_end"), F.lit(False))))


@query(
    "SP4c_split_classes",
    with_ctes(
        "target_long cuts",
        f"SELECT target, split, value AS class, count(*) AS rows FROM (SELECT *, {SPLIT.format('ts')} AS split, coalesce(target_ts <= {SPLIT_END.format('ts')}, FALSE) AS within FROM target_long, cuts) "
        "WHERE kind <> 'regression' AND available AND within GROUP BY 1, 2, 3",
    ),
)
def _(t: Tables) -> DataFrame:
    long = features.target_long(t.targets(), TARGETS, HORIZONS, ["entity", "ts"])
    placed = splits.with_split(long, "ts", t.splits())
    return splits.split_classes(placed.withColumn("within", F.coalesce(F.col("target_ts") <= F.col("_split_end"), F.lit(False))))


cte(
    "folds",
    """SELECT CAST(k + 1 AS INTEGER) AS fold, min(ts) AS train_start, max(CASE WHEN rk = s - 5 THEN ts END) AS train_end, max(CASE WHEN rk = s - 4 THEN ts END) AS gap_start,
    max(CASE WHEN rk = s - 1 THEN ts END) AS gap_end, max(CASE WHEN rk = s THEN ts END) AS validation_start, max(CASE WHEN rk = s + 95 THEN ts END) AS validation_end,
    max(s) - 4 AS train_timestamps FROM (SELECT ts, rk, k, n - 480 + k * 96 AS s FROM (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS rk, count(*) OVER () AS n
      FROM (SELECT DISTINCT ts FROM clean, cuts WHERE ts <= train_last)), (VALUES (0), (1), (2), (3), (4)) f(k)) GROUP BY k""",
    "clean",
    "cuts",
)


def _folds(t: Tables) -> DataFrame:
    train = splits.assign(t.clean().select("ts"), "ts", t.splits()).filter("split = 'train'")
    return splits.cv_folds(splits.ordered_index(train, "ts"), "ts", 5, 96, 4)


@query("SP5_expanding_folds", with_ctes("folds", "SELECT * FROM folds"))
def _(t: Tables) -> DataFrame:
    return _folds(t)


@query(
    "SP6_fold_evidence",
    with_ctes(
        "folds targets cuts",
        """SELECT *, train_origin_end < validation_origin_start AS origins_ordered, train_target_end < vs AS labels_ordered FROM (
        SELECT fold, count(*) FILTER (ts BETWEEN train_start AND train_end) AS training_rows, count(*) FILTER (ts BETWEEN validation_start AND validation_end) AS validation_rows,
        max(ts) FILTER (ts <= train_end) AS train_origin_end, max(target_ts_h4) FILTER (ts <= train_end) AS train_target_end, min(ts) FILTER (ts BETWEEN validation_start AND validation_end) AS validation_origin_start,
        max(ts) FILTER (ts BETWEEN validation_start AND validation_end) AS validation_origin_end, max(validation_start) AS vs
        FROM folds, targets, cuts WHERE target_load_h4_available AND target_ts_h4 <= train_last GROUP BY 1)""",
    ).replace("SELECT *, train_origin_end < ", "SELECT fold, training_rows, validation_rows, train_origin_end, train_target_end, validation_origin_start, validation_origin_end, train_origin_end < "),
)
def _(t: Tables) -> DataFrame:
    rows = _assigned(t).filter("target_load_h4_available AND target_within_split_h4 AND split = 'train'")
    placed = splits.fold_rows(rows.select("entity", "ts", "target_ts_h4"), "ts", _folds(t))
    return splits.fold_evidence(placed, "ts", "target_ts_h4")


@query(
    "SP7_evenly_spaced_timestamps",
    with_ctes(
        "clean",
        """SELECT entity, ts, load FROM clean WHERE ts IN (SELECT ts FROM (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM clean))
        WHERE n <= 96 OR rk IN (SELECT CASE WHEN i = 95 THEN n - 1 ELSE floor(i * (CAST(n - 1 AS DOUBLE) / 95)) END FROM range(96) x(i)))""",
    ),
)
def _(t: Tables) -> DataFrame:
    return splits.evenly_spaced(t.clean(), "ts", 96).select("entity", "ts", "load")


@query(
    "SP8_calibration_halves",
    with_ctes(
        "clean cuts",
        """SELECT entity, ts, CASE WHEN rk <= greatest(floor(n * 0.5), 1) - 1 THEN 'fit' ELSE 'assess' END AS half FROM (SELECT entity, ts, dense_rank() OVER (ORDER BY ts) - 1 AS rk,
        count(DISTINCT ts) OVER () AS n FROM clean, cuts WHERE ts > train_last AND ts <= val_last)""",
    ),
)
def _(t: Tables) -> DataFrame:
    rows = splits.assign(t.clean().select(*_KEY), "ts", t.splits()).filter("split = 'validation'").drop("split")
    return splits.calibration_halves(rows, "ts")


@query(
    "SP9_eligible_rows",
    with_ctes(
        "targets cuts",
        f"SELECT entity, ts, CAST(CASE target_level_h1 WHEN 'Free-flow' THEN 0 WHEN 'Moderate' THEN 1 WHEN 'Heavy' THEN 2 ELSE 3 END AS INTEGER) AS class_index FROM targets, cuts WHERE target_level_h1_available AND target_ts_h1 <= {SPLIT_END.format('ts')}",
    ),
)
def _(t: Tables) -> DataFrame:
    rows = splits.eligible(_assigned(t), F.col("target_level_h1_available"), F.col("target_within_split_h1"))
    return rows.select("entity", "ts", splits.encode(F.col("target_level_h1"), LEVELS).alias("class_index"))


@query("SP10_earliest_rows", "SELECT event_id, ts, event_type FROM events ORDER BY ts, event_id LIMIT 500")
def _(t: Tables) -> DataFrame:
    return splits.earliest_rows(t.events, ["ts", "event_id"], 500).select("event_id", "ts", "event_type")


@query("SP11_seeded_sample", "SELECT event_id, event_type, value FROM events ORDER BY md5('17|' || CAST(event_id AS VARCHAR)), event_id LIMIT 1000")
def _(t: Tables) -> DataFrame:
    return splits.seeded_sample(t.events, ["event_id"], 1000, 17).select("event_id", "event_type", "value")


@query(
    "SP12_class_weights",
    with_ctes(
        "panel",
        f"SELECT level, count(*) AS rows, {r('(SELECT count(*) FROM panel) / (count(*) * (SELECT count(DISTINCT ' + LEVEL.format('load', 'capacity') + ') FROM panel))', 10)} AS weight FROM (SELECT {LEVEL.format('load', 'capacity')} AS level FROM panel) GROUP BY 1",
    ),
)
def _(t: Tables) -> DataFrame:
    return splits.class_weights(t.panel().select(clean.capacity_band(F.col("load"), F.col("capacity")).alias("level")), "level")


@query("SP12b_imbalance", f"SELECT count(*) FILTER (quality = 1) AS positive_rows, count(*) FILTER (quality = 0) AS negative_rows, {r('count(*) FILTER (quality = 0) / count(*) FILTER (quality = 1)', 10)} AS negative_to_positive FROM labels")
def _(t: Tables) -> DataFrame:
    return splits.imbalance(t.labels, "quality")


# -- preprocessing -------------------------------------------------------------------------------
cte(
    "prep_rows",
    f"""SELECT o_orderkey, o_orderdate < TIMESTAMP '1999-01-01' AS train, CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE o_totalprice END AS price, CAST(day(o_orderdate) AS DOUBLE) AS dom,
    CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_orderstatus = 'F' END AS is_final, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM orders""",
)


def _prep_rows(t: Tables) -> DataFrame:
    every = F.pmod("o_custkey", F.lit(11)) == 0
    return t.orders.select(
        "o_orderkey",
        (F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")).alias("train"),
        F.when(~every, F.col("o_totalprice")).alias("price"),
        F.day("o_orderdate").cast("double").alias("dom"),
        F.when(F.pmod("o_custkey", F.lit(7)) != 0, F.col("o_orderstatus") == "F").alias("is_final"),
        F.when(F.pmod("o_custkey", F.lit(5)) != 0, F.col("o_orderpriority")).alias("priority"),
    )


def _groups(df: DataFrame) -> prep.Groups:
    return prep.feature_groups(df.schema, ["price", "dom", "is_final", "priority"], bounded=["dom"])


def _fit(t: Tables) -> tuple[DataFrame, prep.Fitted]:
    rows = _prep_rows(t)
    return rows, prep.fit(rows.filter("train"), _groups(rows))


cte("prep_med", "SELECT quantile_cont(price, 0.5) AS med FROM prep_rows WHERE train", "prep_rows")
cte(
    "prep_num",
    "SELECT med, avg(coalesce(price, med)) AS m, stddev_pop(coalesce(price, med)) AS s, min(dom) AS lo, max(dom) AS hi FROM prep_rows, prep_med WHERE train GROUP BY med",
    "prep_rows",
    "prep_med",
)
cte("prep_mode", "SELECT (SELECT priority FROM prep_rows WHERE train AND priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS p, (SELECT is_final FROM prep_rows WHERE train AND is_final IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS f", "prep_rows")


@query(
    "PP1_feature_groups",
    "SELECT v.f AS feature, v.g AS \"group\", n AS rows FROM (SELECT count(*) AS n FROM orders), (VALUES ('price','numeric'),('dom','bounded'),('is_final','binary'),('priority','categorical')) v(f, g)",
)
def _(t: Tables) -> DataFrame:
    rows = _prep_rows(t)
    return prep.group_table(rows, _groups(rows))


@query("PP2_median_imputation", with_ctes("prep_rows prep_med", f"SELECT o_orderkey, {r('coalesce(price, med)')} AS price FROM prep_rows, prep_med"))
def _(t: Tables) -> DataFrame:
    rows, fitted = _fit(t)
    return prep.impute(rows, fitted.numbers, ["price"]).select("o_orderkey", rounded(F.col("price")).alias("price"))


@query("PP3_mode_imputation", with_ctes("prep_rows prep_mode", "SELECT o_orderkey, coalesce(is_final, f) AS is_final, coalesce(priority, p) AS priority FROM prep_rows, prep_mode"))
def _(t: Tables) -> DataFrame:
    rows = _prep_rows(t)
    modes = prep.fit_modes(rows.filter("train"), ["is_final", "priority"])
    return prep.impute_modes(rows, modes, ["is_final", "priority"]).select("o_orderkey", "is_final", "priority")


@query("PP4_standard_scaling", with_ctes("prep_rows prep_num", f"SELECT o_orderkey, {r('(coalesce(price, med) - m) / s')} AS price FROM prep_rows, prep_num"))
def _(t: Tables) -> DataFrame:
    rows, fitted = _fit(t)
    return prep.scale_standard(rows, fitted.numbers, ["price"]).select("o_orderkey", rounded(F.col("price")).alias("price"))


@query("PP5_minmax_scaling", with_ctes("prep_rows prep_num", f"SELECT o_orderkey, {r('(dom - lo) / (hi - lo)')} AS dom FROM prep_rows, prep_num"))
def _(t: Tables) -> DataFrame:
    rows, fitted = _fit(t)
    return prep.scale_minmax(rows, fitted.numbers, ["dom"]).select("o_orderkey", rounded(F.col("dom")).alias("dom"))


@query(
    "PP6_one_hot",
    with_ctes("prep_rows prep_mode", "SELECT o_orderkey, c.v AS category, CAST(coalesce(priority, p) = c.v AS INTEGER)::DOUBLE AS indicator FROM prep_rows, prep_mode, (SELECT DISTINCT coalesce(priority, p) AS v FROM prep_rows, prep_mode WHERE train) c"),
)
def _(t: Tables) -> DataFrame:
    rows, fitted = _fit(t)
    hot = prep.one_hot(rows, fitted.categories, "priority", "hot").withColumn("c", prep.as_map(fitted.categories)["priority"]["categories"])
    pairs = F.arrays_zip(F.col("c").alias("category"), F.col("hot").alias("indicator"))
    return hot.select("o_orderkey", F.explode(pairs).alias("r")).select("o_orderkey", "r.category", "r.indicator")


_BUYERS = "(SELECT o_orderkey, CAST(nullif(o_custkey % 97, 0) AS VARCHAR) || '-' || CAST(o_custkey AS VARCHAR) AS buyer, o_orderkey % 3 <> 0 AS train FROM orders)"


def _buyers(t: Tables) -> DataFrame:
    buyer = F.concat(F.nullif(F.col("o_custkey") % 97, F.lit(0)).cast("string"), F.lit("-"), F.col("o_custkey").cast("string"))
    return t.orders.select("o_orderkey", buyer.alias("buyer"), (F.col("o_orderkey") % 3 != 0).alias("train"))


_WORDS = f"""WITH b AS {_BUYERS}, m AS (SELECT buyer AS m FROM b WHERE train AND buyer IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, buyer LIMIT 1),
w AS (SELECT coalesce(buyer, m) AS value, count(*) AS rows FROM b, m WHERE train GROUP BY 1), d AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS "index", count(*) OVER () AS size, rows FROM w) """


@query("PP6b_sparse_categories", _WORDS + 'SELECT o_orderkey, d."index", (SELECT max(size) FROM d) AS size, CAST(d.value IS NOT NULL AS INTEGER) AS places_set FROM b CROSS JOIN m LEFT JOIN d ON coalesce(buyer, m) = d.value')
def _(t: Tables) -> DataFrame:
    """A vocabulary of thousands, encoded by a join into sparse vectors."""
    rows = _buyers(t)
    train = rows.filter("train")
    words = prep.dictionary(train, "buyer")
    size = words.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]
    mode = prep.fit_modes(train, ["buyer"]).select("mode").scalar()
    made = prep.sparse_one_hot(prep.index_categories(rows, words, "buyer", mode), "index", size, "hot")
    # A sparse vector's text lists its places.
    places = F.regexp_extract(F.col("hot").cast("string"), r"^\((\d+),\[(\d*)\]", 2)
    width = F.regexp_extract(F.col("hot").cast("string"), r"^\((\d+),", 1).cast("long")
    return made.select("o_orderkey", F.nullif(places, F.lit("")).cast("long").alias("index"), width.alias("size"), (places != "").cast("int").alias("places_set"))


@query("PP7b_category_rows", _WORDS + "SELECT * FROM d")
def _(t: Tables) -> DataFrame:
    return prep.dictionary(_buyers(t).filter("train"), "buyer")


@query(
    "PP7_training_statistics",
    with_ctes(
        "prep_rows prep_num prep_mode",
        f"""SELECT 'price' AS "column", 'numeric' AS kind, {r('med')} AS fill_number, {r('m')} AS mean, {r('s')} AS scale, {r('(SELECT min(coalesce(price, med)) FROM prep_rows WHERE train)')} AS minimum,
        {r('(SELECT max(coalesce(price, med)) FROM prep_rows WHERE train)')} AS maximum, CAST(NULL AS VARCHAR) AS fill_text, CAST(NULL AS VARCHAR) AS categories FROM prep_num
        UNION ALL SELECT 'dom', 'numeric', {r('quantile_cont(dom, 0.5)')}, {r('avg(dom)')}, {r('stddev_pop(dom)')}, {r('min(dom)')}, {r('max(dom)')}, NULL, NULL FROM prep_rows WHERE train
        UNION ALL SELECT 'is_final', 'binary', NULL, NULL, NULL, NULL, NULL, CAST(f AS VARCHAR), NULL FROM prep_mode
        UNION ALL SELECT 'priority', 'categorical', NULL, NULL, NULL, NULL, NULL, p, (SELECT array_to_string(list_sort(list(DISTINCT coalesce(priority, p))), '|') FROM prep_rows WHERE train) FROM prep_mode""",
    ),
)
def _(t: Tables) -> DataFrame:
    _, fitted = _fit(t)
    out = prep.statistics_table(fitted)
    numbers = ("fill_number", "mean", "scale", "minimum", "maximum")
    return out.select("column", "kind", *_r(*numbers), "fill_text", "categories")


@query(
    "PP8_assembled_vectors",
    with_ctes(
        "prep_rows prep_num prep_mode",
        f"SELECT o_orderkey, CAST(3 + (SELECT count(DISTINCT coalesce(priority, p)) FROM prep_rows, prep_mode WHERE train) AS INTEGER) AS width, "
        f"{r('(coalesce(price, med) - m) / s + (dom - lo) / (hi - lo) + CAST(coalesce(is_final, f) AS INTEGER) + 1')} AS total FROM prep_rows, prep_num, prep_mode",
    ),
)
def _(t: Tables) -> DataFrame:
    rows, fitted = _fit(t)
    values = vector_to_array(F.col("features"))
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return fitted.transform(rows, "linear").select("o_orderkey", F.size(values).alias("width"), rounded(total).alias("total"))


# -- sequences -----------------------------------------------------------------------------------
cte(
    "runs",
    """SELECT entity, ts, row_number() OVER (PARTITION BY entity, island ORDER BY ts) AS run_length FROM (SELECT *, sum(CASE WHEN p IS NULL OR ts - p <> INTERVAL '30 minutes' THEN 1 ELSE 0 END)
    OVER (PARTITION BY entity ORDER BY ts) AS island FROM (SELECT entity, ts, lag(ts) OVER (PARTITION BY entity ORDER BY ts) AS p FROM observed))""",
    "observed",
)


@query("SQ1_run_lengths", with_ctes("runs", "SELECT entity, ts, run_length FROM runs"))
def _(t: Tables) -> DataFrame:
    return sequences.run_lengths(t.observed(), SPEC).select("entity", "ts", "run_length")


_MASK = " AND ".join(f"target_load_h{h}_available AND coalesce(target_ts_h{h} <= {SPLIT_END.format('ts')}, FALSE)" for h in HORIZONS)
cte("endpoint_rows", f"SELECT *, {SPLIT.format('ts')} AS split, ({_MASK}) AS ok FROM targets, cuts", "targets", "cuts")


@query("SQ2_endpoint_mask", with_ctes("endpoint_rows", "SELECT entity, ts, ok AS eligible FROM endpoint_rows"))
def _(t: Tables) -> DataFrame:
    return _assigned(t).select("entity", "ts", sequences.endpoint_mask(HORIZONS, "load", SPEC).alias("eligible"))


cte("ends", "SELECT entity, ts, split, run_length, load, target_load_h1 FROM (SELECT *, row_number() OVER (PARTITION BY entity, split ORDER BY ts) AS run_length FROM endpoint_rows) WHERE ok AND run_length >= 48", "endpoint_rows")


def _ends(t: Tables) -> DataFrame:
    return sequences.endpoints(_assigned(t), SPEC, 48, sequences.endpoint_mask(HORIZONS, "load", SPEC))


@query("SQ3_sequence_endpoints", with_ctes("ends", "SELECT entity, ts, split, run_length FROM ends"))
def _(t: Tables) -> DataFrame:
    return _ends(t).select("entity", "ts", "split", "run_length")


@query(
    "SQ4_feature_sequences",
    with_ctes(
        "clean",
        f"""SELECT entity, ts, CAST(8 AS INTEGER) AS steps, {r('first_load')} AS first_load, {r('last_speed')} AS last_speed, {r('total')} AS total FROM (SELECT entity, ts, count(*) OVER w AS n,
        first_value(load) OVER w AS first_load, speed AS last_speed, sum(load) OVER w + sum(speed) OVER w AS total, count(load) OVER w AS k, count(speed) OVER w AS k2
        FROM clean WINDOW w AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)) WHERE n = 8 AND k = 8 AND k2 = 8""",
    ),
)
def _(t: Tables) -> DataFrame:
    out = sequences.feature_sequences(t.clean().select("entity", "ts", "load", "speed"), SPEC, ["load", "speed"], 8)
    whole = F.aggregate(F.flatten("sequence"), F.lit(0.0), lambda a, x: a + x)
    return out.select(
        "entity", "ts", F.size("sequence").alias("steps"), rounded(F.col("sequence")[0][0]).alias("first_load"),
        rounded(F.col("sequence")[7][1]).alias("last_speed"), rounded(whole).alias("total"),
    ).filter("total IS NOT NULL")


@query(
    "SQ5_target_scaler",
    with_ctes("endpoint_rows", f"SELECT e.entity, e.ts, {r('(target_load_h1 - m) / s')} AS scaled, {r('target_load_h1')} AS restored FROM endpoint_rows e, (SELECT avg(target_load_h1) AS m, stddev_pop(target_load_h1) AS s FROM endpoint_rows WHERE ok AND split = 'train') WHERE ok"),
)
def _(t: Tables) -> DataFrame:
    rows = _assigned(t).filter(sequences.endpoint_mask(HORIZONS, "load", SPEC)).select("entity", "ts", "split", "target_load_h1")
    scaler = sequences.fit_target_scaler(rows.filter("split = 'train'"), ["target_load_h1"])
    scaled = sequences.scale_targets(rows, scaler, ["target_load_h1"]).withColumn("scaled", F.col("target_load_h1"))
    back = sequences.scale_targets(scaled, scaler, ["target_load_h1"], inverse=True)
    return back.select("entity", "ts", rounded(F.col("scaled")).alias("scaled"), rounded(F.col("target_load_h1")).alias("restored"))


@query("SQ6_sequence_manifest", with_ctes("ends", "SELECT split, count(*) AS sequences, CAST(48 AS INTEGER) AS sequence_length, count(DISTINCT entity) AS entities, min(ts) AS origin_start, max(ts) AS origin_end FROM ends GROUP BY 1"))
def _(t: Tables) -> DataFrame:
    return sequences.sequence_manifest(_ends(t), SPEC, 48)


cte("full_ts", "SELECT ts FROM observed GROUP BY 1 HAVING count(DISTINCT entity) = (SELECT count(DISTINCT entity) FROM observed)", "observed")


@query("SQ7_latest_common_origin", with_ctes("full_ts", "SELECT max(ts) AS origin FROM full_ts"))
def _(t: Tables) -> DataFrame:
    return sequences.latest_common_origin(t.observed(), SPEC)


@query(
    "SQ8_eligible_origins",
    with_ctes(
        "full_ts",
        """SELECT ts FROM (SELECT ts, row_number() OVER (PARTITION BY island ORDER BY ts) AS n FROM (SELECT ts, sum(CASE WHEN p IS NULL OR ts - p <> INTERVAL '30 minutes' THEN 1 ELSE 0 END)
        OVER (ORDER BY ts) AS island FROM (SELECT ts, lag(ts) OVER (ORDER BY ts) AS p FROM full_ts))) WHERE n >= 2""",
    ),
)
def _(t: Tables) -> DataFrame:
    return sequences.eligible_origins(t.observed(), SPEC, 2)


cte("asked", "SELECT event_type AS entity, max(time_bucket(INTERVAL '30 minutes', ts)) AS origin FROM events GROUP BY event_type, CAST(ts AS DATE)")


def _asked(t: Tables) -> DataFrame:
    days = t.events.groupBy(F.col("event_type").alias("entity"), F.to_date("ts").alias("d"))
    return days.agg(F.max("ts").alias("m")).select("entity", F.window("m", "30 minutes").start.alias("origin"))


@query("SQ9_origin_rows", with_ctes("asked clean", "SELECT a.entity, a.origin, c.load, c.speed FROM asked a JOIN clean c ON c.entity = a.entity AND c.ts = a.origin"))
def _(t: Tables) -> DataFrame:
    return sequences.origin_rows(t.clean(), SPEC, _asked(t)).select("entity", "origin", "load", "speed")


@query("SQ9b_missing_origins", with_ctes("observed asked", "SELECT entity, origin FROM (SELECT entity, origin + INTERVAL '30 minutes' AS origin FROM asked) a WHERE NOT EXISTS (SELECT 1 FROM observed o WHERE o.entity = a.entity AND o.ts = a.origin)"))
def _(t: Tables) -> DataFrame:
    later = _asked(t).withColumn("origin", F.col("origin") + F.expr("INTERVAL 30 MINUTE"))
    return sequences.missing_origins(t.observed(), SPEC, later)


@query(
    "SQ10_resolved_origins",
    with_ctes(
        "full_ts",
        """SELECT event_id, origin, coalesce(minute(origin) % 30 = 0, FALSE) AS aligned, origin IN (SELECT ts FROM full_ts) AND origin IS NOT NULL AS eligible FROM (SELECT event_id,
        CASE WHEN second(ts) = 9 THEN NULL WHEN second(ts) < 30 THEN time_bucket(INTERVAL '30 minutes', ts) ELSE date_trunc('minute', ts) END AS origin FROM events)""",
    ),
)
def _(t: Tables) -> DataFrame:
    sec = F.second("ts")
    start = F.window("ts", "30 minutes").start
    text = F.when(sec == 9, "soon").when(sec < 30, F.date_format(start, "yyyy-MM-dd HH:mm")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm"))
    asked = t.events.select("event_id", text.alias("request"))
    known = sequences.full_timestamps(t.observed(), SPEC)
    return sequences.resolve_origins(asked, "request", "yyyy-MM-dd HH:mm", known, SPEC).drop("request")


