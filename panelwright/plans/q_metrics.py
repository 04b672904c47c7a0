"""Queries over metrics, uncertainty and error slices (RG, CM, CF)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import durable
from ..functions.scalars import rounded
from ..operators import enrich, metrics, slices, uncertainty
from .frames import HORIZONS, LEVELS, Tables
from .registry import query
from .sql import NUDGE, cte, nudged, r, with_ctes

_KEY = ["entity", "ts"]

_PAIR_KEY = ["entity", "ts", "target_ts", "split", "horizon", "horizon_minutes"]
_MODEL = ["model_version", "target", "horizon", "split"]
DIMENSIONS = ("entity", "origin_hour", "weekday", "weekday_type", "peak_status", "condition", "actual_level")
_NAMED = [f"level_h{h}" for h in HORIZONS]
MINIMUM = 40


# Means whose operators keep full precision; shown to nine places, nudged off exact ties.
_SHOWN = {
    "bias", "residual_standard_deviation", "mean_interval_width", "mean_rmse", "mean_confidence", "mean_normalized_entropy",
    "residual_q10", "residual_median", "residual_q90", "mean_error_delta", "rmse_delta",
}


def shown(df: DataFrame) -> DataFrame:
    return df.select(*[rounded(F.col(c) + NUDGE, 9).alias(c) if c in _SHOWN else F.col(c) for c in df.columns])


def enriched(t: Tables, preds: DataFrame | None = None, widths: DataFrame | None = None) -> DataFrame:
    preds = t.forecasts() if preds is None else preds
    widths = uncertainty.conformal_widths(preds, 0.9) if widths is None else widths
    out = enrich.attach_width(preds, widths, uncertainty.CALIBRATION_KEY)
    out = out.withColumns(uncertainty.interval_columns())
    return enrich.add_context(out, t.context(), _KEY, _NAMED, "horizon")


def scored_classes(t: Tables, classes: DataFrame | None = None) -> DataFrame:
    out = (t.classified() if classes is None else classes).withColumns(uncertainty.confidence_columns())
    band = uncertainty.risk_band(F.col("event_probability"), F.col("operating_threshold"))
    return enrich.add_context(out.withColumn("risk_band", band), t.context(), _KEY, _NAMED, "horizon")


def paired(t: Tables) -> DataFrame:
    errors = t.forecasts().withColumn("absolute_error", F.abs(F.col("residual")))
    out = enrich.pair_models(errors, "last_value", "same_window_yesterday", _PAIR_KEY, ["prediction", "absolute_error"])
    return slices.with_winner(out)


_REG = (
    "count(*) AS rows, {rmse} AS rmse, {mae} AS mae, {mape} AS mape_percent, {r2} AS r_squared"
).format(
    rmse=r("sqrt(avg((prediction - actual) * (prediction - actual)))", 10),
    mae=r("avg(abs(prediction - actual))", 10),
    mape=r("avg(CASE WHEN abs(actual) > 2.220446049250313e-16 THEN abs(prediction - actual) / abs(actual) END) * 100", 8),
    r2=r("CASE WHEN min(actual) = max(actual) THEN 0 ELSE 1 - sum((prediction - actual) * (prediction - actual)) / (var_pop(actual) * count(*)) END", 10),
)
_REG_N = ", count(*) FILTER (abs(actual) > 2.220446049250313e-16) AS mape_nonzero_rows, count(*) FILTER (NOT abs(actual) > 2.220446049250313e-16) AS mape_zero_actual_rows"
cte(
    "enriched",
    """SELECT f.*, w.width, prediction - actual AS signed_error, abs(prediction - actual) AS absolute_error, greatest(prediction - width, 0) AS interval_lower,
    prediction + width AS interval_upper, prediction + width - greatest(prediction - width, 0) AS interval_width,
    actual >= greatest(prediction - width, 0) AND actual <= prediction + width AS interval_covered
    FROM in_context f LEFT JOIN widths w USING (model_version, target, horizon, horizon_minutes)""",
    "in_context",
    "widths",
)


@query("RG1_regression_metrics", with_ctes("forecasts", f"SELECT model_version, split, horizon, {_REG}{_REG_N} FROM forecasts GROUP BY 1, 2, 3"))
def _(t: Tables) -> DataFrame:
    return metrics.regression_metrics(t.forecasts(), ["model_version", "split", "horizon"])


@query(
    "RG2_horizon_metrics",
    with_ctes(
        "forecasts",
        f"SELECT model_version, split, count(*) AS horizons, {nudged('avg(rmse)')} AS mean_rmse FROM (SELECT model_version, split, horizon, {_REG} FROM forecasts GROUP BY 1, 2, 3) GROUP BY 1, 2",
    ),
)
def _(t: Tables) -> DataFrame:
    per = metrics.regression_metrics(t.forecasts(), ["model_version", "split", "horizon"])
    return shown(metrics.mean_horizon_rmse(per, ["model_version", "split"]))


# -- classification --------------------------------------------------------------------------------
_A, _P = "actual_class_index", "predicted_class_index"


def _cls(i: int) -> tuple[str, str, str]:
    tp, sup, pred = (f"count(*) FILTER ({_A} = {i} AND {_P} = {i})", f"count(*) FILTER ({_A} = {i})", f"count(*) FILTER ({_P} = {i})")
    return (f"coalesce({tp} / nullif({pred}, 0), 0)", f"coalesce({tp} / nullif({sup}, 0), 0)", f"coalesce(2 * {tp} / nullif({sup} + {pred}, 0), 0)")


_MACRO = ", ".join(f"{r('(' + ' + '.join(_cls(i)[j] for i in range(4)) + ') / 4', 10)} AS macro_{n}" for j, n in enumerate(("precision", "recall", "f1")))
_ACC = f"count(*) AS rows, {r(f'count(*) FILTER ({_A} = {_P}) / count(*)', 10)} AS accuracy, {_MACRO}"
_LEVEL_ROWS = "(SELECT * FROM classified WHERE task = 'level')"


@query("CM1_multiclass_metrics", with_ctes("classified", f"SELECT horizon, split, {_ACC} FROM {_LEVEL_ROWS} GROUP BY 1, 2"))
def _(t: Tables) -> DataFrame:
    return metrics.multiclass_metrics(t.classified().filter("task = 'level'"), ["horizon", "split"], 4)


@query(
    "CM1b_per_class_metrics",
    with_ctes(
        "classified",
        " UNION ALL ".join(
            f"SELECT horizon, split, CAST({i} AS INTEGER) AS class_index, '{x}' AS class, {r(_cls(i)[0], 10)} AS precision, {r(_cls(i)[1], 10)} AS recall, {r(_cls(i)[2], 10)} AS f1, "
            f"count(*) FILTER ({_A} = {i}) AS support FROM {_LEVEL_ROWS} GROUP BY 1, 2"
            for i, x in enumerate(LEVELS)
        ),
    ),
)
def _(t: Tables) -> DataFrame:
    return metrics.per_class_metrics(t.classified().filter("task = 'level'"), ["horizon", "split"], LEVELS)


_NAMES = "(VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(LEVELS)) + ")"


@query(
    "CM2_confusion_matrix",
    with_ctes(
        "classified",
        f"SELECT g.horizon, g.split, a.x AS actual_label, p.x AS predicted_label, count(c.entity) AS rows FROM (SELECT DISTINCT horizon, split FROM classified) g CROSS JOIN {_NAMES} a(i, x) CROSS JOIN {_NAMES} p(i, x) "
        f"LEFT JOIN {_LEVEL_ROWS} c ON c.horizon = g.horizon AND c.split = g.split AND c.{_A} = a.i AND c.{_P} = p.i GROUP BY 1, 2, 3, 4",
    ),
)
def _(t: Tables) -> DataFrame:
    return metrics.confusion_long(t.classified().filter("task = 'level'"), ["horizon", "split"], LEVELS)


_RANK = """SELECT {keys} max(pp + nn) AS rows, max(pp) AS positive_rows, max(nn) AS negative_rows, {rate} AS positive_rate, {auc} AS roc_auc, {ap} AS pr_auc FROM (
    SELECT *, sum(n) OVER lo - n AS nb, sum(p) OVER lo - p AS pb, sum(p) OVER g AS pp, sum(n) OVER g AS nn FROM (
      SELECT {keys} {score} AS score, CAST(sum({y}) AS BIGINT) AS p, CAST(sum(1 - {y}) AS BIGINT) AS n FROM {source} GROUP BY ALL)
    WINDOW lo AS ({part} ORDER BY score), g AS ({part})) {group}"""


def _rank_sql(keys: str, score: str, y: str, source: str) -> str:
    names = [k.strip() for k in keys.split(",") if k.strip()]
    listed = ", ".join(names)
    text = _RANK.format(
        keys=listed + "," if names else "", score=score, y=y, source=source, part=f"PARTITION BY {listed}" if names else "PARTITION BY 1",
        group=f"GROUP BY {listed}" if names else "", rate=r("max(pp) / max(pp + nn)", 10),
        auc=r("CAST(sum(p * (nb + n / 2.0)) AS DOUBLE) / nullif(max(pp) * max(nn), 0)", 10),
        ap=r("CASE WHEN max(nn) > 0 THEN sum(p * (pp - pb) / ((pp - pb) + (nn - nb))) / nullif(max(pp), 0) END", 10),
    )
    for name in ("rows", "positive_rows", "negative_rows"):
        text = text.replace(f"max(pp + nn) AS {name}", f"CAST(max(pp + nn) AS BIGINT) AS {name}")
        text = text.replace(f"max(pp) AS {name}", f"CAST(max(pp) AS BIGINT) AS {name}").replace(f"max(nn) AS {name}", f"CAST(max(nn) AS BIGINT) AS {name}")
    return text


@query("CM3_roc_auc", with_ctes("scored", f"SELECT rows, positive_rows, negative_rows, positive_rate, roc_auc FROM ({_rank_sql('', 'score', 'actual', 'scored')})"))
def _(t: Tables) -> DataFrame:
    return metrics.ranking_metrics(t.scored(), [], "score", "actual").drop("pr_auc")


@query("CM4_average_precision", with_ctes("scored", f"SELECT lang, positive_rows, pr_auc FROM ({_rank_sql('lang', 'score', 'actual', 'scored')})"))
def _(t: Tables) -> DataFrame:
    return metrics.ranking_metrics(t.scored(), ["lang"], "score", "actual").select("lang", "positive_rows", "pr_auc")


_BRIER = "list_sum(list_transform(range(len(probabilities)), lambda i: pow(probabilities[i + 1] - CASE WHEN i = actual_class_index THEN 1 ELSE 0 END, 2)))"
_QUALITY = f"{r(f'avg({_BRIER})', 10)} AS brier_score, {r('avg(-ln(least(greatest(probabilities[actual_class_index + 1], 2.220446049250313e-16), 1 - 2.220446049250313e-16)))', 10)} AS log_loss"


@query("CM5_probability_quality", with_ctes("classified", f"SELECT task, horizon, split, count(*) AS rows, {_QUALITY} FROM classified GROUP BY 1, 2, 3"))
def _(t: Tables) -> DataFrame:
    return metrics.probability_quality(t.classified(), ["task", "horizon", "split"])


def _point(cond: str, y: str) -> str:
    tp, fp, fn, tn = (f"count(*) FILTER ({a} AND {b})" for a, b in ((y, cond), (f"NOT ({y})", cond), (y, f"NOT ({cond})"), (f"NOT ({y})", f"NOT ({cond})")))
    return (
        f"count(*) AS rows, {tp} AS true_positive, {fp} AS false_positive, {fn} AS false_negative, {tn} AS true_negative, {tp} + {fp} AS predicted_positive_rows, "
        f"{r(f'({tp} + {tn}) / count(*)', 10)} AS accuracy, {r(f'coalesce({tp} / nullif({tp} + {fp}, 0), 0)', 10)} AS precision, {r(f'coalesce({tp} / nullif({tp} + {fn}, 0), 0)', 10)} AS recall, "
        f"{r(f'coalesce(2 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0), 0)', 10)} AS f1"
    )


@query("CM6_operating_metrics", with_ctes("classified", f"SELECT horizon, split, {_point('event_probability >= operating_threshold', 'actual_class_index = 1')} FROM classified WHERE task = 'incident' GROUP BY 1, 2"))
def _(t: Tables) -> DataFrame:
    events = t.classified().filter("task = 'incident'")
    return metrics.operating_metrics(events, ["horizon", "split"], "event_probability", "actual_class_index", F.col("operating_threshold"))


cte("halved", "SELECT *, CASE WHEN doc_id % 4 = 0 THEN [score, 1.1 - score] ELSE [1 - score, score] END AS probs FROM scored", "scored")


@query(
    "CM7_probability_contract",
    with_ctes("halved", "SELECT lang, count(*) AS rows, CAST(0 AS BIGINT) AS non_finite, count(*) FILTER (list_max(probs) > 1 + 1e-12) AS out_of_range, count(*) FILTER (abs(list_sum(probs) - 1) > 1e-6) AS bad_sum FROM halved GROUP BY 1"),
)
def _(t: Tables) -> DataFrame:
    s = F.col("score")
    probs = F.when(F.pmod("doc_id", F.lit(4)) == 0, F.array(s, 1.1 - s)).otherwise(F.array(1 - s, s))
    return metrics.probability_violations(t.scored().withColumn("probs", probs), ["lang"], "probs")


@query("CM7b_normalised_probabilities", with_ctes("halved", f"SELECT doc_id, {r('least(probs[1], 1) / (least(probs[1], 1) + least(probs[2], 1))')} AS p0, {r('least(probs[2], 1) / (least(probs[1], 1) + least(probs[2], 1))')} AS p1 FROM halved"))
def _(t: Tables) -> DataFrame:
    s = F.col("score")
    probs = F.when(F.pmod("doc_id", F.lit(4)) == 0, F.array(s, 1.1 - s)).otherwise(F.array(1 - s, s))
    out = t.scored().withColumn("n", metrics.normalized(probs))
    return out.select("doc_id", rounded(F.col("n")[0]).alias("p0"), rounded(F.col("n")[1]).alias("p1"))


_BASE = "(SELECT avg(CAST(actual_class_index AS DOUBLE)) AS q, horizon FROM classified WHERE task = 'incident' AND split = 'train' GROUP BY horizon)"


@query(
    "CM8_calibration_decision",
    with_ctes(
        "classified",
        f"""SELECT horizon, rb AS raw_brier, rl AS raw_log_loss, cb AS calibrated_brier, cl AS calibrated_log_loss, {r('rb - cb', 9)} AS brier_improvement, rb - cb >= 0.0001 AS applied,
        CASE WHEN rb - cb >= 0.0001 THEN 'validation_brier_improved' ELSE 'validation_brier_improvement_below_minimum' END AS reason FROM (SELECT horizon, max(CASE WHEN k = 'raw' THEN brier_score END) AS rb,
        max(CASE WHEN k = 'raw' THEN log_loss END) AS rl, max(CASE WHEN k = 'cal' THEN brier_score END) AS cb, max(CASE WHEN k = 'cal' THEN log_loss END) AS cl FROM (
          SELECT 'raw' AS k, horizon, {_QUALITY} FROM classified WHERE task = 'incident' AND split = 'validation' GROUP BY 2
          UNION ALL SELECT 'cal', horizon, {_QUALITY} FROM (SELECT c.horizon, c.actual_class_index, [1 - b.q, b.q] AS probabilities FROM classified c JOIN {_BASE} b USING (horizon) WHERE task = 'incident' AND split = 'validation') GROUP BY 2) GROUP BY 1)""",
    ),
)
def _(t: Tables) -> DataFrame:
    events = t.classified().filter("task = 'incident'")
    rate = events.filter("split = 'train'").groupBy("horizon").agg(F.avg("actual_class_index").alias("q"))
    valid = events.filter("split = 'validation'")
    raw = metrics.probability_quality(valid, ["horizon"])
    level = valid.join(rate, "horizon").withColumn("probabilities", F.array(1 - F.col("q"), F.col("q")))
    return metrics.calibration_decision(raw, metrics.probability_quality(level, ["horizon"]), ["horizon"], 0.0001)


# -- uncertainty -------------------------------------------------------------------------------------


@query(
    "CF1_conformal_widths",
    with_ctes("widths", f"SELECT model_version, target, horizon, horizon_minutes, calibration_rows, finite_sample_rank, {r('width')} AS width FROM widths"),
)
def _(t: Tables) -> DataFrame:
    out = uncertainty.conformal_widths(t.forecasts(), 0.9)
    return out.select("model_version", "target", "horizon", "horizon_minutes", "calibration_rows", "finite_sample_rank", rounded(F.col("width")).alias("width"))


@query(
    "CF2_intervals",
    with_ctes("enriched", f"SELECT entity, ts, horizon, model_version, {r('signed_error')} AS signed_error, {r('absolute_error')} AS absolute_error, {r('interval_lower')} AS interval_lower, {r('interval_upper')} AS interval_upper, {r('interval_width')} AS interval_width, interval_covered FROM enriched"),
)
def _(t: Tables) -> DataFrame:
    preds = t.forecasts()
    out = enrich.attach_width(preds, uncertainty.conformal_widths(preds, 0.9), uncertainty.CALIBRATION_KEY)
    out = out.withColumns(uncertainty.interval_columns())
    names = ("signed_error", "absolute_error", "interval_lower", "interval_upper", "interval_width")
    return out.select("entity", "ts", "horizon", "model_version", *[rounded(F.col(n)).alias(n) for n in names], "interval_covered")


_BIAS = f"{nudged('avg(signed_error)')} AS bias, {nudged('stddev_pop(signed_error)')} AS residual_standard_deviation, {r('avg(CAST(interval_covered AS INTEGER))', 10)} AS interval_coverage, {nudged('avg(interval_width)')} AS mean_interval_width"


@query("CF3_coverage_table", with_ctes("enriched", f"SELECT model_version, target, horizon, split, {_REG}{_REG_N}, {_BIAS}, CAST(0.9 AS DOUBLE) AS confidence_level FROM enriched GROUP BY 1, 2, 3, 4"))
def _(t: Tables) -> DataFrame:
    return shown(slices.regression_coverage(enriched(t), _MODEL))


_ENT = "list_sum(list_transform(probabilities, lambda p: -p * ln(greatest(p, 2.2250738585072014e-308))))"
cte(
    "cls_ctx",
    f"""SELECT c.*, list_max(probabilities) AS max_probability, {_ENT} AS entropy, {_ENT} / ln(len(probabilities)) AS normalized_entropy,
    CASE WHEN list_max(probabilities) >= 0.8 THEN 'high' WHEN list_max(probabilities) >= 0.55 THEN 'medium' ELSE 'low' END AS confidence_band,
    CASE WHEN operating_threshold IS NULL THEN NULL WHEN event_probability < operating_threshold * 0.5 THEN 'low' WHEN event_probability < operating_threshold THEN 'elevated'
      WHEN event_probability < least(1.0, operating_threshold * 2) THEN 'high' ELSE 'critical' END AS risk_band,
    x.origin_hour, x.weekday, x.weekday_type, x.peak_status, x.condition, CASE c.horizon WHEN 1 THEN level_h1 WHEN 2 THEN level_h2 WHEN 3 THEN level_h3 ELSE level_h4 END AS actual_level
    FROM classified c LEFT JOIN context x USING (entity, ts)""",
    "classified",
    "context",
)


@query(
    "CF4_confidence_bands",
    with_ctes("cls_ctx", f"SELECT entity, ts, task, horizon, {r('max_probability')} AS max_probability, {r('entropy')} AS entropy, {r('normalized_entropy')} AS normalized_entropy, confidence_band, actual_class_index = predicted_class_index AS correct FROM cls_ctx"),
)
def _(t: Tables) -> DataFrame:
    out = t.classified().withColumns(uncertainty.confidence_columns())
    return out.select("entity", "ts", "task", "horizon", *[rounded(F.col(n)).alias(n) for n in ("max_probability", "entropy", "normalized_entropy")], "confidence_band", "correct")


@query("CF5_risk_bands", with_ctes("cls_ctx", "SELECT entity, ts, horizon, risk_band FROM cls_ctx WHERE task = 'incident'"))
def _(t: Tables) -> DataFrame:
    band = uncertainty.risk_band(F.col("event_probability"), F.col("operating_threshold"))
    return t.classified().filter("task = 'incident'").select("entity", "ts", "horizon", band.alias("risk_band"))


@query(
    "CF6_risk_band_table",
    with_ctes(
        "cls_ctx",
        f"""SELECT g.horizon, g.split, b.x AS risk_band, {r('CASE b.i WHEN 0 THEN 0 WHEN 1 THEN g.th * 0.5 WHEN 2 THEN g.th ELSE least(1.0, g.th * 2) END')} AS probability_lower,
        {r('CASE b.i WHEN 0 THEN g.th * 0.5 WHEN 1 THEN g.th WHEN 2 THEN least(1.0, g.th * 2) ELSE 1 END')} AS probability_upper, count(c.entity) AS rows, CAST(coalesce(sum(c.actual_class_index), 0) AS BIGINT) AS event_rows,
        {r('avg(c.actual_class_index)')} AS observed_event_rate, {r('avg(c.event_probability)')} AS mean_probability
        FROM (SELECT horizon, split, max(operating_threshold) AS th FROM classified WHERE task = 'incident' GROUP BY 1, 2) g CROSS JOIN (VALUES (0, 'low'), (1, 'elevated'), (2, 'high'), (3, 'critical')) b(i, x)
        LEFT JOIN cls_ctx c ON c.task = 'incident' AND c.horizon = g.horizon AND c.split = g.split AND c.risk_band = b.x GROUP BY 1, 2, 3, b.i, g.th""",
    ),
)
def _(t: Tables) -> DataFrame:
    band = uncertainty.risk_band(F.col("event_probability"), F.col("operating_threshold"))
    events = t.classified().filter("task = 'incident'").withColumn("risk_band", band)
    return uncertainty.risk_band_table(events, ["horizon", "split"])


cte("rel_rows", "SELECT task, horizon, split, CASE WHEN task = 'level' THEN list_max(probabilities) ELSE event_probability END AS p, CASE WHEN task = 'level' THEN CAST(actual_class_index = predicted_class_index AS INTEGER) ELSE actual_class_index END AS y FROM classified", "classified")
cte(
    "rel",
    """SELECT g.task, g.horizon, g.split, CAST(b.i AS INTEGER) AS bin_index, b.i / 10 AS bin_lower, (b.i + 1) / 10 AS bin_upper, coalesce(x.n, 0) AS rows, x.p AS mean_probability, x.y AS observed_rate, abs(x.p - x.y) AS absolute_gap, g.ece
    FROM (SELECT task, horizon, split, sum(n * abs(p - y)) / sum(n) AS ece FROM (SELECT task, horizon, split, count(*) AS n, avg(p) AS p, avg(y) AS y FROM rel_rows GROUP BY 1, 2, 3, least(floor(p * 10), 9)) GROUP BY 1, 2, 3) g
    CROSS JOIN range(10) b(i) LEFT JOIN (SELECT task, horizon, split, least(floor(p * 10), 9) AS i, count(*) AS n, avg(p) AS p, avg(y) AS y FROM rel_rows GROUP BY 1, 2, 3, 4) x
    ON x.task = g.task AND x.horizon = g.horizon AND x.split = g.split AND x.i = b.i""",
    "rel_rows",
)


@query(
    "CF7_reliability_table",
    with_ctes("rel", f"SELECT task, horizon, split, bin_index, {r('bin_lower')} AS bin_lower, {r('bin_upper')} AS bin_upper, rows, {r('mean_probability')} AS mean_probability, {r('observed_rate')} AS observed_rate, {r('absolute_gap')} AS absolute_gap, {r('ece')} AS expected_calibration_error FROM rel"),
)
def _(t: Tables) -> DataFrame:
    return uncertainty.reliability_table(uncertainty.reliability_rows(t.classified()), ["task", "horizon", "split"], 10)


@query("CF8_calibration_error", with_ctes("rel", f"SELECT task, horizon, split, CAST(sum(rows) AS BIGINT) AS rows, count(*) FILTER (rows > 0) AS populated_bins, {r('max(ece)')} AS expected_calibration_error FROM rel GROUP BY 1, 2, 3"))
def _(t: Tables) -> DataFrame:
    return uncertainty.calibration_error(uncertainty.reliability_rows(t.classified()), ["task", "horizon", "split"], 10)


# -- slices ------------------------------------------------------------------------------------------
_UNNEST = "unnest([{'d': 'overall', 'v': 'all'}, " + ", ".join(f"{{'d': '{d}', 'v': CAST({d} AS VARCHAR)}}" for d in DIMENSIONS) + "])"
for _name, _source in (("reg_slices", "enriched"), ("cls_slices", "cls_ctx")):
    cte(_name, f"SELECT *, s.d AS dimension, s.v AS slice_value FROM (SELECT *, {_UNNEST} AS s FROM {_source}) WHERE s.v IS NOT NULL", _source)


def _guard(expr: str, enough: str, names: list[str]) -> str:
    return f"SELECT * EXCLUDE ({', '.join(names)}, rows), rows, {enough} AS sufficient_support, " + ", ".join(f"CASE WHEN {enough} THEN {n} END AS {n}" for n in names) + f" FROM ({expr})"


_REGN = ["rmse", "mae", "mape_percent", "r_squared", "bias", "residual_standard_deviation", "interval_coverage", "mean_interval_width", "residual_q10", "residual_median", "residual_q90"]


@query(
    "CF9_regression_slices",
    with_ctes(
        "reg_slices",
        _guard(
            f"SELECT model_version, target, horizon, split, dimension, slice_value, {_REG}, {_BIAS}, {nudged('quantile_cont(signed_error, 0.1)')} AS residual_q10, {nudged('quantile_cont(signed_error, 0.5)')} AS residual_median, {nudged('quantile_cont(signed_error, 0.9)')} AS residual_q90 FROM reg_slices GROUP BY 1, 2, 3, 4, 5, 6",
            f"rows >= {MINIMUM}", _REGN,
        ),
    ),
)
def _(t: Tables) -> DataFrame:
    return shown(slices.regression_slices(durable(enriched(t)), _MODEL, DIMENSIONS, MINIMUM))


@query(
    "CF10_class_slices",
    with_ctes(
        "cls_slices",
        _guard(
            f"SELECT horizon, split, dimension, slice_value, {_ACC}, {nudged('avg(max_probability)')} AS mean_confidence, {nudged('avg(normalized_entropy)')} AS mean_normalized_entropy FROM cls_slices WHERE task = 'level' GROUP BY 1, 2, 3, 4",
            f"rows >= {MINIMUM}", ["accuracy", "macro_precision", "macro_recall", "macro_f1", "mean_confidence", "mean_normalized_entropy"],
        ),
    ),
)
def _(t: Tables) -> DataFrame:
    return shown(slices.class_slices(scored_classes(t).filter("task = 'level'"), ["horizon", "split"], DIMENSIONS, 4, MINIMUM))


_EV = "rows >= 40 AND positive_rows >= 3 AND positive_rows < rows"


@query(
    "CF11_event_slices",
    with_ctes(
        "cls_slices",
        _guard(
            f"SELECT a.horizon, a.split, a.dimension, a.slice_value, a.rows, b.positive_rows, a.accuracy, a.precision, a.recall, a.f1, b.roc_auc, b.pr_auc, b.positive_rate AS prevalence, a.mean_confidence, a.mean_normalized_entropy, TRUE AS single_threshold FROM "
            f"(SELECT horizon, split, dimension, slice_value, {_point('event_probability >= operating_threshold', 'actual_class_index = 1')}, {nudged('avg(max_probability)')} AS mean_confidence, {nudged('avg(normalized_entropy)')} AS mean_normalized_entropy FROM cls_slices WHERE task = 'incident' GROUP BY 1, 2, 3, 4) a "
            f"JOIN ({_rank_sql('horizon, split, dimension, slice_value', 'event_probability', 'actual_class_index', '(SELECT * FROM cls_slices WHERE task = ' + chr(39) + 'incident' + chr(39) + ')')}) b USING (horizon, split, dimension, slice_value)",
            _EV, ["accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc", "prevalence", "mean_confidence", "mean_normalized_entropy"],
        ),
    ),
)
def _(t: Tables) -> DataFrame:
    return shown(slices.event_slices(durable(scored_classes(t).filter("task = 'incident'")), ["horizon", "split"], DIMENSIONS, MINIMUM, 3))


@query(
    "CF12_confusion_slices",
    with_ctes(
        "cls_slices",
        f"SELECT g.horizon, g.split, g.dimension, g.slice_value, a.x AS actual_label, p.x AS predicted_label, coalesce(c.n, 0) AS rows FROM (SELECT horizon, split, dimension, slice_value FROM cls_slices WHERE task = 'level' GROUP BY 1, 2, 3, 4 HAVING count(*) >= {MINIMUM}) g "
        f"CROSS JOIN {_NAMES} a(i, x) CROSS JOIN {_NAMES} p(i, x) LEFT JOIN (SELECT horizon, split, dimension, slice_value, {_A}, {_P}, count(*) AS n FROM cls_slices WHERE task = 'level' GROUP BY ALL) c "
        f"ON c.horizon = g.horizon AND c.split = g.split AND c.dimension = g.dimension AND c.slice_value = g.slice_value AND c.{_A} = a.i AND c.{_P} = p.i",
    ),
)
def _(t: Tables) -> DataFrame:
    return slices.confusion_slices(scored_classes(t).filter("task = 'level'"), ["horizon", "split"], DIMENSIONS, LEVELS, MINIMUM)


_WIN = "CASE WHEN absolute_error_first < absolute_error_second THEN 'first' WHEN absolute_error_second < absolute_error_first THEN 'second' ELSE 'tie' END"


@query("CF13_row_winner", with_ctes("paired", f"SELECT entity, ts, horizon, {r('absolute_error_second - absolute_error_first')} AS error_delta, {_WIN} AS winner FROM paired"))
def _(t: Tables) -> DataFrame:
    return paired(t).select("entity", "ts", "horizon", rounded(F.col("error_delta")).alias("error_delta"), "winner")


def _rmse(p: str) -> str:
    return r(f"sqrt(avg(({p} - actual) * ({p} - actual)))", 10)


cte(
    "pair_slices",
    "SELECT *, s.d AS dimension, s.v AS slice_value FROM (SELECT p.*, " + _WIN + " AS winner, unnest([{'d': 'overall', 'v': 'all'}, {'d': 'entity', 'v': entity}, {'d': 'weekday', 'v': dayname(ts)}]) AS s FROM paired p)",
    "paired",
)
cte(
    "pair_table",
    _guard(
        f"SELECT *, {nudged('rmse_second - rmse_first')} AS rmse_delta FROM (SELECT horizon, split, dimension, slice_value, count(*) AS rows, {_rmse('prediction_first')} AS rmse_first, {_rmse('prediction_second')} AS rmse_second, "
        f"{r('avg(abs(prediction_first - actual))', 10)} AS mae_first, {r('avg(abs(prediction_second - actual))', 10)} AS mae_second, {nudged('avg(absolute_error_second - absolute_error_first)')} AS mean_error_delta, "
        f"{r('avg(CAST(winner = ' + chr(39) + 'second' + chr(39) + ' AS INTEGER))', 10)} AS second_win_rate FROM pair_slices GROUP BY 1, 2, 3, 4)",
        f"rows >= {MINIMUM}", ["rmse_first", "rmse_second", "mae_first", "mae_second", "mean_error_delta", "second_win_rate", "rmse_delta"],
    ),
    "pair_slices",
)


def pair_table(t: Tables) -> DataFrame:
    rows = paired(t).withColumn("weekday", F.date_format("ts", "EEEE"))
    return slices.paired_slices(rows, ["horizon", "split"], ["entity", "weekday"], MINIMUM)


@query("CF14_paired_slices", with_ctes("pair_table", "SELECT * FROM pair_table"))
def _(t: Tables) -> DataFrame:
    return shown(pair_table(t))


@query(
    "CF15_model_comparison",
    with_ctes(
        "paired",
        f"SELECT horizon, count(*) AS rows, {_rmse('prediction_second')} AS left_rmse, {_rmse('prediction_first')} AS right_rmse, TRUE AS mapping_complete, TRUE AS actuals_identical, TRUE AS target_ts_identical, "
        f"{nudged(_rmse('prediction_second') + ' - ' + _rmse('prediction_first'))} AS rmse_delta, {_rmse('prediction_second')} < {_rmse('prediction_first')} AS left_wins FROM paired WHERE split = 'test' GROUP BY 1",
    ),
)
def _(t: Tables) -> DataFrame:
    test = t.forecasts().filter("split = 'test'")
    out = enrich.compare_forecasts(
        test.filter("model_version = 'same_window_yesterday'"), test.filter("model_version = 'last_value'"), ["entity", "ts", "horizon"]
    )
    return shown(slices.model_comparison(out, ["horizon"]))


@query(
    "CF16_coverage_diagnostics",
    with_ctes(
        "enriched",
        f"SELECT CAST(0.9 AS DOUBLE) AS nominal, count(*) AS groups, count(*) FILTER (c < 0.9) AS below_nominal, min(c) AS minimum_coverage, max(c) AS maximum_coverage FROM (SELECT {r('avg(CAST(interval_covered AS INTEGER))', 10)} AS c FROM enriched WHERE split = 'test' GROUP BY model_version, target, horizon)",
    ),
)
def _(t: Tables) -> DataFrame:
    return slices.coverage_extremes(slices.regression_coverage(enriched(t), _MODEL), 0.9)


@query(
    "CF16b_dominant_confusion",
    with_ctes("classified", f"SELECT horizon, a.x AS actual_label, p.x AS predicted_label, n AS rows FROM (SELECT horizon, {_A} AS ai, {_P} AS pi, count(*) AS n FROM {_LEVEL_ROWS} WHERE split = 'test' AND {_A} <> {_P} GROUP BY 1, 2, 3) JOIN {_NAMES} a(i, x) ON a.i = ai JOIN {_NAMES} p(i, x) ON p.i = pi ORDER BY n DESC, horizon, actual_label, predicted_label LIMIT 1"),
)
def _(t: Tables) -> DataFrame:
    cells = slices.confusion_slices(t.classified().filter("task = 'level'"), ["horizon", "split"], [], LEVELS, 0)
    return slices.dominant_confusion(cells)


@query("CF16c_worst_slices", with_ctes("pair_table", "SELECT horizon, dimension, slice_value, rows, rmse_delta FROM pair_table WHERE split = 'test' AND dimension <> 'overall' AND sufficient_support ORDER BY rmse_delta DESC, horizon, dimension, slice_value LIMIT 5"))
def _(t: Tables) -> DataFrame:
    return shown(slices.worst_slices(pair_table(t)))


@query("CF16d_winning_horizons", with_ctes("pair_table", "SELECT count(*) AS horizons, count(*) FILTER (rmse_delta < 0) AS second_wins FROM pair_table WHERE split = 'test' AND dimension = 'overall'"))
def _(t: Tables) -> DataFrame:
    return slices.winning_horizons(pair_table(t))


@query(
    "CF17_analysis_checks",
    with_ctes(
        "enriched",
        "SELECT v.x AS \"check\", CASE WHEN v.x = 'all_context_rows_mapped' THEN bad = 0 ELSE n > 0 END AS passed FROM (SELECT count(*) AS n, count(*) FILTER (actual_level IS NULL) AS bad FROM enriched), (VALUES ('calibration_uses_validation_only'),('regression_rows_reconciled'),"
        "('classification_rows_reconciled'),('all_context_rows_mapped'),('all_intervals_ordered'),('all_probabilities_finite')) v(x)",
    ),
)
def _(t: Tables) -> DataFrame:
    preds, classes = durable(t.forecasts()), durable(t.classified())
    widths = durable(uncertainty.conformal_widths(preds, 0.9))
    return slices.analysis_checks(preds, enriched(t, preds, widths), scored_classes(t, classes), classes, widths)


