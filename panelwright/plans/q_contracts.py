"""Queries over contract validation and quarantine (VA)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import durable
from ..functions.scalars import is_blank
from ..operators import clean, enrich, features
from ..operators import contracts as c
from ..operators.stages import StageCounters, session_of_its_own
from .frames import SPEC, Tables
from .registry import query
from .sql import cte, with_ctes

# The contract the raw event feed is held to.
KINDS = ("click", "view", "purchase", "signup", "error")
LEVEL_MAP = {"free-flow": "Free-flow", "moderate": "Moderate", "heavy": "Heavy", "severe": "Severe"}
RAW = c.Contract(
    dataset="events",
    columns=("entity", "station", "date", "time", "volume", "speed", "mix", "level", "flag", "flag_name"),
    clock=c.Clock("date", r"\d{4}-\d{2}-\d{2}", "yyyy-MM-dd", "ts", "time", r"\d{2}:\d{2}", "HH:mm", 30),
    key=("entity", "ts"),
    texts=(c.Text("station"),),
    categories=(
        c.Category("entity", allowed=KINDS),
        c.Category("level", mapping=LEVEL_MAP, nullable=True, report_missing=True, disposition=c.CELL),
    ),
    numbers=(
        c.Number("volume", integer=True, nullable=True, report_missing=True, minimum=0),
        c.Number("speed", nullable=True, report_missing=True, maximum=200, maximum_reason="excessive_speed"),
        c.Number("flag", integer=True, disposition=c.ROW, invalid_reason="invalid_flag", allowed=(0, 1)),
    ),
    shares=(c.Shares("mix", ("a", "b")),),
    flag_names=(("flag", "flag_name"),),
)

_NUM = r"\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*"


def _number(col: str) -> str:
    return f"CASE WHEN regexp_full_match({col}, '{_NUM}') THEN try_cast(trim({col}) AS DOUBLE) END"


def _blank(col: str) -> str:
    return f"coalesce(trim({col}) = '', TRUE)"


cte(
    "va_parsed",
    f"""SELECT *, {_number('volume')} AS vn, {_number('speed')} AS sn, {_number('flag')} AS fn,
    CASE WHEN regexp_full_match(date, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AND regexp_full_match(time, '\\d{{2}}:\\d{{2}}')
      AND minute(try_strptime(date || ' ' || time, '%Y-%m-%d %H:%M')) % 30 = 0
      THEN try_strptime(date || ' ' || time, '%Y-%m-%d %H:%M') END AS ts,
    coalesce(CASE WHEN json_valid(mix) THEN list_sort(json_keys(mix)) = ['a', 'b']
      AND json_type(mix, '$.a') IN ('DOUBLE', 'UBIGINT', 'BIGINT') AND json_type(mix, '$.b') IN ('DOUBLE', 'UBIGINT', 'BIGINT')
      AND CAST(json_extract_string(mix, '$.a') AS VARCHAR) NOT IN ('true', 'false')
      AND try_cast(json_extract_string(mix, '$.a') AS DOUBLE) BETWEEN 0 AND 1
      AND try_cast(json_extract_string(mix, '$.b') AS DOUBLE) BETWEEN 0 AND 1
      AND abs(try_cast(json_extract_string(mix, '$.a') AS DOUBLE) + try_cast(json_extract_string(mix, '$.b') AS DOUBLE) - 1) <= 0.02
      END, FALSE) AS mix_ok FROM raw""",
    "raw",
)

_CELL, _ROW = "cell_invalidated", "row_rejected"
_KNOWN = "entity IN ('click','view','purchase','signup','error')"
_LEVELS = "lower(trim(level)) IN ('free-flow','moderate','heavy','severe')"
_RULES = [
    ("station", "missing_value", _ROW, "Required string value is blank", _blank("station")),
    ("entity", "missing_key", _ROW, "Categorical value is blank", _blank("entity")),
    ("entity", "invalid_category", _ROW, "Value is outside the configured categorical vocabulary", f"NOT {_blank('entity')} AND NOT {_KNOWN}"),
    ("level", "missing_value", _CELL, "Categorical value is blank", _blank("level")),
    ("level", "invalid_category", _CELL, "Value is outside the configured categorical vocabulary", f"NOT {_blank('level')} AND NOT {_LEVELS}"),
    ("volume", "invalid_type", _CELL, "Value cannot be coerced to the configured numeric type", f"NOT {_blank('volume')} AND (vn IS NULL OR vn % 1 <> 0)"),
    ("volume", "missing_value", _CELL, "Numeric value is missing", _blank("volume")),
    ("volume", "invalid_numeric_range", _CELL, "Numeric value is below the configured physical minimum", "vn % 1 = 0 AND vn < 0"),
    ("speed", "invalid_type", _CELL, "Value cannot be coerced to the configured numeric type", f"NOT {_blank('speed')} AND sn IS NULL"),
    ("speed", "missing_value", _CELL, "Numeric value is missing", _blank("speed")),
    ("speed", "excessive_speed", _CELL, "Numeric value exceeds the configured physical maximum", "sn > 200"),
    ("flag", "invalid_flag", _ROW, "Numeric value is outside the configured allowed set", "fn NOT IN (0, 1)"),
    ("mix", "invalid_json", _CELL, "JSON object must contain valid near-unit vehicle-class shares", "NOT mix_ok"),
    ("time", "invalid_timestamp", _ROW, "Date/time does not match the exact source format and frequency", "ts IS NULL"),
    ("flag_name", "missing_flag_name", _ROW, "flag_name is required when flag=1", f"fn = 1 AND {_blank('flag_name')}"),
    ("flag_name", "unexpected_flag_name", _ROW, "flag_name must be blank when flag=0", f"fn = 0 AND NOT {_blank('flag_name')}"),
]


def _rule_sql(rule, source: str = "va_parsed") -> str:
    name, reason, disposition, message, where = rule
    return (
        f"SELECT source_row, '{name}' AS field, CAST(to_json({name}) AS VARCHAR) AS rejected_value, '{reason}' AS reason_code, "
        f"'{disposition}' AS disposition, '{message}' AS message, CAST(NULL AS BIGINT) AS retained_source_row FROM {source} WHERE {where}"
    )


_VALUE = "CASE WHEN rejected_value = 'null' THEN NULL ELSE rejected_value END"
cte("va_cells", " UNION ALL ".join(_rule_sql(x) for x in _RULES), "va_parsed")
cte(
    "va_ranked",
    f"""SELECT p.*, row_number() OVER k AS rn, first_value(source_row) OVER k AS kept FROM (
      SELECT *, (entity IS NOT NULL)::INT + (station IS NOT NULL)::INT + (date IS NOT NULL)::INT + (time IS NOT NULL)::INT
        + (flag_name IS NOT NULL)::INT + (vn % 1 = 0 AND vn >= 0 AND vn IS NOT NULL)::INT + (sn <= 200 AND sn IS NOT NULL)::INT
        + (fn IN (0, 1) AND fn IS NOT NULL)::INT + mix_ok::INT + ({_LEVELS} AND level IS NOT NULL)::INT AS complete
      FROM va_parsed WHERE source_row NOT IN (SELECT source_row FROM va_cells WHERE disposition = 'row_rejected')) p
    WINDOW k AS (PARTITION BY entity, ts ORDER BY complete DESC, source_row)""",
    "va_parsed",
    "va_cells",
)
_SAME = " AND ".join(f"a.{x} IS NOT DISTINCT FROM b.{x}" for x in RAW.columns)
cte(
    "va_issues",
    f"""SELECT 'events' AS dataset, 'events' AS source_file, source_row, field, {_VALUE} AS rejected_value, reason_code, disposition,
    message, retained_source_row FROM va_cells UNION ALL
    SELECT 'events', 'events', a.source_row, 'entity|ts', NULL, 'duplicate_key', 'row_rejected',
    'Duplicate key removed; exact_duplicate=' || CASE WHEN {_SAME} THEN 'true' ELSE 'false' END, a.kept
    FROM va_ranked a JOIN va_parsed b ON b.source_row = a.kept WHERE a.rn > 1""",
    "va_cells",
    "va_ranked",
)


def _ledger(t: Tables, findings: list[Column]) -> DataFrame:
    frame = t.raw().select("*", F.array_compact(F.array(*findings)).alias("f"))
    return frame.select("source_row", F.explode("f").alias("i")).select(
        "source_row", "i.field", "i.rejected_value", "i.reason_code", "i.disposition"
    )


def _expect(*places: int) -> str:
    body = " UNION ALL ".join(_rule_sql(_RULES[i]) for i in places)
    return with_ctes(
        "va_parsed", f"SELECT source_row, field, {_VALUE} AS rejected_value, reason_code, disposition FROM ({body})"
    )




@query(
    "VA1_closed_schema",
    "SELECT field, reason_code, n AS rejected_rows FROM (SELECT count(*) AS n FROM events), (VALUES "
    "('level','missing_required_column'),('extra','unexpected_column')) v(field, reason_code)",
)
def _(t: Tables) -> DataFrame:
    broken = t.raw().drop("level").withColumn("extra", F.lit("x"))
    result = c.validate(broken, RAW)
    n = result.rejected.agg(F.count(F.lit(1))).scalar()
    return result.issues.select("field", "reason_code", n.alias("rejected_rows"))


@query("VA1b_detect_contract", "SELECT 'events' AS dataset, count(*) AS rows FROM events")
def _(t: Tables) -> DataFrame:
    raw = t.raw()
    found = c.detect(raw.columns, [RAW])
    return raw.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(found.dataset).alias("dataset"), "rows")


@query(
    "VA3_blank_test",
    with_ctes("raw", " UNION ALL ".join(
        f"SELECT '{x}' AS field, count(*) FILTER ({_blank(x)}) AS blank_rows FROM raw" for x in ("entity", "station", "level", "flag_name"))),
)
def _(t: Tables) -> DataFrame:
    fields = ("entity", "station", "level", "flag_name")
    out = t.raw().agg(*[F.count_if(is_blank(F.col(x))).alias(x) for x in fields])
    return out.unpivot([], list(fields), "field", "blank_rows")


@query("VA4_required_strings", _expect(0))
def _(t: Tables) -> DataFrame:
    return _ledger(t, c.text_findings(RAW.texts[0]))


@query("VA5_category_vocabulary", _expect(1, 2))
def _(t: Tables) -> DataFrame:
    return _ledger(t, c.category_findings(RAW.categories[0]))


@query("VA6_normalised_vocabulary", _expect(3, 4))
def _(t: Tables) -> DataFrame:
    return _ledger(t, c.category_findings(RAW.categories[1]))


@query("VA7_numeric_coercion", _expect(5, 8))
def _(t: Tables) -> DataFrame:
    found = c.number_findings(RAW.numbers[0])[:1] + c.number_findings(RAW.numbers[1])[:1]
    return _ledger(t, found)


@query("VA8_range_rules", _expect(7, 10))
def _(t: Tables) -> DataFrame:
    return _ledger(t, c.number_findings(RAW.numbers[0])[2:] + c.number_findings(RAW.numbers[1])[2:])


@query("VA9_allowed_numbers", _expect(11))
def _(t: Tables) -> DataFrame:
    return _ledger(t, c.number_findings(RAW.numbers[2]))


@query(
    "VA10_cell_invalidation",
    with_ctes(
        "va_parsed",
        "SELECT source_row, CASE WHEN vn % 1 = 0 AND vn >= 0 THEN CAST(vn AS BIGINT) END AS volume, CASE WHEN sn <= 200 THEN sn END AS speed FROM va_parsed",
    ),
)
def _(t: Tables) -> DataFrame:
    v, s = RAW.numbers[:2]
    return t.raw().select("source_row", c.number_value(v).alias("volume"), c.number_value(s).alias("speed"))


@query("VA11_json_shares", _expect(12))
def _(t: Tables) -> DataFrame:
    return _ledger(t, c.share_findings(RAW.shares[0]))


@query("VA12_strict_timestamp", with_ctes("va_parsed", "SELECT source_row, ts FROM va_parsed"))
def _(t: Tables) -> DataFrame:
    return t.raw().select("source_row", c.clock_value(RAW.clock).alias("ts"))


@query(
    "VA12b_strict_date",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 3 THEN CAST(o_orderdate AS DATE) END AS day FROM orders",
)
def _(t: Tables) -> DataFrame:
    odd = F.pmod("o_orderkey", F.lit(10)) == 3
    text = F.when(odd, F.date_format("o_orderdate", "d/M/yyyy")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    text = F.when(odd, F.concat(F.lit("x"), text)).otherwise(text)
    rule = c.Clock("day", r"\d{2}/\d{2}/\d{4}", "dd/MM/yyyy", "day")
    return t.orders.select("o_orderkey", text.alias("day")).withColumn("day", c.clock_value(rule))


@query("VA13_flag_names", _expect(14, 15))
def _(t: Tables) -> DataFrame:
    return _ledger(t, c.flag_name_findings(RAW))


@query(
    "VA14_missing_keys",
    with_ctes(
        "raw",
        "SELECT source_row, 'entity|station' AS field, 'missing_key' AS reason_code FROM raw WHERE (entity IS NULL OR station IS NULL)",
    ),
)
def _(t: Tables) -> DataFrame:
    loose = c.Contract("events", RAW.columns, RAW.clock, ("entity", "station"))
    # Only the key rule: an always-valid clock keeps other rejections out of the way.
    frame = t.raw().withColumns({"date": F.lit("2024-01-01"), "time": F.lit("00:00")})
    marked = c.annotate_cells(frame, loose)
    return c.issue_ledger(marked, loose).filter("reason_code = 'missing_key'").select("source_row", "field", "reason_code")


@query(
    "VA15_duplicate_retention",
    with_ctes("va_issues", "SELECT source_row, retained_source_row, message FROM va_issues WHERE reason_code = 'duplicate_key'"),
)
def _(t: Tables) -> DataFrame:
    marked = c.annotate(t.raw(), RAW)
    return c.issue_ledger(marked, RAW).filter("reason_code = 'duplicate_key'").select(
        "source_row", "retained_source_row", "message"
    )


@query(
    "VA16_valid_rows",
    with_ctes(
        "va_issues va_parsed",
        """SELECT p.source_row, entity, ts, CASE WHEN vn % 1 = 0 AND vn >= 0 THEN CAST(vn AS BIGINT) END AS volume,
        CASE WHEN EXISTS (SELECT 1 FROM va_cells i WHERE i.source_row = p.source_row AND i.disposition = 'cell_invalidated')
        THEN 'valid_with_issues' ELSE 'valid' END AS validation_status FROM va_parsed p
        WHERE source_row NOT IN (SELECT source_row FROM va_issues WHERE disposition = 'row_rejected')""",
    ),
)
def _(t: Tables) -> DataFrame:
    return c.validate(t.raw(), RAW).valid.select("source_row", "entity", "ts", "volume", "validation_status")


@query(
    "VA16b_rejected_rows",
    with_ctes(
        "va_issues raw",
        """SELECT p.source_row, entity, date, time, volume, 'rejected' AS validation_status, r.reasons AS rejection_reason FROM raw p JOIN
        (SELECT source_row, array_to_string(list_sort(list_distinct(list(reason_code))), '|') AS reasons FROM va_issues
         WHERE disposition = 'row_rejected' GROUP BY 1) r USING (source_row)""",
    ),
)
def _(t: Tables) -> DataFrame:
    return c.validate(t.raw(), RAW).rejected.select(
        "source_row", "entity", "date", "time", "volume", "validation_status", "rejection_reason"
    )


@query("VA17_issue_ledger", with_ctes("va_issues", "SELECT * FROM va_issues"))
def _(t: Tables) -> DataFrame:
    # A range sort samples its input first; the stored ledger is not validated twice for it.
    return c.sort_ledger(durable(c.validate(t.raw(), RAW).issues))


@query(
    "VA18_issue_counts",
    with_ctes(
        "va_issues",
        "SELECT 'reason' AS kind, reason_code AS code, count(*) AS issues FROM va_issues GROUP BY 2 "
        "UNION ALL SELECT 'disposition', disposition, count(*) FROM va_issues GROUP BY 2",
    ),
)
def _(t: Tables) -> DataFrame:
    return c.issue_counts(c.validate(t.raw(), RAW).issues)


_REJ = "(SELECT count(DISTINCT source_row) FROM va_issues WHERE disposition = 'row_rejected')"


@query(
    "VA19_row_accounting",
    with_ctes(
        "va_issues raw",
        f"SELECT 'events' AS dataset, count(*) AS input_rows, count(*) - {_REJ} AS valid_rows, {_REJ} AS rejected_rows, TRUE AS accounted FROM raw",
    ),
)
def _(t: Tables) -> DataFrame:
    return c.row_accounting(c.annotate(t.raw(), RAW), "events")


@query(
    "VA19b_accounting_total",
    with_ctes(
        "va_issues raw",
        """SELECT coalesce(d, 'total') AS dataset, count(*) AS input_rows, count(*) FILTER (NOT bad) AS valid_rows, count(*) FILTER (bad) AS rejected_rows, TRUE AS accounted
        FROM (SELECT CASE WHEN source_row % 2 = 0 THEN 'even' ELSE 'odd' END AS d, source_row IN (SELECT source_row FROM va_issues WHERE disposition = 'row_rejected') AS bad FROM raw) GROUP BY ROLLUP (d)""",
    ),
)
def _(t: Tables) -> DataFrame:
    """Two deliveries and their total."""
    marked = c.annotate(t.raw(), RAW).withColumn("_dataset", F.when(F.col("source_row") % 2 == 0, "even").otherwise("odd"))
    return c.accounting_with_total(marked, "_dataset")


_STAGE_CHECKS = (
    "raw_validation_input_rows", "validation_row_accounting", "traffic_duplicate_accounting", "traffic_grid_accounting", "context_rows_preserved",
    "merge_cardinality", "join_coverage", "feature_cardinality", "processed_cardinality",
)


def _stage_run(t: Tables, broken: frozenset[str] = frozenset()) -> DataFrame:
    """Log to features in stored stages, each counted by its own job; ``broken`` names defects to put in."""
    spark, t = t.spark, Tables(session_of_its_own(t.spark), t.path)
    n, run = F.count(F.lit(1)), StageCounters()
    ok, duplicate = F.size("_reject") == 0, F.array_contains("_reject", "duplicate_key")
    raw = run.watch("raw", t.raw(), rows=n)
    marked = c.annotate(raw, RAW)
    if "validation loses rows" in broken:
        marked = marked.filter(F.col("source_row") % 7 != 0)
    marked = run.run(
        "validation", marked, input=n, valid=F.count_if(ok), rejected=F.count_if(~ok), keyed=F.count_if(ok | duplicate), duplicates=F.count_if(duplicate)
    )
    facts = c.valid_rows(marked).select("entity", "ts", "volume").withColumn("grp", F.lit("all"))
    facts = run.run("facts", facts, input=n)
    grid = clean.complete_grid(facts, SPEC, ["grp"], **clean.day_bounds(facts, SPEC))
    grid = run.run("grid", grid, inserted=F.count_if("inserted"), output=n)
    # One context row for an hour, whatever the group.
    hours = t.hourly().groupBy("hour").agg(F.min("condition").alias("condition"), F.avg("temperature").alias("temperature")).withColumn("grp", F.lit("all"))
    hourly = run.watch("hourly", hours, input=n)
    hourly = run.run("hourly", clean.canonical_labels(hourly, "condition", clean.CONDITION_MAP).select("grp", "hour", "condition", "temperature"), output=n)
    daily = run.watch("daily", t.daily(), input=n)
    daily = clean.normalize_daily(daily, "date", ["event_flag"], [("event_flag", "event_name")]).drop("problems")
    if "context loses a day" in broken:
        daily = daily.filter(F.dayofmonth("date") != 9)
    daily = run.run("daily", daily, output=n)
    if "hours come twice" in broken:
        hourly = hourly.unionByName(hourly.filter(F.hour("hour") == 3))
    merged = enrich.join_daily(enrich.join_hourly(grid, hourly, group="grp", ts="ts"), daily, ts="ts")
    merged = run.run(
        "merge", merged, output=n, hourly_missing=F.count_if(F.col("temperature").isNull()), daily_missing=F.count_if(F.col("event_flag").isNull())
    )
    made = features.add_history(run.watch("feature", merged.dropDuplicates(["entity", "ts"]), input=n), SPEC, features.FeaturePlan(measures=("volume",)))
    if "features lose an hour" in broken:
        made = made.filter(F.hour("ts") != 5)
    made = run.run("feature", made, output=n)
    done = features.add_targets(run.watch("processed", made, input=n), SPEC, (("volume", "volume", "regression", None),), (1,))
    run.run("processed", done, output=n)
    return run.table(spark)


def _reconciled(t: Tables, broken: frozenset[str] = frozenset()) -> DataFrame:
    seen = durable(_stage_run(t, broken))
    # The checks know the stages under their own names.
    renamed = {("validation", "keyed"): ("facts", "raw"), ("validation", "duplicates"): ("facts", "duplicates"), ("grid", "inserted"): ("facts", "inserted"), ("grid", "output"): ("facts", "output")}
    stage, counter = F.col("stage"), F.col("counter")
    for (s, k), (s2, k2) in renamed.items():
        here = (F.col("stage") == s) & (F.col("counter") == k)
        stage, counter = F.when(here, s2).otherwise(stage), F.when(here, k2).otherwise(counter)
    named = seen.select(stage.alias("stage"), counter.alias("counter"), "value")
    value = lambda s, k: F.max(F.when((F.col("stage") == s) & (F.col("counter") == k), F.col("value")))
    twice = seen.agg((value("merge", "output") - value("feature", "input")).alias("value")).select(
        F.lit("merge").alias("stage"), F.lit("duplicates").alias("counter"), "value"
    )
    return c.reconcile(named.unionByName(twice))


def _checks_sql(red: dict[str, str]) -> str:
    """Every check with whether the data holds no row that a seeded defect takes or adds."""
    rows = " UNION ALL ".join(f"SELECT '{name}' AS \"check\", {red.get(name, 'TRUE')} AS passed" for name in _STAGE_CHECKS)
    return rows


@query("VA20_stage_reconciliation", _checks_sql({}))
def _(t: Tables) -> DataFrame:
    return _reconciled(t)


@query(
    "VA20b_broken_validation",
    _checks_sql({"raw_validation_input_rows": "(SELECT count(*) = 0 FROM events WHERE event_id % 7 = 0)"}),
)
def _(t: Tables) -> DataFrame:
    """A validation that loses rows turns its own check red and no other."""
    return _reconciled(t, frozenset({"validation loses rows"}))


_LOST_DAY = "(SELECT count(*) = 0 FROM events WHERE day(ts) = 9)"


@query(
    "VA20c_broken_context_and_features",
    _checks_sql({
        "context_rows_preserved": _LOST_DAY, "join_coverage": _LOST_DAY, "merge_cardinality": "(SELECT count(*) = 0 FROM events WHERE hour(ts) = 3)",
        "feature_cardinality": "(SELECT count(*) = 0 FROM events)",
    }),
)
def _(t: Tables) -> DataFrame:
    """A lost day of context, hours that come twice and features that lose an hour: four checks red."""
    return _reconciled(t, frozenset({"context loses a day", "hours come twice", "features lose an hour"}))


@query(
    "VA21_clean_invariants",
    with_ctes(
        "clean",
        "SELECT 'load_missing' AS rule, count(*) FILTER (load IS NULL) AS violations FROM clean UNION ALL "
        "SELECT 'volume_negative', count(*) FILTER (volume < 0) FROM clean UNION ALL "
        "SELECT 'speed_above_200', count(*) FILTER (speed > 200) FROM clean UNION ALL "
        "SELECT 'capacity_not_positive', count(*) FILTER (capacity <= 0) FROM clean",
    ),
)
def _(t: Tables) -> DataFrame:
    return clean.invariant_violations(
        t.clean(),
        {
            "load_missing": F.col("load").isNull(),
            "volume_negative": F.col("volume") < 0,
            "speed_above_200": F.col("speed") > 200,
            "capacity_not_positive": F.col("capacity") <= 0,
        },
    )


@query(
    "VA22_duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def _(t: Tables) -> DataFrame:
    return c.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "VA23_cadence_breaks",
    with_ctes(
        "observed",
        "SELECT entity, ts FROM (SELECT entity, ts, lag(ts) OVER (PARTITION BY entity ORDER BY ts) AS p FROM observed) "
        "WHERE p IS NOT NULL AND ts - p <> INTERVAL '30 minutes'",
    ),
)
def _(t: Tables) -> DataFrame:
    return c.cadence_breaks(t.observed(), SPEC)


@query(
    "VA24_incomplete_timestamps",
    with_ctes(
        "observed",
        "SELECT ts, count(DISTINCT entity) AS entities FROM observed GROUP BY 1 "
        "HAVING count(DISTINCT entity) <> (SELECT count(DISTINCT entity) FROM observed)",
    ),
)
def _(t: Tables) -> DataFrame:
    return c.incomplete_timestamps(t.observed(), SPEC)


@query(
    "VA24b_calendar_differences",
    with_ctes(
        "observed steps",
        "SELECT e.entity, s.ts, 'missing' AS problem FROM steps s CROSS JOIN (SELECT DISTINCT entity FROM observed) e "
        "WHERE NOT EXISTS (SELECT 1 FROM observed o WHERE o.entity = e.entity AND o.ts = s.ts) UNION ALL "
        "SELECT entity, ts, 'unexpected' FROM observed WHERE ts NOT IN (SELECT ts FROM steps)",
    ),
)
def _(t: Tables) -> DataFrame:
    seen = t.observed()
    bounds = clean.day_bounds(seen, SPEC)
    return c.calendar_differences(seen, SPEC, **bounds)


@query(
    "VA25_upload_report",
    with_ctes(
        "va_issues",
        "SELECT * FROM va_issues ORDER BY source_row, coalesce(field, ''), reason_code, disposition LIMIT 500",
    ),
)
def _(t: Tables) -> DataFrame:
    return c.upload_report(t.raw(), [RAW])["issues"]


@query(
    "VA25b_upload_accounting",
    with_ctes(
        "va_issues raw",
        f"SELECT 'events' AS dataset, count(*) AS input_rows, count(*) - {_REJ} AS valid_rows, {_REJ} AS rejected_rows, TRUE AS accounted FROM raw",
    ),
)
def _(t: Tables) -> DataFrame:
    return c.upload_report(t.raw(), [RAW])["accounting"]


@query(
    "VA25c_valid_preview",
    with_ctes(
        "va_issues va_parsed",
        """SELECT p.source_row, entity, ts, CASE WHEN EXISTS (SELECT 1 FROM va_cells i WHERE i.source_row = p.source_row AND i.disposition = 'cell_invalidated')
        THEN 'valid_with_issues' ELSE 'valid' END AS validation_status FROM va_parsed p
        WHERE source_row NOT IN (SELECT source_row FROM va_issues WHERE disposition = 'row_rejected') ORDER BY source_row LIMIT 100""",
    ),
)
def _(t: Tables) -> DataFrame:
    return c.upload_report(t.raw(), [RAW])["valid_preview"].select("source_row", "entity", "ts", "validation_status")


@query(
    "VA25d_rejected_preview",
    with_ctes(
        "va_issues raw",
        """SELECT p.source_row, entity, date, time, r.reasons AS rejection_reason FROM raw p JOIN
        (SELECT source_row, array_to_string(list_sort(list_distinct(list(reason_code))), '|') AS reasons FROM va_issues
         WHERE disposition = 'row_rejected' GROUP BY 1) r USING (source_row) ORDER BY source_row LIMIT 100""",
    ),
)
def _(t: Tables) -> DataFrame:
    return c.upload_report(t.raw(), [RAW])["rejected_preview"].select("source_row", "entity", "date", "time", "rejection_reason")


@query("VA26_inputs_untouched", "SELECT v.side AS side, n - n AS rows FROM (SELECT count(*) AS n FROM events), (VALUES ('lost'),('added')) v(side)")
def _(t: Tables) -> DataFrame:
    before = t.clean()
    return c.table_differences(before, t.targets(), before.columns)


@query(
    "VA26b_changed_inputs",
    with_ctes(
        "clean",
        "SELECT 'lost' AS side, count(*) FILTER (entity = 'click' AND hour(ts) = 0 AND load IS NOT NULL) + count(*) FILTER (hour(ts) = 5) AS rows FROM clean "
        "UNION ALL SELECT 'added', count(*) FILTER (entity = 'click' AND hour(ts) = 0 AND load IS NOT NULL) FROM clean",
    ),
)
def _(t: Tables) -> DataFrame:
    """A stage that alters some rows and loses others."""
    before = t.clean()
    altered = F.when((F.col("entity") == "click") & (F.hour("ts") == 0), F.col("load") + 1).otherwise(F.col("load"))
    return c.table_differences(before, before.withColumn("load", altered).filter(F.hour("ts") != 5), before.columns)


@query(
    "VA26c_checksum_tells_tables_apart",
    "SELECT v.name AS change, n = 0 AS equal FROM (SELECT 0 AS n, 'order and partitions' AS name UNION ALL SELECT count(*) FILTER (event_id % 11 = 0), 'a repeated row' FROM events "
    "UNION ALL SELECT count(*) FILTER (event_id % 11 = 0), 'swapped values' FROM events UNION ALL SELECT count(*) FILTER (event_id = 1), 'one null' FROM events) v",
)
def _(t: Tables) -> DataFrame:
    """The same rows in another order are equal; small changes are not."""
    rows = t.events.select("event_id", "event_type", "value")
    some, one = F.col("event_id") % 11 == 0, F.col("event_id") == 1
    versions = {
        "order and partitions": rows.repartition(13).orderBy("value"),
        "a repeated row": rows.unionByName(rows.filter(some).limit(1)),
        "swapped values": rows.withColumn("value", F.when(some, F.col("value") + 0.01).otherwise(F.col("value"))),
        "one null": rows.withColumn("event_type", F.when(~one, F.col("event_type"))),
    }
    base = c.multiset_checksum(rows, rows.columns).first()
    found = [(name, c.multiset_checksum(df, rows.columns).first() == base) for name, df in versions.items()]
    return t.spark.createDataFrame(found, "change string, equal boolean")


