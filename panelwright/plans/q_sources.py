"""Queries over sources, sinks and profiles (IO, PR)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import shared_dir
from ..operators import clean, profile
from ..sources import tables as io
from .frames import LEVELS, Tables
from .registry import query
from .sql import LEVEL, r, with_ctes


def _out(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "IO1_csv_with_row_lineage",
    "SELECT count(*) AS row_count, count(*) AS distinct_places, TRUE AS numbering_contiguous, "
    "CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM orders",
)
def _(t: Tables) -> DataFrame:
    path = _out(t, "orders_csv")
    t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice").write.option("header", True).csv(path)
    rows = io.read_csv(t.spark, path)
    files = rows.groupBy("_source_file").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("_source_row").alias("d"), F.min("_source_row").alias("lo"),
        F.max("_source_row").alias("hi"), F.sum(F.col("o_orderkey").cast("long")).alias("keys"),
    )
    return files.agg(
        F.sum("n").alias("row_count"), F.sum("d").alias("distinct_places"),
        F.every((F.col("lo") == 2) & (F.col("hi") == F.col("n") + 1)).alias("numbering_contiguous"),
        F.sum("keys").alias("key_sum"),
    )


@query(
    "IO1b_quoted_csv",
    "SELECT event_id, concat('<p>', chr(10), 'it said \"', event_type, '\", ', chr(10), chr(10), repeat('z', CAST(event_id % 5 AS INTEGER))) AS note, CAST(value AS VARCHAR) AS value FROM events",
)
def _(t: Tables) -> DataFrame:
    """A table whose text holds quotes, commas and line breaks, written and read back in small splits."""
    path = _out(t, "quoted_csv")
    note = F.concat(F.lit('<p>\nit said "'), "event_type", F.lit('", \n\n'), F.expr("repeat('z', CAST(event_id % 5 AS INT))"))
    out = t.events.select("event_id", note.alias("note"), F.col("value").cast("string").alias("value"))
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    out.write.options(header=True, escape='"', quoteAll=True, **keep).csv(path)
    return io.read_quoted_csv(t.spark, path).select(F.col("event_id").cast("long").alias("event_id"), "note", "value")


@query(
    "IO2_parquet_pruned_columns",
    f"SELECT l_returnflag, count(*) AS n, {r('sum(l_quantity)')} AS quantity FROM lineitem GROUP BY 1",
)
def _(t: Tables) -> DataFrame:
    frame = io.read_parquet(t.spark, f"{t.path}/lineitem.parquet", ["l_returnflag", "l_quantity"])
    return frame.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 6).alias("quantity")
    )


@query("IO3_versioned_parquet", with_ctes("observed", "SELECT * FROM observed"))
def _(t: Tables) -> DataFrame:
    path = io.write_parquet(t.observed(), _out(t, "store"), "panel_v1", "observed", ["grp"])
    return t.spark.read.parquet(path).select(*t.observed().columns)


@query(
    "IO4_stable_csv",
    "SELECT p_partkey, p_brand, p_retailprice, round(p_retailprice / 7, 6) AS unit FROM part",
)
def _(t: Tables) -> DataFrame:
    out = t.part.select("p_partkey", "p_brand", "p_retailprice", (F.col("p_retailprice") / 7).alias("unit"))
    path = io.write_csv(out, _out(t, "parts_csv"))
    back = t.spark.read.option("header", True).csv(path)
    return back.select(
        F.col("p_partkey").cast("long").alias("p_partkey"), "p_brand",
        F.col("p_retailprice").cast("double").alias("p_retailprice"),
        F.round(F.col("unit").cast("double"), 6).alias("unit"),
    )


@query(
    "IO4b_significant_text",
    "SELECT p_partkey, format('{:.12g}', x) AS plain, format('{:.12g}', -x / 7) AS divided FROM (SELECT p_partkey, p_retailprice * CAST('1e' || CAST(p_partkey % 31 - 15 AS VARCHAR) AS DOUBLE) AS x FROM part)",
)
def _(t: Tables) -> DataFrame:
    """The text of a float itself, from 1e-13 to 1e18."""
    scale = F.concat(F.lit("1e"), (F.col("p_partkey") % 31 - 15).cast("string")).cast("double")
    x = F.col("p_retailprice") * scale
    out = t.part.select("p_partkey", x.alias("plain"), (-x / 7).alias("divided"))
    path = io.write_csv(out, _out(t, "digits_csv"))
    return t.spark.read.option("header", True).csv(path).select(F.col("p_partkey").cast("long").alias("p_partkey"), "plain", "divided")


@query(
    "IO5_sorted_json_records",
    "SELECT '{\"entity\":\"' || event_type || '\",\"first_id\":' || min(event_id) || ',\"rows\":' || count(*) || '}' AS value "
    "FROM events GROUP BY event_type",
)
def _(t: Tables) -> DataFrame:
    out = t.events.groupBy(F.col("event_type").alias("entity")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("event_id").alias("first_id")
    )
    return t.spark.read.text(io.write_json(out, _out(t, "summary_json")))


@query(
    "IO6_export_check",
    "SELECT 'source_rows' AS \"check\", count(*) AS value FROM customer UNION ALL SELECT 'exported_rows', count(*) FROM customer "
    "UNION ALL SELECT 'columns_match', 1 UNION ALL SELECT 'missing_rows', 0 UNION ALL SELECT 'extra_rows', 0",
)
def _(t: Tables) -> DataFrame:
    path = io.write_parquet(t.customer, _out(t, "export"), "v1", "customer")
    return io.export_check(t.customer, t.spark.read.parquet(path))


@query(
    "IO6b_bad_export",
    "SELECT v.name AS \"check\", CAST(n AS BIGINT) AS value FROM (SELECT 'source_rows' AS name, count(*) AS n FROM customer UNION ALL SELECT 'exported_rows', count(*) FILTER (c_custkey % 10 <> 0) FROM customer "
    "UNION ALL SELECT 'columns_match', 1 UNION ALL SELECT 'missing_rows', count(*) FILTER (c_custkey % 10 IN (0, 1)) FROM customer UNION ALL SELECT 'extra_rows', count(*) FILTER (c_custkey % 10 = 1) FROM customer) v",
)
def _(t: Tables) -> DataFrame:
    """An export that lost some rows and changed others."""
    last = F.col("c_custkey") % 10
    bad = t.customer.filter(last != 0).withColumn("c_name", F.when(last == 1, F.lit("changed")).otherwise(F.col("c_name"))).select(*t.customer.columns)
    path = io.write_parquet(bad, _out(t, "export"), "v1", "customer")
    return io.export_check(t.customer, t.spark.read.parquet(path))


@query(
    "PR1_shape",
    "SELECT CAST(i AS INTEGER) AS position, c AS \"column\", d AS dtype, n AS rows FROM (SELECT count(*) AS n FROM events), "
    "(VALUES (0,'event_id','bigint'),(1,'ts','timestamp_ntz'),(2,'user_id','bigint'),(3,'event_type','string'),"
    "(4,'value','double'),(5,'props','string')) v(i, c, d)",
)
def _(t: Tables) -> DataFrame:
    return profile.shape(t.events)


_GRID_COLS = ("entity", "grp", "row_id", "volume", "speed", "load", "incidents", "inserted")


@query(
    "PR2_null_counts",
    with_ctes("grid", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM grid" for c in _GRID_COLS)),
)
def _(t: Tables) -> DataFrame:
    return profile.null_counts(t.grid().select(*_GRID_COLS))


@query(
    "PR3_numeric_ranges",
    with_ctes(
        "raw",
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", min(x) AS minimum, max(x) AS maximum, count(*) - count(x) AS nulls FROM "
            f"(SELECT CASE WHEN isfinite(try_cast(nullif({c}, '') AS DOUBLE)) THEN try_cast(nullif({c}, '') AS DOUBLE) END AS x FROM raw)"
            for c in ("volume", "speed")
        ),
    ),
)
def _(t: Tables) -> DataFrame:
    return profile.numeric_ranges(t.raw(), ["volume", "speed"])


@query("PR4_frequencies", with_ctes("raw", "SELECT coalesce(nullif(level, ''), '<BLANK>') AS value, count(*) AS rows FROM raw GROUP BY 1"))
def _(t: Tables) -> DataFrame:
    return profile.frequencies(t.raw(), "level")


@query(
    "PR5_exact_duplicates",
    "SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS unique_rows, CAST(sum(n - 1) AS BIGINT) AS duplicates "
    "FROM (SELECT count(*) AS n FROM lineitem GROUP BY ALL HAVING TRUE)".replace(
        "GROUP BY ALL HAVING TRUE",
        "GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
        "l_returnflag, l_linestatus, l_shipdate",
    ),
)
def _(t: Tables) -> DataFrame:
    return profile.duplicate_rows(t.lineitem)


@query(
    "PR6_key_duplicates",
    "SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS unique_rows, CAST(sum(n - 1) AS BIGINT) AS duplicates "
    "FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)",
)
def _(t: Tables) -> DataFrame:
    return profile.duplicate_rows(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "PR7_grid_coverage",
    with_ctes(
        "observed",
        "SELECT count(DISTINCT entity) AS entities, date_diff('day', min(ts), max(ts)) + 1 AS days, count(*) AS unique_keys, "
        "count(DISTINCT entity) * (date_diff('day', min(ts), max(ts)) + 1) * 48 AS expected_cells, "
        "count(DISTINCT entity) * (date_diff('day', min(ts), max(ts)) + 1) * 48 - count(*) AS missing_cells FROM observed",
    ),
)
def _(t: Tables) -> DataFrame:
    return profile.grid_coverage(t.observed(), "entity", "ts", 48)


@query(
    "PR8_timestamp_coverage",
    with_ctes(
        "raw",
        "SELECT min(x) AS first_ts, max(x) AS last_ts, count(*) - count(x) AS invalid FROM "
        "(SELECT CASE WHEN regexp_full_match(date, '\\d{4}-\\d{2}-\\d{2}') THEN try_strptime(date || ' ' || time, '%Y-%m-%d %H:%M') END AS x FROM raw)",
    ),
)
def _(t: Tables) -> DataFrame:
    return profile.timestamp_coverage(t.raw(), F.concat_ws(" ", "date", "time"), "yyyy-MM-dd HH:mm")


@query(
    "PR9_unique_counts",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_values FROM lineitem"
        for c in ("l_orderkey", "l_suppkey", "l_returnflag", "l_shipdate")
    ),
)
def _(t: Tables) -> DataFrame:
    return profile.unique_counts(t.lineitem, ["l_orderkey", "l_suppkey", "l_returnflag", "l_shipdate"])


@query(
    "PR10_impossible_values",
    "SELECT 'value_above_200' AS rule, count(*) FILTER (value > 200) AS rows FROM events UNION ALL "
    "SELECT 'value_below_1', count(*) FILTER (value < 1) FROM events UNION ALL "
    "SELECT 'share_above_95', count(*) FILTER (CAST(json_extract_string(props, '$.k') AS DOUBLE) > 95) FROM events",
)
def _(t: Tables) -> DataFrame:
    return profile.count_where(
        t.events,
        {
            "value_above_200": F.col("value") > 200,
            "value_below_1": F.col("value") < 1,
            "share_above_95": F.get_json_object("props", "$.k").cast("double") > 95,
        },
    )


@query(
    "PR11_positive_rate",
    with_ctes("observed", f"SELECT count(*) AS rows, count(*) FILTER (incidents > 0) AS positive_rows, {r('avg(CAST(incidents > 0 AS INTEGER))', 8)} AS positive_rate FROM observed"),
)
def _(t: Tables) -> DataFrame:
    return profile.positive_rate(t.observed(), "incidents")


@query(
    "PR11b_flag_counts",
    with_ctes("daily", " UNION ALL ".join(f"SELECT '{c}' AS rule, count(*) FILTER ({c} = 1) AS rows FROM daily" for c in ("public_holiday", "event_flag", "roadwork_flag"))),
)
def _(t: Tables) -> DataFrame:
    return profile.flag_counts(t.daily(), ["public_holiday", "event_flag", "roadwork_flag"])


_STATS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "PR12_descriptive_statistics",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, count(*) - count({c}) AS null_count, {r(f'avg({c})')} AS mean, "
        f"{r(f'stddev_samp({c})')} AS standard_deviation, {r(f'var_samp({c})')} AS variance, {r(f'min({c})')} AS minimum, "
        f"{r(f'max({c})')} AS maximum, {r(f'skewness({c})')} AS skewness, {r(f'quantile_cont({c}, 0.25)')} AS q25, "
        f"{r(f'quantile_cont({c}, 0.5)')} AS median, {r(f'quantile_cont({c}, 0.75)')} AS q75 FROM lineitem"
        for c in _STATS
    ),
)
def _(t: Tables) -> DataFrame:
    return profile.descriptive_statistics(t.lineitem, _STATS)


@query(
    "PR13_feature_stats",
    with_ctes(
        "grid",
        "SELECT 'inserted' AS \"column\", 'boolean' AS dtype, 'null_count' AS statistic, CAST(count(*) - count(inserted) AS DOUBLE) AS value FROM grid "
        "UNION ALL SELECT 'inserted', 'boolean', 'true_count', CAST(count(*) FILTER (inserted) AS DOUBLE) FROM grid "
        "UNION ALL SELECT 'inserted', 'boolean', 'false_count', CAST(count(*) FILTER (NOT inserted) AS DOUBLE) FROM grid "
        "UNION ALL SELECT 'load', 'double', 'null_count', CAST(count(*) - count(load) AS DOUBLE) FROM grid "
        "UNION ALL SELECT 'load', 'double', 'minimum', min(load) FROM grid UNION ALL SELECT 'load', 'double', 'maximum', max(load) FROM grid "
        "UNION ALL SELECT 'grp', 'string', 'null_count', CAST(count(*) - count(grp) AS DOUBLE) FROM grid "
        "UNION ALL SELECT 'grp', 'string', 'value_count:' || grp, CAST(count(*) AS DOUBLE) FROM grid GROUP BY grp",
    ),
)
def _(t: Tables) -> DataFrame:
    return profile.feature_stats(t.grid(), ["inserted", "load", "grp"])


@query(
    "PR14_histogram",
    f"""WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, quantile_cont(l_extendedprice, 0.5) AS med FROM lineitem)
    SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 36)), 35) AS INTEGER) AS bin, count(*) AS rows,
    {r('any_value(lo) + least(floor((l_extendedprice - lo) / ((hi - lo) / 36)), 35) * any_value((hi - lo) / 36)')} AS bin_lower,
    {r('any_value(med)')} AS median FROM lineitem, e GROUP BY 1, least(floor((l_extendedprice - lo) / ((hi - lo) / 36)), 35)""",
)
def _(t: Tables) -> DataFrame:
    return profile.histogram(t.lineitem, "l_extendedprice")


@query(
    "PR15_class_balance",
    with_ctes(
        "panel",
        f"SELECT CAST(v.i AS INTEGER) AS position, v.x AS class, count(p.level) AS rows, {r('count(p.level) / (SELECT count(*) FROM panel)', 8)} AS rate "
        f"FROM (VALUES (0,'Free-flow'),(1,'Moderate'),(2,'Heavy'),(3,'Severe'),(4,'Closed')) v(i, x) "
        f"LEFT JOIN (SELECT {LEVEL.format('load', 'capacity')} AS level FROM panel) p ON p.level = v.x GROUP BY 1, 2",
    ),
)
def _(t: Tables) -> DataFrame:
    labelled = t.panel().withColumn("level", clean.capacity_band(F.col("load"), F.col("capacity")))
    return profile.class_balance(labelled, "level", (*LEVELS, "Closed"))


@query(
    "PR15b_event_balance",
    with_ctes(
        "grid",
        f"""SELECT count(*) AS total_rows, count(*) FILTER (NOT inserted) AS observed_rows, count(*) FILTER (inserted) AS unobserved_rows,
        count(*) FILTER (incidents > 0) AS positive_rows, count(*) FILTER (NOT inserted AND NOT coalesce(incidents > 0, FALSE)) AS negative_rows,
        {r('count(*) FILTER (incidents > 0) / count(*) FILTER (NOT inserted)', 8)} AS positive_rate_observed,
        {r('count(*) FILTER (NOT inserted AND NOT coalesce(incidents > 0, FALSE)) / count(*) FILTER (incidents > 0)', 4)} AS negative_to_positive_ratio
        FROM grid""",
    ),
)
def _(t: Tables) -> DataFrame:
    return profile.event_balance(t.grid().withColumn("observed", ~F.col("inserted")), "incidents", "observed")


