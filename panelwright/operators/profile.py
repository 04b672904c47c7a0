"""Profiling and audit: one scan per report wherever a single aggregate can say it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.order_stats import quantiles
from ..functions.scalars import ratio, rounded, to_number


def _long(row: DataFrame, records: Sequence[Column]) -> DataFrame:
    """One aggregated row to one row per record."""
    return row.select(F.explode(F.array(*records)).alias("r")).select("r.*")


def shape(df: DataFrame) -> DataFrame:
    """Row count, column position and type per column."""
    row = df.agg(F.count(F.lit(1)).alias("rows"))
    return _long(
        row,
        [
            F.struct(
                F.lit(i).alias("position"), F.lit(name).alias("column"), F.lit(kind).alias("dtype"), F.col("rows")
            )
            for i, (name, kind) in enumerate(df.dtypes)
        ],
    )


def null_counts(df: DataFrame) -> DataFrame:
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return _long(row, [F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns])


def numeric_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minimum, maximum and null count after numeric coercion."""
    coerced = df.select(*[to_number(F.col(c)).alias(c) for c in columns])
    row = coerced.agg(
        *[F.min(c).alias(f"lo_{c}") for c in columns],
        *[F.max(c).alias(f"hi_{c}") for c in columns],
        *[F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in columns],
    )
    return _long(
        row,
        [
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"lo_{c}").alias("minimum"),
                F.col(f"hi_{c}").alias("maximum"),
                F.col(f"nulls_{c}").alias("nulls"),
            )
            for c in columns
        ],
    )


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """Counts per value; nulls and empty text share the label ``<BLANK>``."""
    label = F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit("<BLANK>"))
    return df.groupBy(label.alias("value")).agg(F.count(F.lit(1)).alias("rows"))


def duplicate_rows(df: DataFrame, key: Sequence[str] | None = None) -> DataFrame:
    """Rows, distinct keys and rows beyond the first per key (all columns when no key is given)."""
    groups = df.groupBy(*(key or df.columns)).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("unique_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
    )


def grid_coverage(df: DataFrame, entity: str, ts: str, per_day: int) -> DataFrame:
    """Expected entity x day x window cells against the distinct keys present."""
    keys = df.select(entity, ts).distinct()
    return keys.agg(
        F.count_distinct(entity).alias("entities"),
        (F.datediff(F.max(ts), F.min(ts)) + 1).cast("long").alias("days"),
        F.count(F.lit(1)).alias("unique_keys"),
    ).select(
        "*",
        (F.col("entities") * F.col("days") * per_day).alias("expected_cells"),
        (F.col("entities") * F.col("days") * per_day - F.col("unique_keys")).alias("missing_cells"),
    )


def timestamp_coverage(df: DataFrame, text: Column, fmt: str) -> DataFrame:
    """First and last parsed timestamp and the number of unparsable texts."""
    parsed = F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")
    return df.select(parsed.alias("t")).agg(
        F.min("t").alias("first_ts"), F.max("t").alias("last_ts"), F.count_if(F.col("t").isNull()).alias("invalid")
    )


def unique_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    fn = F.approx_count_distinct if approximate else F.count_distinct
    row = df.agg(*[fn(F.col(c)).alias(c) for c in columns])
    return _long(row, [F.struct(F.lit(c).alias("column"), F.col(c).alias("distinct_values")) for c in columns])


def count_where(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows meeting each named predicate (null counts as not met)."""
    row = df.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
    return _long(row, [F.struct(F.lit(n).alias("rule"), F.col(n).alias("rows")) for n in rules])


def positive_rate(df: DataFrame, column: str) -> DataFrame:
    positive = to_number(F.col(column)) > 0
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(positive).alias("positive_rows")
    ).withColumn("positive_rate", rounded(ratio(F.col("positive_rows"), F.col("rows")), 8))


def flag_counts(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    return count_where(df, {f: to_number(F.col(f)) == 1 for f in flags})


def unpivoted(df: DataFrame, columns: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """Long form ``ids, column, value`` of numeric columns."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), to_number(F.col(c)).alias("value")) for c in columns]
    )
    return df.select(*ids, F.explode(pairs).alias("r")).select(*ids, "r.*")


def descriptive_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, nulls, mean, spread, quartiles, range and adjusted skew, rounded to 6 places."""
    long = unpivoted(df, columns)
    n = F.count("value")
    moments = long.groupBy("column").agg(
        n.alias("count"),
        F.count_if(F.col("value").isNull()).alias("null_count"),
        rounded(F.avg("value")).alias("mean"),
        rounded(F.stddev_samp("value")).alias("standard_deviation"),
        rounded(F.var_samp("value")).alias("variance"),
        rounded(F.min("value")).alias("minimum"),
        rounded(F.max("value")).alias("maximum"),
        rounded(
            F.when(
                (n > 2) & (F.stddev_pop("value") > 0),
                F.skewness("value") * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2),
            )
        ).alias("skewness"),
    )
    cuts = quantiles(long, ["column"], "value", {"q25": 0.25, "median": 0.5, "q75": 0.75}, bounded_groups=True)
    cuts = cuts.select("column", *[rounded(F.col(c)).alias(c) for c in ("q25", "median", "q75")])
    return moments.join(cuts, "column", "left")


def feature_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column by type: true/false counts, range, or counts per text value.

    Long form ``column, dtype, statistic, value``; numbers are shown as doubles.
    """
    chosen = [f for f in df.schema.fields if columns is None or f.name in columns]
    aggs: dict[tuple[str, str], Column] = {}
    texts = []
    for field in chosen:
        col = F.col(field.name)
        aggs[field.name, "null_count"] = F.count_if(col.isNull())
        if isinstance(field.dataType, T.BooleanType):
            aggs[field.name, "true_count"] = F.count_if(col)
            aggs[field.name, "false_count"] = F.count_if(~col)
        elif isinstance(field.dataType, T.NumericType):
            aggs[field.name, "minimum"] = F.min(col)
            aggs[field.name, "maximum"] = F.max(col)
        else:
            texts.append(field.name)
    kinds = dict(df.dtypes)
    row = df.agg(*[a.cast("double").alias(f"{c}|{s}") for (c, s), a in aggs.items()])
    out = _long(
        row,
        [
            F.struct(
                F.lit(c).alias("column"), F.lit(kinds[c]).alias("dtype"), F.lit(s).alias("statistic"),
                F.col(f"`{c}|{s}`").alias("value"),
            )
            for c, s in aggs
        ],
    )
    if texts:
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("label")) for c in texts])
        counts = (
            df.select(F.explode(pairs).alias("r")).select("r.*").filter(F.col("label").isNotNull())
            .groupBy("column", "label").agg(F.count(F.lit(1)).cast("double").alias("value"))
        )
        kind = F.create_map(*[x for c in texts for x in (F.lit(c), F.lit(kinds[c]))])
        out = out.unionByName(
            counts.select(
                "column", F.element_at(kind, F.col("column")).alias("dtype"),
                F.concat(F.lit("value_count:"), "label").alias("statistic"), "value",
            )
        )
    return out


def histogram(df: DataFrame, column: str, bins: int = 36) -> DataFrame:
    """Equal-width bins over the observed range, with the exact median beside each bin."""
    values = df.select(F.col(column).cast("double").alias("value")).filter(F.col("value").isNotNull())
    edges = values.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    lo, hi = edges.select("lo").scalar(), edges.select("hi").scalar()
    median = quantiles(values, [], "value", {"median": 0.5})
    step = (hi - lo) / bins
    index = F.when(hi > lo, F.least(F.floor((F.col("value") - lo) / F.nullif(step, F.lit(0.0))), F.lit(bins - 1))).otherwise(0)
    return (
        values.select(index.cast("int").alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(
            "bin", "rows", rounded(lo + F.col("bin") * step).alias("bin_lower"),
            rounded(median.select("median").scalar()).alias("median"),
        )
    )


def class_balance(df: DataFrame, label: str, order: Sequence[str]) -> DataFrame:
    """Rows and rate per class in the given order, absent classes included."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(label) == x).alias(f"c{i}") for i, x in enumerate(order)]
    )
    return _long(
        row,
        [
            F.struct(
                F.lit(i).alias("position"), F.lit(x).alias("class"), F.col(f"c{i}").alias("rows"),
                rounded(ratio(F.col(f"c{i}"), F.col("n")), 8).alias("rate"),
            )
            for i, x in enumerate(order)
        ],
    )


def event_balance(df: DataFrame, events: str, observed: str) -> DataFrame:
    """Observed, unobserved, positive and negative rows of a count column and their balance."""
    seen = F.coalesce(F.col(observed), F.lit(False))
    hit = seen & F.coalesce(F.col(events) > 0, F.lit(False))
    row = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(seen).alias("observed_rows"),
        F.count_if(~seen).alias("unobserved_rows"),
        F.count_if(hit).alias("positive_rows"),
    ).withColumn("negative_rows", F.col("observed_rows") - F.col("positive_rows"))
    return row.select(
        "*",
        rounded(ratio(F.col("positive_rows"), F.col("observed_rows")), 8).alias("positive_rate_observed"),
        rounded(ratio(F.col("negative_rows"), F.col("positive_rows")), 4).alias("negative_to_positive_ratio"),
    )
