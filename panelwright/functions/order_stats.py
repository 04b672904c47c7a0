"""Exact ranks, prefix sums and quantiles without sorting a group in one task.

Values are first reduced to distinct values with counts (map-side combined), then placed in bins
by a monotone function of the value alone.  A bin that holds more than ``BIN_VALUES`` values is split
by its own range, again and again, until none does; so no task orders more than that many.  Only the
bin totals of a group are scanned in order; rows are ordered inside their own bin.  ``percentile`` and a ``row_number`` over the group would
both hold the whole group in one task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keyed import stored
from .ranges import range_ranked

# Bins per doubling of the value (0.07 % wide) and an offset above every double's exponent.
_PER_OCTAVE = 1024
_OFFSET = 2_000_000
#: Values that one bin may hold, and parts that a fuller one is split into.
BIN_VALUES, SPLIT = 200_000, 1024


def value_bin(value: Column) -> Column:
    """Monotone integer bin of a number; the infinities have the first and the last bin."""
    magnitude = F.floor(F.log2(F.abs(value)) * _PER_OCTAVE) + _OFFSET
    return (
        F.when(value == F.lit(float("inf")), F.lit(1 << 62))
        .when(value == F.lit(float("-inf")), F.lit(-(1 << 62)))
        .when(value > 0, magnitude).when(value < 0, -magnitude).otherwise(F.lit(0)).cast("long")
    )


def _counted(value: str) -> Column:
    """Nulls and NaN have no place in an order and take no part."""
    return F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))


def _part(value: Column, lo: Column, hi: Column) -> Column:
    """Monotone part of ``SPLIT`` equal parts of a range."""
    return F.least(F.floor((value - lo) / (hi - lo) * SPLIT), F.lit(SPLIT - 1)).cast("long")


def _split_full_bins(distinct: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """``_bin`` lengthened by one part wherever a bin is too full, until no bin is.

    Bins are arrays, ordered entry by entry.  A first bin is narrow and a double has few bits left
    inside it, so five rounds are the most.
    """
    v = F.col(value).cast("double")
    while True:
        full = distinct.groupBy(*groups, "_bin").agg(F.count(F.lit(1)).alias("_n"), F.min(v).alias("_lo"), F.max(v).alias("_hi"))
        full = full.filter((F.col("_n") > BIN_VALUES) & (F.col("_lo") < F.col("_hi"))).drop("_n")
        if full.isEmpty():
            return distinct
        joined = distinct.join(full, [*groups, "_bin"], "left")
        longer = F.concat("_bin", F.array(_part(v, F.col("_lo"), F.col("_hi"))))
        distinct = stored(joined.withColumn("_bin", F.when(F.col("_lo").isNull(), F.col("_bin")).otherwise(longer)).drop("_lo", "_hi"))


def _binned(df: DataFrame, groups: Sequence[str], value: str, sums: dict[str, Column]):
    distinct = (
        df.filter(_counted(value))
        .groupBy(*groups, value)
        .agg(*[F.sum(expr).alias(name) for name, expr in sums.items()])
        .withColumn("_bin", F.array(value_bin(F.col(value).cast("double"))))
    )
    distinct = _split_full_bins(stored(distinct), groups, value)
    bins = distinct.groupBy(*groups, "_bin").agg(*[F.sum(name).alias(name) for name in sums])
    earlier = Window.partitionBy(*groups).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    zero = F.lit(0)
    bins = bins.select(
        *groups,
        "_bin",
        *[F.col(name).alias(f"_in_{name}") for name in sums],
        *[F.coalesce(F.sum(name).over(earlier), zero).alias(f"_before_{name}") for name in sums],
        *[F.sum(name).over(whole).alias(f"total_{name}") for name in sums],
    )
    return distinct, bins


def prefix_sums(
    df: DataFrame, groups: Sequence[str], value: str, sums: dict[str, Column]
) -> DataFrame:
    """Per distinct value: its sums, the sums of all smaller values, and the group totals."""
    distinct, bins = _binned(df, groups, value, sums)
    inside = (
        Window.partitionBy(*groups, "_bin")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = distinct.join(bins, [*groups, "_bin"])
    return joined.select(
        *groups,
        value,
        *sums,
        *[
            (F.col(f"_before_{n}") + F.coalesce(F.sum(n).over(inside), F.lit(0))).alias(f"before_{n}")
            for n in sums
        ],
        *[f"total_{n}" for n in sums],
    )


def _narrowed(rows: DataFrame, groups: Sequence[str], v: Column, found: list[dict]) -> list[dict]:
    """Ranges that hold wanted ranks, each cut down until it holds at most ``BIN_VALUES`` rows or one value.

    At most ranks x ``SPLIT`` counts reach the driver in a round.
    """
    done, full = [], found
    while True:
        done += [f for f in full if f["rows"] <= BIN_VALUES or f["lo"] == f["hi"]]
        full = [f for f in full if f["rows"] > BIN_VALUES and f["lo"] < f["hi"]]
        if not full:
            return done
        place = None
        for i, f in enumerate(full):
            mine = v.between(f["lo"], f["hi"])
            for g in groups:
                mine = mine & F.col(g).eqNullSafe(F.lit(f[g]))
            part = F.struct(F.lit(i).alias("i"), _part(v, F.lit(f["lo"]), F.lit(f["hi"])).alias("part"))
            place = (F if place is None else place).when(mine, part)
        counts = rows.select(place.alias("p"), v.alias("v")).filter("p IS NOT NULL").groupBy("p.i", "p.part").agg(
            F.count(F.lit(1)).alias("rows"), F.min("v").alias("lo"), F.max("v").alias("hi")
        ).collect()
        parts = defaultdict(list)
        for c in counts:
            parts[c["i"]].append(c)
        narrower = []
        for i, f in enumerate(full):
            before = f["before"]
            for c in sorted(parts[i], key=lambda c: c["part"]):
                mine = [r for r in f["ranks"] if before < r <= before + c["rows"]]
                if mine:
                    narrower.append({**f, "lo": c["lo"], "hi": c["hi"], "rows": c["rows"], "before": before, "ranks": mine})
                before += c["rows"]
        full = narrower


def _bounded_ranks(df: DataFrame, groups: Sequence[str], value: str, ranks: Callable[[Column], Column]) -> DataFrame:
    """Groups fixed by configuration: the ranges of the wanted ranks are a table of groups x ranks rows."""
    rows, v = df.filter(_counted(value)), F.col(value).cast("double")
    sums = rows.withColumn("_bin", value_bin(v)).groupBy(*groups, "_bin").agg(
        F.count(F.lit(1)).alias("rows"), F.min(v).alias("lo"), F.max(v).alias("hi")
    )
    earlier = Window.partitionBy(*groups).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = sums.withColumns(
        {"before": F.coalesce(F.sum("rows").over(earlier), F.lit(0)), "n": F.sum("rows").over(Window.partitionBy(*groups))}
    ).withColumn("ranks", F.array_distinct(ranks(F.col("n"))))
    inside = F.filter("ranks", lambda r: (r > F.col("before")) & (r <= F.col("before") + F.col("rows")))
    wanted = bins.withColumn("ranks", inside).filter(F.size("ranks") > 0)
    found = _narrowed(rows, groups, v, [r.asDict() for r in wanted.select(*groups, "lo", "hi", "rows", "before", "n", "ranks").collect()])
    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"`{g}` {kinds[g]}" for g in groups], "_lo double, _hi double, _before bigint, n bigint, _ranks array<bigint>"])
    table = df.sparkSession.createDataFrame([(*[f[g] for g in groups], f["lo"], f["hi"], f["before"], f["n"], f["ranks"]) for f in found], schema)
    here = rows.select(*groups, v.alias("_v"), F.lit(1).alias("_one")).alias("r")
    there = F.broadcast(table.withColumn("_one", F.lit(1))).alias("t")
    meets = (F.col("r._one") == F.col("t._one")) & F.col("_v").between(F.col("_lo"), F.col("_hi"))
    for g in groups:
        meets = meets & (F.col(f"r.{g}") == F.col(f"t.{g}"))
    carried = ["_before", "n", "_ranks"]
    kept = here.join(there, meets).groupBy(*[F.col(f"r.{g}").alias(g) for g in groups], "_lo", "_v").agg(
        F.count(F.lit(1)).alias("rows"), *[F.any_value(c).alias(c) for c in carried]
    )
    upto = Window.partitionBy(*groups, "_lo").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    kept = kept.withColumn("_upto", F.col("_before") + F.sum("rows").over(upto))
    return kept.select(
        *groups, "n",
        F.explode(F.filter("_ranks", lambda r: (r > F.col("_upto") - F.col("rows")) & (r <= F.col("_upto")))).alias("rank"), F.col("_v").alias("value"),
    )


def ranked_values(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    ranks: Callable[[Column], Column],
    bounded_groups: bool = False,
) -> DataFrame:
    """Value at each wanted 1-based rank; ``ranks(n)`` gives an array of BIGINT ranks.

    Returns ``groups, n, rank, value``.  Only bins holding a wanted rank are sorted.  With
    ``bounded_groups`` (groups fixed by configuration, such as column names) the wanted ranges are
    found first and broadcast, and all other rows are dropped before any shuffle.  Otherwise
    distinct values shuffle once, map-side combined.
    """
    if bounded_groups or not groups:
        return _bounded_ranks(df, groups, value, ranks)
    distinct, bins = _binned(df, groups, value, {"rows": F.lit(1)})
    wanted = bins.withColumn("_ranks", F.array_distinct(ranks(F.col("total_rows"))))
    wanted = wanted.withColumn(
        "_ranks",
        F.filter(
            "_ranks",
            lambda r: (r > F.col("_before_rows")) & (r <= F.col("_before_rows") + F.col("_in_rows")),
        ),
    ).filter(F.size("_ranks") > 0)
    by = [*groups, "_bin"]
    kept = distinct.join(wanted, by)
    inside = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    kept = kept.withColumn("_upto", F.col("_before_rows") + F.sum("rows").over(inside))
    return kept.select(
        *groups,
        F.col("total_rows").alias("n"),
        F.explode(
            F.filter("_ranks", lambda r: (r > F.col("_upto") - F.col("rows")) & (r <= F.col("_upto")))
        ).alias("rank"),
        F.col(value).cast("double").alias("value"),
    )


def quantiles(
    df: DataFrame, groups: Sequence[str], value: str, probs: dict[str, float], bounded_groups: bool = False
) -> DataFrame:
    """Linear-interpolated exact quantiles, one column per name in ``probs``."""

    def place(n: Column, p: float) -> Column:
        return (n - 1).cast("double") * F.lit(float(p))

    def low(n: Column, p: float) -> Column:
        return F.floor(place(n, p)).cast("long") + 1

    def ranks(n: Column) -> Column:
        wanted: list[Column] = []
        for p in probs.values():
            wanted += [low(n, p), F.least(low(n, p) + 1, n)]
        return F.array(*wanted)

    rows = ranked_values(df, groups, value, ranks, bounded_groups)
    n = F.col("n")
    columns = []
    for name, p in probs.items():
        lower = F.max(F.when(F.col("rank") == low(n, p), F.col("value")))
        upper = F.max(F.when(F.col("rank") == F.least(low(n, p) + 1, n), F.col("value")))
        share = F.max(place(n, p) - F.floor(place(n, p)))
        # Without anything between two neighbours the lower one is the quantile, infinite ones too.
        columns.append(F.when((lower == upper) | (share == 0), lower).otherwise(lower + (upper - lower) * share).alias(name))
    return rows.groupBy(*groups).agg(*columns)


def ordered_index(df: DataFrame, ts: str) -> DataFrame:
    """``ts, rank, total``: 0-based rank of each distinct timestamp and how many there are.

    Timestamps are ranked range by range; a day of ten million times is as many tasks as it needs.
    """
    return range_ranked(df.select(ts).filter(F.col(ts).isNotNull()).distinct(), [ts]).select(ts, "rank", "total")
