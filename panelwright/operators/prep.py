"""Preprocessing fitted on training rows only: imputation, scaling, encoding, assembly.

Fits return a statistics table with one row per column.  Applying reads it as one map through a
scalar subquery, so fitted values never pass through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keyed import attach_by_key
from ..functions.order_stats import quantiles
from ..functions.ranges import range_ranked
from .profile import unpivoted


@dataclass(frozen=True)
class Groups:
    numeric: tuple[str, ...]
    bounded: tuple[str, ...]
    binary: tuple[str, ...]
    categorical: tuple[str, ...]


def feature_groups(schema: T.StructType, names: Sequence[str], binary: Sequence[str] = (), bounded: Sequence[str] = ()) -> Groups:
    """Sort features into groups by type and configuration; an unsupported type fails."""
    found: dict[str, list[str]] = {"numeric": [], "bounded": [], "binary": [], "categorical": []}
    for name in names:
        kind = schema[name].dataType
        if name in binary or isinstance(kind, T.BooleanType):
            found["binary"].append(name)
        elif isinstance(kind, T.StringType):
            found["categorical"].append(name)
        elif isinstance(kind, T.NumericType):
            found["bounded" if name in bounded else "numeric"].append(name)
        else:
            raise ValueError(f"Unsupported feature type for {name}: {kind.simpleString()}")
    lost = set(bounded) - set(found["bounded"])
    if lost:
        raise ValueError(f"Bounded features must be numeric: {sorted(lost)}")
    return Groups(**{k: tuple(v) for k, v in found.items()})


def group_table(df: DataFrame, groups: Groups) -> DataFrame:
    rows = [
        F.struct(F.lit(name).alias("feature"), F.lit(kind).alias("group"))
        for kind, names in vars(groups).items()
        for name in names
    ]
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.explode(F.array(*rows)).alias("r")).select("r.*", "rows")


def fit_numeric(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Median, then mean, population deviation, minimum and maximum of the imputed values.

    An all-missing column is imputed with 0.
    """
    long = unpivoted(train, columns)
    medians = quantiles(long, ["column"], "value", {"m": 0.5}, bounded_groups=True)
    every = long.groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    medians = every.join(medians, "column", "left").select("column", F.coalesce("m", F.lit(0.0)).alias("median"))
    filled = long.join(medians, "column").withColumn("v", F.coalesce("value", "median"))
    stats = filled.groupBy("column").agg(
        F.max("median").alias("median"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation"),
        F.min("v").alias("minimum"), F.max("v").alias("maximum"),
    )
    # A constant column may show rounding noise instead of zero.
    flat = F.col("minimum") == F.col("maximum")
    return stats.withColumn("scale", F.when(flat, F.lit(1.0)).otherwise(F.col("deviation")))


def text_long(df: DataFrame, columns: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(*ids, F.explode(pairs).alias("r")).select(*ids, "r.*")


def fit_modes(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value per column, ties to the smallest."""
    counts = text_long(train, columns).filter("value IS NOT NULL").groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.groupBy("column").agg(
        F.min_by("value", F.struct((-F.col("n")).alias("n"), F.col("value").alias("v"))).alias("mode")
    )


def fit_categories(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sorted distinct imputed categories per column (a vocabulary, not rows)."""
    modes = fit_modes(train, columns)
    values = text_long(train, columns).join(modes, "column").select(
        "column", "mode", F.coalesce("value", "mode").alias("value")
    ).distinct()
    return values.groupBy("column").agg(
        F.max("mode").alias("mode"), F.array_sort(F.collect_set("value")).alias("categories")
    )


def as_map(stats: DataFrame) -> Column:
    """Statistics table as one ``column -> struct`` map; one entry per column."""
    fields = [c for c in stats.columns if c != "column"]
    return stats.agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct(*fields))))).scalar()


def impute(df: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    out = df.withColumn("_fit", as_map(stats))
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col("_fit")[c]["median"]) for c in columns}).drop("_fit")


def scale_standard(df: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    out = df.withColumn("_fit", as_map(stats))
    columns_out = {}
    for c in columns:
        fit = F.col("_fit")[c]
        columns_out[c] = (F.coalesce(F.col(c).cast("double"), fit["median"]) - fit["mean"]) / fit["scale"]
    return out.withColumns(columns_out).drop("_fit")


def scale_minmax(df: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Training minimum to 0, maximum to 1, a constant to 0."""
    out = df.withColumn("_fit", as_map(stats))
    columns_out = {}
    for c in columns:
        fit = F.col("_fit")[c]
        span = fit["maximum"] - fit["minimum"]
        value = F.coalesce(F.col(c).cast("double"), fit["median"]) - fit["minimum"]
        columns_out[c] = F.when(span == 0, value).otherwise(F.try_divide(value, span))
    return out.withColumns(columns_out).drop("_fit")


def impute_modes(df: DataFrame, modes: DataFrame, columns: Sequence[str]) -> DataFrame:
    out = df.withColumn("_fit", as_map(modes))
    kinds = dict(df.dtypes)
    return out.withColumns({c: F.coalesce(F.col(c), F.col("_fit")[c]["mode"].cast(kinds[c])) for c in columns}).drop("_fit")


def one_hot(df: DataFrame, categories: DataFrame, column: str, out: str) -> DataFrame:
    """Indicator array in sorted category order; an unknown category is all zeros."""
    fitted = df.withColumn("_fit", as_map(categories)[column])
    value = F.coalesce(F.col(column).cast("string"), F.col("_fit.mode"))
    hot = F.transform("_fit.categories", lambda c: (c == value).cast("double"))
    return fitted.withColumn(out, hot).drop("_fit")


def dictionary(train: DataFrame, column: str) -> DataFrame:
    """``value, index, size, rows`` of every category of a column in sorted order, one row each.

    Missing values count as the most frequent one.  For vocabularies of any size: no row or task
    holds them together.
    """
    fill = fit_modes(train, [column]).select("mode").scalar()
    counts = train.select(F.coalesce(F.col(column).cast("string"), fill).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("rows"))
    return range_ranked(counts, ["value"], "index", "size").select("value", "index", "size", "rows")


def index_categories(df: DataFrame, words: DataFrame, column: str, mode: Column, out: str = "index") -> DataFrame:
    """Index of each row's category by a join; null for a category that was not in the training rows."""
    keyed = df.withColumn("value", F.coalesce(F.col(column).cast("string"), mode))
    joined = attach_by_key(keyed, words.select("value", F.col("index").alias(out), "rows"), ["value"], "rows")
    return joined.drop("value", "rows")


def sparse_one_hot(df: DataFrame, index: str, size: int, out: str) -> DataFrame:
    """Sparse indicator vector of ``size`` places; a null index has none set."""
    encoder = OneHotEncoder(inputCol="_index", outputCol=out, dropLast=True)
    # The dropped last place stands for unknown categories.
    fitted = encoder.fit(df.sparkSession.createDataFrame([(float(size),)], "_index double"))
    return fitted.transform(df.withColumn("_index", F.coalesce(F.col(index), F.lit(size)).cast("double"))).drop("_index")


# Scaling per estimator family: (numeric, bounded).
POLICIES = {
    "linear": ("standard", "minmax"),
    "tree": ("none", "none"),
    "svm": ("standard", "minmax"),
    "recurrent": ("standard", "minmax"),
}


@dataclass(frozen=True)
class Fitted:
    groups: Groups
    numbers: DataFrame
    modes: DataFrame | None
    categories: DataFrame | None

    def transform(self, df: DataFrame, policy: str = "linear", out: str = "features") -> DataFrame:
        """Add the assembled feature vector under one family's policy."""
        numeric, bounded = POLICIES[policy]
        pick = {"standard": scale_standard, "minmax": scale_minmax, "none": impute}
        names = {c: f"_x_{c}" for c in (*self.groups.numeric, *self.groups.bounded, *self.groups.binary)}
        work = df.withColumns({f"_keep_{c}": F.col(c) for c in names})
        if self.groups.numeric:
            work = pick[numeric](work, self.numbers, self.groups.numeric)
        if self.groups.bounded:
            work = pick[bounded](work, self.numbers, self.groups.bounded)
        if self.groups.binary:
            work = impute_modes(work, self.modes, self.groups.binary)
        parts = [F.array(*[F.col(c).cast("double") for c in names])]
        for c in self.groups.categorical:
            work = one_hot(work, self.categories, c, f"_hot_{c}")
            parts.append(F.col(f"_hot_{c}"))
        work = work.withColumn(out, array_to_vector(F.concat(*parts)))
        restored = {c: F.col(f"_keep_{c}") for c in names}
        return work.withColumns(restored).drop(*[c for c in work.columns if c.startswith(("_keep_", "_hot_"))])


def fit(train: DataFrame, groups: Groups) -> Fitted:
    numbers = fit_numeric(train, [*groups.numeric, *groups.bounded])
    modes = fit_modes(train, groups.binary) if groups.binary else None
    categories = fit_categories(train, groups.categorical) if groups.categorical else None
    return Fitted(groups, numbers, modes, categories)


def statistics_table(fitted: Fitted) -> DataFrame:
    """Imputer values, scales, ranges and categories in one persisted table."""
    out = fitted.numbers.select(
        "column", F.lit("numeric").alias("kind"), F.col("median").alias("fill_number"), "mean", "scale", "minimum", "maximum"
    )
    if fitted.modes is not None:
        modes = fitted.modes.select("column", F.lit("binary").alias("kind"), F.col("mode").alias("fill_text"))
        out = out.unionByName(modes, allowMissingColumns=True)
    if fitted.categories is not None:
        texts = fitted.categories.select(
            "column", F.lit("categorical").alias("kind"), F.col("mode").alias("fill_text"),
            F.array_join("categories", "|").alias("categories"),
        )
        out = out.unionByName(texts, allowMissingColumns=True)
    return out
