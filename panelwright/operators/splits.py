"""Chronological splits, folds and samples, ranked on distinct timestamps only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import settle
from ..functions.order_stats import ordered_index
from ..functions.scalars import ratio, rounded

SPLITS = ("train", "validation", "test")
RATIOS = (0.70, 0.15, 0.15)


def largest_remainder(total: Column, ratios: Sequence[float]) -> list[Column]:
    """Integer shares of ``total`` that add up to it; larger remainders first, then order."""
    exact = [total.cast("double") * F.lit(float(x)) for x in ratios]
    whole = [F.floor(e) for e in exact]
    rest = total - sum(whole[1:], whole[0])
    left = [e - w for e, w in zip(exact, whole)]
    shares = []
    for i, own in enumerate(left):
        ahead = F.lit(0)
        for j, other in enumerate(left):
            if j != i:
                ahead = ahead + (other >= own if j < i else other > own).cast("int")
        shares.append(whole[i] + (ahead < rest).cast("int"))
    return shares


def partition_bounds(df: DataFrame, ts: str, ratios: Sequence[float] = RATIOS) -> DataFrame:
    """First and last timestamp and timestamp count of each partition, by rank of distinct ts."""
    index = ordered_index(df, ts)
    a, b, _ = largest_remainder(F.col("total"), ratios)
    split = F.when(F.col("rank") < a, SPLITS[0]).when(F.col("rank") < a + b, SPLITS[1]).otherwise(SPLITS[2])
    return index.groupBy(split.alias("split")).agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("timestamps")
    )


def with_split(df: DataFrame, ts: str, bounds: DataFrame) -> DataFrame:
    """``split`` of each origin and the last timestamp of that split as ``_split_end``.

    The three boundaries reach every row as one scalar subquery; no join is involved.  Every
    entity of a timestamp moves together.
    """
    ends = bounds.agg(
        *[F.max(F.when(F.col("split") == s, F.col("last_ts"))).alias(s) for s in SPLITS]
    ).select(F.struct(*SPLITS))
    place = df.withColumn("_cuts", ends.scalar())
    split, end = None, None
    for s in SPLITS:
        inside = F.col(ts) <= F.col(f"_cuts.{s}")
        split = (F if split is None else split).when(inside, s)
        end = (F if end is None else end).when(inside, F.col(f"_cuts.{s}"))
    return place.withColumns({"split": split, "_split_end": end}).drop("_cuts")


def assign(df: DataFrame, ts: str, bounds: DataFrame, targets: dict[int, str] | None = None) -> DataFrame:
    """``split`` and, per horizon, whether the target timestamp stays inside it."""
    out = with_split(df, ts, bounds)
    inside = {
        f"target_within_split_h{h}": F.coalesce(
            (F.col(c) >= F.col(ts)) & (F.col(c) <= F.col("_split_end")), F.lit(False)
        )
        for h, c in (targets or {}).items()
    }
    return (out.withColumns(inside) if inside else out).drop("_split_end")


def split_summary(df: DataFrame, ts: str) -> DataFrame:
    """Timestamps, rows and timestamp share per partition."""
    counts = df.groupBy("split", ts).agg(F.count(F.lit(1)).alias("n")).groupBy("split").agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("timestamps"),
        F.sum("n").alias("rows"),
    )
    total = df.agg(F.count_distinct(ts)).scalar()
    return counts.withColumn("timestamp_ratio", rounded(ratio(F.col("timestamps"), total), 10))


def split_coverage(long: DataFrame) -> DataFrame:
    """Per target and split: origin, eligible, boundary-excluded and unlabelled rows, positives.

    ``long`` has ``target, split, available, within, value``.
    """
    usable = F.col("available") & F.col("within")
    return long.groupBy("target", "split").agg(
        F.count(F.lit(1)).alias("origin_rows"), F.count_if(usable).alias("eligible_rows"),
        F.count_if(~F.col("within")).alias("boundary_excluded_rows"),
        F.count_if(F.col("within") & ~F.col("available")).alias("label_unavailable_rows"),
        F.count_if(usable & (F.col("value") == "true")).alias("positive_rows"),
    )


def split_classes(long: DataFrame) -> DataFrame:
    """Rows of each class per class target and split, over the eligible rows."""
    usable = F.col("available") & F.col("within") & (F.col("kind") != "regression")
    return long.filter(usable).groupBy("target", "split", F.col("value").alias("class")).agg(F.count(F.lit(1)).alias("rows"))


def cv_folds(index: DataFrame, ts: str, folds: int, validation: int, gap: int) -> DataFrame:
    """Expanding training range, gap and validation range per fold, from one pass over the ranks."""
    n = F.col("total")
    aggs, records = [], []

    def at(place: Column, name: str) -> Column:
        aggs.append(F.max(F.when(F.col("rank") == place, F.col(ts))).alias(name))
        return F.col(name)

    for k in range(folds):
        start = n - folds * validation + k * validation
        train_end = start - gap - 1
        records.append(
            F.struct(
                F.lit(k + 1).alias("fold"), at(F.lit(0), f"a{k}").alias("train_start"),
                at(train_end, f"b{k}").alias("train_end"), F.col("_n"),
                at(train_end + 1, f"c{k}").alias("gap_start"), at(start - 1, f"d{k}").alias("gap_end"),
                at(start, f"e{k}").alias("validation_start"), at(start + validation - 1, f"f{k}").alias("validation_end"),
            )
        )
    row = index.agg(F.max("total").alias("_n"), *aggs)
    out = row.select(F.explode(F.array(*records)).alias("r")).select("r.*")
    return out.withColumn(
        "train_timestamps",
        (F.col("_n") - folds * validation + (F.col("fold") - 1) * validation - gap).cast("long"),
    ).drop("_n")


def fold_rows(df: DataFrame, ts: str, folds: DataFrame) -> DataFrame:
    """Rows with the fold and role they take part in (a row trains in several folds)."""
    table = folds.agg(
        F.array_agg(F.struct("fold", "train_start", "train_end", "validation_start", "validation_end"))
    ).scalar()
    t = F.col(ts)
    roles = F.transform(
        "_folds",
        lambda f: F.struct(
            f["fold"].alias("fold"),
            F.when(t.between(f["train_start"], f["train_end"]), "train")
            .when(t.between(f["validation_start"], f["validation_end"]), "validation").alias("role"),
            f["validation_start"].alias("validation_start"),
        ),
    )
    return settle(df, {"_folds": table}).withColumn("_r", F.explode(F.filter(roles, lambda r: r["role"].isNotNull()))).select(
        *df.columns, "_r.fold", "_r.role", "_r.validation_start"
    )


def fold_evidence(rows: DataFrame, ts: str, target_ts: str) -> DataFrame:
    """Ranges and counts per fold with both leakage checks."""
    train, valid = F.col("role") == "train", F.col("role") == "validation"
    out = rows.groupBy("fold").agg(
        F.count_if(train).alias("training_rows"), F.count_if(valid).alias("validation_rows"),
        F.max(F.when(train, F.col(ts))).alias("train_origin_end"),
        F.max(F.when(train, F.col(target_ts))).alias("train_target_end"),
        F.min(F.when(valid, F.col(ts))).alias("validation_origin_start"),
        F.max(F.when(valid, F.col(ts))).alias("validation_origin_end"),
        F.max("validation_start").alias("_start"),
    )
    return out.select(
        *[c for c in out.columns if c != "_start"],
        (F.col("train_origin_end") < F.col("validation_origin_start")).alias("origins_ordered"),
        (F.col("train_target_end") < F.col("_start")).alias("labels_ordered"),
    )


def evenly_spaced(df: DataFrame, ts: str, budget: int) -> DataFrame:
    """Rows of ``budget`` timestamps spread over the range, first and last included."""
    index = ordered_index(df, ts)
    n = F.col("total")
    step = (n - 1).cast("double") / F.lit(float(max(budget - 1, 1)))
    spaced = F.transform(
        F.sequence(F.lit(0), F.lit(budget - 1)),
        lambda i: F.when(i == budget - 1, n - 1).otherwise(F.floor(i * step)) if budget > 1 else F.lit(0).cast("long"),
    )
    chosen = index.filter((n <= budget) | F.array_contains(spaced, F.col("rank")))
    return df.join(chosen.select(ts), ts, "left_semi")


def calibration_halves(df: DataFrame, ts: str, fraction: float = 0.5) -> DataFrame:
    """Marks rows ``fit`` or ``assess`` by time: at least one timestamp on each side."""
    index = ordered_index(df, ts)
    n = F.col("total")
    cut = F.least(F.greatest(F.floor(n.cast("double") * fraction), F.lit(1)), n - 1)
    last = index.agg(F.max(F.when(F.col("rank") == cut - 1, F.col(ts)))).scalar()
    return df.withColumn("half", F.when(F.col(ts) <= last, "fit").otherwise("assess"))


def eligible(df: DataFrame, available: Column, within: Column) -> DataFrame:
    return df.filter(F.coalesce(available, F.lit(False)) & F.coalesce(within, F.lit(False)))


def encode(label: Column, order: Sequence[str]) -> Column:
    """0-based class index in a fixed order, null for an unknown label."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), label)
    return F.when(place > 0, place - 1).cast("int")


def earliest_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def seeded_sample(df: DataFrame, key: Sequence[str], n: int, seed: int) -> DataFrame:
    """A fixed pseudo-random set of ``n`` rows: smallest keyed digests, then key."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    return df.withColumn("_digest", digest).orderBy("_digest", *key).limit(n).drop("_digest")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (k * n_c) per class."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    sums = counts.agg(F.sum("rows").alias("n"), F.count(F.lit(1)).alias("k"))
    n, k = sums.select("n").scalar(), sums.select("k").scalar()
    return counts.withColumn("weight", rounded(n / (k * F.col("rows")), 10))


def imbalance(df: DataFrame, label: str) -> DataFrame:
    """Negative to positive ratio of a 0/1 label."""
    return df.agg(
        F.count_if(F.col(label) == 1).alias("positive_rows"), F.count_if(F.col(label) == 0).alias("negative_rows")
    ).withColumn("negative_to_positive", rounded(ratio(F.col("negative_rows"), F.col("positive_rows")), 10))
