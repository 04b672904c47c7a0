"""Ranks over a whole table without a window over it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keyed import durable, shared_dir, stored

#: Rows that one task ranks, on average over its ranges.
RANGE_ROWS = 500_000
# A row's place in its partition is the lower part of its monotone id.
_PLACE = (1 << 33) - 1


def range_ranked(df: DataFrame, order: Sequence[str], rank: str = "rank", total: str = "total") -> DataFrame:
    """0-based rank of every row in ascending order and the number of rows.

    Bounds of ranges are sampled, rows are dealt to ranges and sorted there, and the checkpoint keeps
    ranges and order.  A row's rank is its place plus the rows of all earlier ranges, of which the
    driver holds one number each.  Rows equal in all of ``order`` lie in one range, so the order
    should be unique.
    """
    spark = df.sparkSession
    shared_dir(spark)
    rows = stored(df)
    parts = max(1, -(-rows.count() // RANGE_ROWS))
    lined = durable(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    counts = {r["p"]: r["n"] for r in lined.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, offsets = 0, []
    for p in range(max(counts, default=-1) + 1):
        offsets.append(before)
        before += counts.get(p, 0)
    first = F.element_at(F.array(*[F.lit(n).cast("long") for n in offsets or [0]]), F.spark_partition_id() + 1)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))
    return lined.withColumns({rank: first + place, total: F.lit(before).cast("long")})
