"""Joins and checkpoints that hold up under hot keys and lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Number of heaviest keys joined by broadcast.
HOT_SHARE = 1000
_SALTS = 1021


def attach_by_key(left: DataFrame, right: DataFrame, keys: Sequence[str], weight: str, salt: Sequence[str] = ()) -> DataFrame:
    """Left join one-row-per-key ``right``, whose ``weight`` counts the key's rows on the left.

    The heaviest ``HOT_SHARE`` keys are joined by a broadcast of that many rows; all others by a
    shuffle in which hot and null-key rows are spread over salts that match nothing.  ``salt`` names
    columns that tell rows apart; without it all columns are hashed.
    """
    keys = list(keys)
    values = [c for c in right.columns if c not in keys]
    # Any key outside the HOT_SHARE heaviest owns less than 1/HOT_SHARE of the rows.
    hot = right.orderBy(F.col(weight).desc(), *keys).limit(HOT_SHARE).select(
        *keys, *[F.col(c).alias(f"_hot_{c}") for c in values]
    )
    rest = right.withColumn("_salt", F.lit(0).cast("long"))
    no_key = F.lit(False)
    for key in keys:
        no_key = no_key | F.col(key).isNull()
    spread = F.pmod(F.xxhash64(*(salt or left.columns)), F.lit(_SALTS)) + 1
    first = left.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.when(F.col(f"_hot_{weight}").isNotNull() | no_key, spread).otherwise(F.lit(0).cast("long"))
    )
    joined = first.join(rest, [*keys, "_salt"], "left")
    return joined.select(
        *left.columns, *[F.coalesce(F.col(f"_hot_{c}"), F.col(c)).alias(c) for c in values]
    )


def settle(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later filters and projections read instead of recomputing.

    The optimizer copies an expression to every place that uses it; a generator over a one-element
    array is a boundary it does not copy through, so each row computes these once.
    """
    record = F.struct(*[expr.alias(name) for name, expr in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(record)))


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the session's ``spark.checkpoint.dir``.

    A local session without one gets a temporary folder; on a cluster that would be another machine's
    disk, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if folder:
        return folder
    context = spark.sparkContext
    existing = context.getCheckpointDir()
    if existing:
        return existing
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="panelwright-")
    context.setCheckpointDir(local)
    return local


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint so several jobs can reuse one result."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write once to the shared folder as Parquet, so that later jobs read only the columns they use."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal a scan of fewer splits than the cluster has cores to all of them; a larger scan stays as it is.

    For rows whose own work costs more than moving them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
