"""Intermediate tables in the shared folder, packed blobs, and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import shared_dir


def stored(df: DataFrame) -> DataFrame:
    """Write once to the session's shared folder and read back, so that later jobs don't recompute it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays of one bucket as one Arrow stream message, zstandard inside."""
    batch = pa.RecordBatch.from_pydict({"names": list(arrays), "data": [a.tobytes() for a in arrays.values()], "kinds": [a.dtype.str for a in arrays.values()]})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    batch = pa.ipc.open_stream(blob).read_next_batch()
    return {n: np.frombuffer(d, k) for n, d, k in zip(*(batch.column(c).to_pylist() for c in ("names", "data", "kinds")), strict=True)}


def groups_of(batches: Iterator[pa.RecordBatch], key: str, blob: str) -> Iterator[tuple[int, list[dict[str, np.ndarray]]]]:
    """(key, unpacked blobs) from batches sorted by key."""
    current, held = None, []
    for batch in batches:
        for k, b in zip(batch.column(key).to_pylist(), batch.column(blob), strict=True):
            if k != current and held:
                yield current, held
                held = []
            current = k
            held.append(unpack(b.as_py()))
    if held:
        yield current, held


#: Bits of a table of values by their leading bits: fixed, whatever the data.
TABLE_BITS = 27


def in_table(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value's bit is set."""
    place = values >> np.uint64(64 - TABLE_BITS)
    return (table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def by_leading_bits(values: np.ndarray, times: np.ndarray, parts: int) -> pa.RecordBatch:
    """Rows (bucket, blob) of sorted values and their counts; a bucket is a range of values."""
    part_of = (values >> np.uint64(64 - (parts - 1).bit_length())).astype(np.int64)
    cuts = np.append(np.flatnonzero(np.append(True, part_of[1:] != part_of[:-1])), len(values)) if len(values) else np.zeros(1, np.int64)
    blobs = [pack({"value": values[a:b], "times": times[a:b].astype(np.uint32)}) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(part_of[cuts[:-1]], pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])


def frequent_bits(counted: DataFrame, parts: int, least: int) -> np.ndarray:
    """Table of the values that ``counted`` (rows of ``by_leading_bits``) holds at least ``least`` times.

    The driver receives the table alone, 2 ** TABLE_BITS bits.
    """
    from .deploy import mapped

    size = (1 << TABLE_BITS) // parts

    def total_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blobs in groups_of(batches, "bucket", "blob"):
            value, times = (np.concatenate([b[n] for b in blobs]) for n in ("value", "times"))
            order = np.argsort(value)
            value, times = value[order], times[order].astype(np.int64)
            head = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
            value = value[head][np.add.reduceat(times, head) >= least]
            bits = np.zeros(size, bool)
            bits[(value >> np.uint64(64 - TABLE_BITS)).astype(np.int64) - bucket * size] = True
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([pack({"bits": np.packbits(bits, bitorder="little")})], pa.binary())], names=["bucket", "blob"])

    table = np.zeros((1 << TABLE_BITS) // 8, np.uint8)
    dealt = counted.repartition(parts, "bucket").sortWithinPartitions("bucket")
    for row in mapped(dealt, total_up, "bucket long, blob binary").toLocalIterator():
        bits = unpack(bytes(row["blob"]))["bits"]
        table[row["bucket"] * len(bits) : (row["bucket"] + 1) * len(bits)] = bits
    return table


#: Links in one file of a component table.
LINKS_PER_PART = 500_000


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each linked node reaches.

    Each round takes the least label among a node and its neighbours; from the fifth on, labels also
    jump to their own label, so that chains of any length end in few rounds. It stops when no label
    falls. Labels meet links in shuffled joins; no component is gathered in one place.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node <> other")
    both = both.union(both.select(F.col("other"), F.col("node")))
    # A node is its own neighbour: its label takes part in the minimum.
    edges = stored(both.union(both.select("node", F.col("node").alias("other"))).distinct())
    parts = max(4, -(-edges.count() // LINKS_PER_PART))
    keep = lambda df: stored(df.coalesce(parts))
    labels = keep(edges.groupBy("node").agg(F.min("other").alias("component")))
    rounds = 1
    while True:
        theirs = labels.select(F.col("node").alias("other"), F.col("component").alias("theirs"))
        new = edges.join(theirs, "other").groupBy("node").agg(
            F.min("theirs").alias("component"), F.max(F.when(F.col("other") == F.col("node"), F.col("theirs"))).alias("old")
        )
        if rounds >= 5:
            further = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
            new = new.join(further, "component", "left").select("node", F.least("component", "further").alias("component"), "old")
        new = keep(new)
        labels = new.select("node", "component")
        if not new.where("component <> old").limit(1).count():
            return labels
        rounds += 1
