"""Trie of conversations that are rebuilt over shared openings, totals by time-forward processing.

Turns become digests at once; texts are not shuffled. One sorted, range-partitioned stream of digests
gives every rebuilt turn its depth and the running 128-bit sum that names its node: a sum needs only
the sums of the partitions before, so one conversation may fill many partitions.

A node's smallest member owns it, and the nodes of one owner with one number of members are a run
without branches and ends: a segment, known by its deepest node. Subtree totals are worked out over
segments, which are at most two for each conversation however long it is.

Time-forward processing: nodes whose subtrees hold more than ``shard_size`` conversations form the
top; every subtree hanging below it is dealt to a shard. A shard's segments are sorted externally in
reverse level order; each segment takes the totals that its children have left for it in a queue,
ordered by level, and leaves its own for its parent. Levels that are needed last go to the task's
scratch file when the queue is large. What the shards' roots leave is summed by parent and meets the
segments of the top in the same way.

Defined cases: null role or text is empty; rows without conv_id belong to no conversation and are
left out; turns of equal number (nulls are first) are ordered by their digests; equal rows are
separate turns; a conversation whose rebuilt form has no turns is a member of the root alone;
quotients and remainders of negative ids are truncated, as in SQL; other columns are not looked at;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keyed import attach_by_key, durable
from .deploy import mapped
from .store import stored

#: Conversations of a subtree that stays whole in a shard, and the most nodes above all such subtrees.
SHARD_SIZE, TOP_NODES = 256, 100_000
#: Longest shared opening, and conversations that share one.
OPENING, FAMILY = 5, 100
#: Segments for each task of a shard pass.
TASK_SEGMENTS = 200_000
#: Messages in memory before the levels needed last go to disk.
QUEUE_MESSAGES = 500_000


# -- turns to digests, digests to paths ---------------------------------------------------------------


def digests(turns: DataFrame) -> DataFrame:
    """(conv, turn, k1, k2, chars, id): 128 bits of SHA-256 for role and text, code points of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    hexed = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    part = lambda at: F.conv(F.substring(hexed, at, 16), 16, -10).cast("long")
    return turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), part(1).alias("k1"), part(17).alias("k2"),
        F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("id"),
    )


def opening_length(conv: Column) -> Column:
    return F.pmod(F.crc32(F.encode(conv.cast("string"), "UTF-8")), F.lit(OPENING + 1)).cast("int")


def steps(own: DataFrame) -> DataFrame:
    """Stream of each conversation: a mark of its start, the opening's turns, then all of its own turns."""
    first = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "k1", "k2", "id")
    heads = own.where(F.col("conv") % FAMILY == 0).withColumn("place", F.row_number().over(first)).where(F.col("place") <= OPENING)
    heads = heads.select(F.col("conv").alias("base"), "place", "k1", "k2", "chars")
    convs = own.select("conv").distinct().withColumn("h", opening_length(F.col("conv")))
    none = F.lit(0).cast("long")
    marks = convs.select("conv", "h", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), none.alias("k1"), none.alias("k2"), none.alias("chars"), none.alias("id"))
    base = convs.withColumn("base", F.col("conv") - F.col("conv") % FAMILY)
    opened = base.join(heads, "base").where("place <= h").select(
        "conv", "h", F.lit(1).alias("kind"), F.col("place").cast("long").alias("turn"), "k1", "k2", "chars", none.alias("id")
    )
    mine = own.select("conv", opening_length(F.col("conv")).alias("h"), F.lit(2).alias("kind"), "turn", "k1", "k2", "chars", "id")
    return marks.union(opened).union(mine)


@dataclass(frozen=True)
class Carry:
    """What a conversation has gathered: turns of its opening and its own, and its running sums."""

    conv: int
    heads: int = 0
    own: int = 0
    s1: int = 0
    s2: int = 0
    chars: int = 0


def _mixed(z: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit values."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _walk(batch: pa.RecordBatch, carry: Carry | None) -> tuple[Carry | None, dict[str, np.ndarray]]:
    """Paths of one batch's rows, and what its last conversation carries on."""
    conv, kind, h, chars = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("conv", "kind", "h", "chars"))
    k1, k2 = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in ("k1", "k2"))
    n = len(conv)
    if not n:
        return carry, {}
    start = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
    segment = np.cumsum(np.append(False, conv[1:] != conv[:-1]))
    goes_on = carry is not None and carry.conv == conv[0]

    def running(values: np.ndarray, before: int) -> np.ndarray:
        """Sums within each conversation, the first one's from what was carried."""
        sums = np.cumsum(values, dtype=values.dtype)
        base = (sums[start] - values[start])[segment]
        out = sums - base
        if goes_on:
            out[segment == 0] += values.dtype.type(before)
        return out

    heads = running((kind == 1).astype(np.int64), carry.heads if goes_on else 0)
    own = running((kind == 2).astype(np.int64), carry.own if goes_on else 0)
    depth = heads + np.maximum(own - h, 0)
    counts = (kind == 1) | ((kind == 2) & (own > h))
    place = depth.astype(np.uint64) * _GOLDEN
    g1 = np.where(counts, _mixed(k1 + place), np.uint64(0))
    g2 = np.where(counts, _mixed((k2 ^ np.uint64(0xD6E8FEB86659FD93)) + place), np.uint64(0))
    s1, s2 = running(g1, carry.s1 if goes_on else 0), running(g2, carry.s2 if goes_on else 0)
    upto = running(np.where(counts, chars, 0), carry.chars if goes_on else 0)
    end = Carry(int(conv[-1]), int(heads[-1]), int(own[-1]), int(s1[-1]), int(s2[-1]), int(upto[-1]))
    keep = counts | (kind == 0)
    long = lambda a: a[keep].view(np.int64)
    return end, {
        "conv": conv[keep], "depth": depth[keep], "p1": long(s1), "p2": long(s2), "q1": long(s1 - g1), "q2": long(s2 - g2),
        "chars": np.where(counts, chars, 0)[keep], "upto": upto[keep],
    }


_CARRY = "part int, first long, last long, heads long, own long, s1 long, s2 long, chars long"


def _ends(starts: dict[int, Carry | None]):
    """The last conversation of each partition and what it carries, as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        carry, first = starts.get(part), None
        for batch in batches:
            if batch.num_rows:
                first = batch.column("conv")[0].as_py() if first is None else first
                carry, _ = _walk(batch, carry)
        if first is not None:
            signed = lambda v: int(np.uint64(v).view(np.int64))
            values = [part, first, carry.conv, carry.heads, carry.own, signed(carry.s1), signed(carry.s2), carry.chars]
            names = [c.split()[0] for c in _CARRY.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32() if c == "part" else pa.int64()) for c, v in zip(names, values, strict=True)], names=names)

    return run


def _paths(starts: dict[int, Carry | None]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = starts.get(TaskContext.get().partitionId())
        for batch in batches:
            carry, made = _walk(batch, carry)
            if made:
                yield pa.RecordBatch.from_pydict(made)

    return run


def paths(stream: DataFrame) -> DataFrame:
    """(conv, depth, p1, p2, q1, q2, chars, upto): one row for each rebuilt turn and each start.

    p names the node, q its parent. The checkpoint keeps partitions and their order, so the driver
    can hand each partition what the ones before it carry: one row of counts each, then one of sums.
    """
    order = ["conv", "kind", "turn", "k1", "k2", "id"]
    lined = durable(stream.repartitionByRange(*order).sortWithinPartitions(*order))
    # Partitions after the first of a long conversation: the counts of turns fix the depths, so counts come first.
    starts: dict[int, Carry | None] = {}
    for names in (("heads", "own"), ("heads", "own", "s1", "s2", "chars")):
        rows = sorted(mapped(lined, _ends(starts), _CARRY).collect(), key=lambda r: r["part"])
        found: dict[int, Carry | None] = {}
        held: Carry | None = None
        for row in rows:
            part = row["part"]
            found[part] = held
            mine = {n: row[n] for n in names}
            given = starts.get(part)
            if row["first"] == row["last"] and held is not None and held.conv == row["last"]:
                # The row holds what the partition was given as well; only the rest is new.
                before = {n: getattr(given, n) if given is not None and given.conv == held.conv else 0 for n in names}
                mine = {n: getattr(held, n) + mine[n] - before[n] for n in names}
            for n in ("s1", "s2"):
                if n in mine:
                    mine[n] %= 1 << 64
            held = Carry(row["last"], **mine)
        starts = found
    return mapped(lined, _paths(starts), "conv long, depth long, p1 long, p2 long, q1 long, q2 long, chars long, upto long")


# -- totals of subtrees -------------------------------------------------------------------------------


class LevelQueue:
    """Messages to parents by their level, deepest first; levels needed last wait in a scratch file."""

    def __init__(self, most: int):
        self.most, self.held, self.count = most, {}, 0
        self.file, self.places = None, {}

    def push(self, level: np.ndarray, message: np.ndarray) -> None:
        if not len(level):
            return
        order = np.argsort(level, kind="stable")
        level, message = level[order], message[order]
        cuts = np.flatnonzero(np.append(True, level[1:] != level[:-1]))
        for a, b in zip(cuts, np.append(cuts[1:], len(level)), strict=True):
            self.held.setdefault(int(level[a]), []).append(message[a:b])
        self.count += len(level)
        while self.count > self.most and len(self.held) > 1:
            self._spill(min(self.held))

    def _spill(self, level: int) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()  # noqa: SIM115  scratch of this task alone, gone when it ends
        rows = np.concatenate(self.held.pop(level))
        self.count -= len(rows)
        self.file.seek(0, 2)
        self.places.setdefault(level, []).append((self.file.tell(), len(rows), rows.shape[1]))
        self.file.write(np.ascontiguousarray(rows).tobytes())

    def pop(self, level: int) -> np.ndarray | None:
        found = self.held.pop(level, [])
        self.count -= sum(len(m) for m in found)
        for at, n, width in self.places.pop(level, []):
            self.file.seek(at)
            found.append(np.frombuffer(self.file.read(8 * n * width), np.int64).reshape(n, width))
        return np.concatenate(found) if found else None


_TOTALS = ("convs", "least", "leaves", "saved", "children")
_SEGMENT = ("p1", "p2", "q1", "q2", "depth", "above", "span", *_TOTALS)
_DONE = "p1 long, p2 long, q1 long, q2 long, convs long, least long, leaves long, saved long, children long, below long, hangs boolean"
_NONE = np.iinfo(np.int64).max


def _forward(most: int):
    """Segments in reverse level order to their totals; ``hangs`` marks a shard's root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = LevelQueue(most)
        level, waiting = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in _SEGMENT], axis=1)
            hangs = batch.column("hangs").to_numpy(zero_copy_only=False).astype(bool)
            cuts = np.flatnonzero(np.append(True, rows[1:, 4] != rows[:-1, 4]))
            for a, b in zip(cuts, np.append(cuts[1:], len(rows)), strict=True):
                some, depth = rows[a:b], int(rows[a, 4])
                if depth != level:
                    level, waiting = depth, queue.pop(depth)
                totals = some[:, 7:].copy()
                if waiting is not None and len(waiting):
                    # Nodes and messages of one name stand together; a level may come in several batches.
                    names = np.concatenate([some[:, :2], waiting[:, :2]])
                    order = np.lexsort((names[:, 1], names[:, 0]))
                    fresh = np.append(True, (names[order][1:] != names[order][:-1]).any(axis=1))
                    group = np.empty(len(names), np.int64)
                    group[order] = np.cumsum(fresh) - 1
                    owner = np.full(group.max() + 1, -1, np.int64)
                    owner[group[: len(some)]] = np.arange(len(some))
                    to = owner[group[len(some) :]]
                    mine = to >= 0
                    for c in range(5):
                        (np.minimum if c == 1 else np.add).at(totals[:, c], to[mine], waiting[mine, 2 + c])
                    waiting = waiting[~mine]
                below = totals[:, 3].copy()
                totals[:, 2] = np.where(totals[:, 4] == 0, 1, totals[:, 2])
                totals[:, 3] += (totals[:, 0] - 1) * some[:, 6]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(x), pa.int64()) for x in (*some[:, :4].T, *totals.T, below)] + [pa.array(hangs[a:b])],
                    names=[c.split()[0] for c in _DONE.split(", ")],
                )
                inner = ~hangs[a:b] & (some[:, 5] >= 0)
                message = np.concatenate([some[inner, 2:4], totals[inner, :4], np.ones((int(inner.sum()), 1), np.int64)], axis=1)
                queue.push(some[inner, 5], message)

    return run


def _sort_pass(segments: DataFrame, parts: int, *keys: str) -> DataFrame:
    dealt = segments.repartition(parts, *keys) if keys else segments.repartition(parts)
    return mapped(dealt.sortWithinPartitions(F.col("depth").desc(), "p1", "p2"), _forward(QUEUE_MESSAGES), _DONE)


# -- digests of the conversations that end in a node --------------------------------------------------


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (p1, p2, conv) to pieces of a node's list: one row for each node of a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        p1, p2, conv = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("p1", "p2", "conv"))
        cuts = np.flatnonzero(np.append(True, (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])))
        upto = np.append(cuts[1:], len(p1))
        pieces = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(cuts, upto, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(p1[cuts]), pa.array(p2[cuts]), pa.array(conv[cuts]), pa.array(upto - cuts, pa.int64()), pa.array(pieces, pa.string())],
            names=["p1", "p2", "first", "n", "piece"],
        )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to one digest for each node; the list itself is never held."""
    current, digest, total, least = None, None, 0, 0
    made: list[tuple] = []
    for batch in batches:
        for p1, p2, first, n, piece in zip(*(batch.column(c).to_pylist() for c in ("p1", "p2", "first", "n", "piece")), strict=True):
            if (p1, p2) != current:
                if current is not None:
                    made.append((*current, total, least, digest.hexdigest()))
                current, digest, total, least = (p1, p2), hashlib.sha256(), 0, first
            else:
                digest.update(b",")
            digest.update(piece.encode())
            total += n
        if len(made) > 10_000:
            yield _digest_rows(made)
            made = []
    if current is not None:
        made.append((*current, total, least, digest.hexdigest()))
    if made:
        yield _digest_rows(made)


def _digest_rows(made: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names=["p1", "p2", "ends", "least_end", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(p1, p2, ends, least_end, ends_sha256) of (p1, p2, conv).

    Lists leave the sorted ranges as pieces of some thousand ids; a node's pieces then pass one task
    in order, since a digest has no other way, and none of them is kept.
    """
    order = ["p1", "p2", "conv"]
    pieces = mapped(
        ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order), _joined, "p1 long, p2 long, first long, n long, piece string"
    )
    dealt = pieces.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "first")
    return mapped(dealt, _hashed, "p1 long, p2 long, ends long, least_end long, ends_sha256 string")


# -- the trie -----------------------------------------------------------------------------------------


def trie(turns: DataFrame, shard_size: int = SHARD_SIZE) -> DataFrame:
    """One row for each node, the root included; columns as the module says, names as in the result."""
    spark = turns.sparkSession
    walked = stored(paths(steps(stored(digests(turns)))))
    node = ["p1", "p2"]
    nodes = walked.groupBy(*node, "depth").agg(
        F.min("conv").alias("conv"), F.count("*").alias("n"), F.min("q1").alias("q1"), F.min("q2").alias("q2"),
        F.min("chars").alias("chars"), F.min("upto").alias("upto"),
    )
    nodes = stored(nodes)
    at_end = walked.groupBy("conv").agg(F.max_by(F.struct(*node), "depth").alias("e")).select("conv", "e.p1", "e.p2")
    ended = end_digests(at_end)

    # Runs of one owner and one number of members.
    deep, high = F.struct("depth", *node, "upto"), F.struct("depth", "q1", "q2")
    runs = nodes.groupBy("conv", "n").agg(F.max(deep).alias("d"), F.min(high).alias("t"), F.sum("chars").alias("span"))
    runs = runs.select(
        "conv", "n", "d.p1", "d.p2", "d.depth", F.col("d.upto").alias("bottom"), "t.q1", "t.q2", F.col("t.depth").alias("top"),
        (F.col("t.depth") - 1).alias("above"), "span",
    )
    runs = stored(runs.join(ended, node, "left"))

    # Nodes with many members: fewer than rows / limit, as each owns that many rows.
    limit = max(shard_size, walked.count() // TOP_NODES)
    heavy = nodes.where(F.col("n") > limit).select(*node)
    below = walked.join(F.broadcast(heavy), node, "left_anti").groupBy("conv").agg(F.min(F.struct("depth", *node)).alias("r"))
    below = below.select("conv", F.col("r.depth").alias("r_depth"), F.col("r.p1").alias("r1"), F.col("r.p2").alias("r2"))
    own = {
        "convs": F.coalesce("ends", F.lit(0).cast("long")), "least": F.coalesce("least_end", F.lit(_NONE)), "leaves": F.lit(0).cast("long"),
        "saved": F.lit(0).cast("long"), "children": F.lit(0).cast("long"),
    }
    light = runs.where(F.col("n") <= limit).join(below, "conv").withColumns(own).withColumn("hangs", F.col("top") == F.col("r_depth"))
    light = stored(light.select(*_SEGMENT, "hangs", "r1", "r2"))
    parts = max(spark.sparkContext.defaultParallelism, -(-light.count() // TASK_SEGMENTS))
    low = stored(_sort_pass(light, parts, "r1", "r2"))

    left = low.where("hangs").groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(
        F.sum("convs").alias("_convs"), F.min("least").alias("_least"), F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"),
        F.count("*").alias("_children"),
    )
    crown = runs.where(F.col("n") > limit).withColumns(own).withColumn("hangs", F.lit(False)).join(left, node, "left")
    given = {c: (F.least(c, f"_{c}") if c == "least" else F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in _TOTALS}
    crown = crown.select(*[given.get(c, F.col(c)) for c in _SEGMENT], "hangs")
    done = low.unionByName(_sort_pass(crown, 1)).select(
        *node, "convs", "least", "leaves", "below", "children"
    )
    runs = stored(runs.join(done, node))

    # The parent of a run's first node is the last node of another run.
    owners = runs.where("children > 0").select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv").alias("parent"), "children")
    hung = attach_by_key(runs.drop("children"), owners.withColumnRenamed("children", "_weight"), ["q1", "q2"], "_weight").drop("_weight")
    hung = hung.join(runs.select(*node, "children"), node)
    known = stored(hung.select(
        "conv", "n", (F.col("depth") - F.col("top") + 1).alias("nodes"), F.col("depth").alias("bottom_depth"), "top", "bottom", "parent", "leaves", "below",
        "convs", "least", "children", "ends_sha256",
    ))
    whole = attach_by_key(nodes, known, ["conv", "n"], "nodes")
    last, first = F.col("depth") == F.col("bottom_depth"), F.col("depth") == F.col("top")
    nothing = hashlib.sha256(b"").hexdigest()
    return whole.select(
        F.col("least").alias("conv_id"), "depth",
        F.when(F.col("depth") == 0, None).when(first, F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.col("convs").alias("n_convs"), F.when(last, F.col("children")).otherwise(F.lit(1).cast("long")).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("below") + (F.col("convs") - 1) * (F.col("bottom") - F.col("upto") + F.col("chars"))).alias("saved_tokens"),
        F.when(last, F.coalesce("ends_sha256", F.lit(nothing))).otherwise(F.lit(nothing)).alias("ends_sha256"),
    )
