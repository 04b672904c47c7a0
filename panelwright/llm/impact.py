"""Exact top-k search over an impact-ordered index, score at a time.

Vectors become integer vectors, floor(1024 * x) per component. A block of some thousand vectors is
indexed by postings: for every component, the block's rows in descending size of their value, cut
into segments of half an octave. A query meets the segments of a block in descending quantised
impact (its own component times the segment's upper end), several at a time, and adds their
contributions to the rows' accumulators. What a row has not yet been given is at most its unseen
components times the next segment's impact, so every row has a lower and an upper bound at any time.
Reading stops when few rows' upper bounds still reach the k-th best lower bound; those are rescored
in whole integers. Nothing else can be among the k best: stopping early never changes the result.

Defined cases: a vector that is null or holds null or a non-finite component takes no part; an empty
vector scores 0 with all; vectors of different lengths meet on the components that both have; equal
ids are different rows, and each row is kept from its own query only; a row without id is a candidate
that comes after all ids among equal scores; scores beyond the long range end at its borders; other
columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .deploy import mapped
from .store import pack, stored, unpack

#: Values in a block (2,048 vectors of 128 components).
BLOCK_VALUES = 1 << 18
#: Query vectors that a task holds, and parts of the index that each of their groups meets.
GROUP_QUERIES, PARTS = 16_384, 64
#: Larger or more components are kept as they came and multiplied as Python integers; below, every sum of
#: products stays under 2 ** 53, so the bounds are exact in doubles.
WIDE, LONG = float(1 << 20), 1 << 13
#: Reading goes on while more than this share of a block could still be among the best.
RESCORED_SHARE = 1 / 16
#: Segments to an octave of values.
_STEPS = 2
_LONG = np.iinfo(np.int64)


def _by_length(vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their components as doubles) of the usable vectors of each length."""
    there = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
    whole = vectors.take(pa.array(there))
    lengths = whole.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(lengths)
    odd = np.append(0, np.cumsum(~np.isfinite(flat)))
    good = odd[ends] == odd[ends - lengths]
    for length in np.unique(lengths[good]):
        mine = np.flatnonzero(good & (lengths == length))
        places = (ends[mine] - length)[:, None] + np.arange(length)
        yield there[mine], flat[places].reshape(len(mine), length)


def _exact_ints(row: np.ndarray) -> list[int]:
    return [int(v) * 1024 if abs(v) >= 1 << 53 else math.floor(1024 * v) for v in row.tolist()]


def _postings(values: np.ndarray) -> dict[str, np.ndarray]:
    """Per component: rows in descending size, and where each half octave of sizes ends."""
    n, width = values.shape
    size = np.abs(values)
    order = np.argsort(-size, axis=0, kind="stable").T
    # Level l holds sizes in [2 ** (l / 2), 2 ** ((l + 1) / 2)); zeros are in no segment.
    level = np.floor(_STEPS * np.log2(np.maximum(size, 1).astype(np.float64))).astype(np.int64)
    # Rounding of the logarithm must not lift a value over its segment's upper end.
    level += size >= np.exp2((level + 1) / _STEPS)
    top = int(level.max(initial=0))
    column = np.broadcast_to(np.arange(width), size.shape)[size > 0]
    counts = np.bincount(column * (top + 1) + (top - level[size > 0]), minlength=width * (top + 1)).reshape(width, top + 1)
    return {"order": order.astype(np.int32).ravel(), "counts": counts.astype(np.int32).ravel(), "top": np.array([top])}


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, asks, vector, row) batches to index blocks; rows are those of the input's partition."""
    for batch in batches:
        ids, asks, keys = (batch.column(c) for c in ("id", "asks", "row"))
        has = ids.is_valid().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        asks = asks.fill_null(False).to_numpy(zero_copy_only=False)
        keys = keys.to_numpy(zero_copy_only=False)
        for rows, raw in _by_length(batch.column("vector")):
            step = max(1, BLOCK_VALUES // max(1, raw.shape[1]))
            for a in range(0, len(rows), step):
                some, x = rows[a : a + step], raw[a : a + step]
                made = {"id": ids[some], "has": has[some], "asks": asks[some], "row": keys[some], "shape": np.array(x.shape)}
                if np.abs(x).max(initial=0) >= WIDE / 1024 or x.shape[1] > LONG:
                    made["raw"] = x.ravel()
                else:
                    values = np.floor(1024 * x).astype(np.int32)
                    made |= {"x": values.ravel(), **_postings(values)}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(keys[some[0]])], pa.int64()), pa.array([int(asks[some].sum())], pa.int64()), pa.array([pack(made)], pa.binary())],
                    names=["block", "asking", "blob"],
                )


class _Block:
    def __init__(self, held: dict[str, np.ndarray]):
        self.row, self.id, self.has = held["row"], held["id"], held["has"]
        self.n, self.width = (int(v) for v in held["shape"])
        self.raw = held["raw"].reshape(self.n, self.width) if "raw" in held else None
        self.whole: list[list[int]] | None = None
        if self.raw is None:
            self.x = held["x"].reshape(self.n, self.width)
            self.order = held["order"]
            self.values = self.x.T[np.repeat(np.arange(self.width), self.n), self.order].astype(np.float64)
            top = int(held["top"][0])
            counts = held["counts"].reshape(self.width, top + 1).astype(np.int64)
            begins = np.cumsum(counts, axis=1) - counts + np.arange(self.width)[:, None] * self.n
            live = counts > 0
            component = np.broadcast_to(np.arange(self.width)[:, None], counts.shape)[live]
            upper = np.exp2((top - np.arange(top + 1) + 1) / _STEPS)
            self.segments = component, np.broadcast_to(upper, counts.shape)[live], begins[live], counts[live]

    def scores(self, query: np.ndarray | list[int], rows: np.ndarray) -> np.ndarray:
        """Whole inner products with the given rows."""
        if self.raw is None and isinstance(query, np.ndarray):
            width = min(self.width, len(query))
            return self.x[rows, :width].astype(np.int64) @ query[:width]
        if self.whole is None:
            self.whole = [_exact_ints(r) for r in self.raw] if self.raw is not None else self.x.tolist()
        query = [int(v) for v in query]
        found = [sum(a * b for a, b in zip(query, self.whole[i])) for i in rows]  # noqa: B905  the shorter one ends it
        return np.array([min(max(v, _LONG.min), _LONG.max) for v in found], np.int64)

    def possible(self, query: np.ndarray | list[int], own: np.ndarray, k: int, floor: int | None) -> np.ndarray:
        """Rows that may be among the k best, given that k others score ``floor`` at least."""
        everyone = np.ones(self.n, bool)
        everyone[own] = False
        if self.raw is not None or not isinstance(query, np.ndarray) or not len(self.segments[0]):
            return np.flatnonzero(everyone)
        component, upper, begins, counts = self.segments
        mine = np.append(query, np.zeros(max(0, self.width - len(query)), np.int64)).astype(np.float64)[: self.width]
        impact = np.abs(mine)[component] * upper
        order = np.argsort(-impact, kind="stable")
        order = order[: np.searchsorted(-impact[order], 0.0)]
        sums, seen, others = np.zeros(self.n), np.zeros(self.n), int(everyone.sum())
        at, components = 0, int((mine != 0).sum())
        while True:
            following = impact[order[at]] if at < len(order) else 0.0
            slack = (components - seen) * following
            least = (sums - slack)[everyone]
            bar = -np.inf if floor is None else float(floor)
            if others >= k:
                bar = max(bar, np.partition(least, others - k)[others - k])
            alive = everyone & (sums + slack >= bar)
            if at >= len(order) or alive.sum() <= max(k, RESCORED_SHARE * self.n):
                return np.flatnonzero(alive)
            # The next segments: all of at least half this impact.
            to = at + int(np.searchsorted(-impact[order[at:]], -following / 2, side="right"))
            some = order[at:to]
            lengths = counts[some]
            ends = np.cumsum(lengths)
            places = np.arange(ends[-1]) + np.repeat(begins[some] - (ends - lengths), lengths)
            rows = self.order[places]
            sums += np.bincount(rows, self.values[places] * np.repeat(mine[component[some]], lengths), self.n)
            seen += np.bincount(rows, minlength=self.n)
            at = to


class _Best:
    """The k best rows of one query so far."""

    def __init__(self, k: int, row: int, own: int, query: np.ndarray | list[int]):
        self.k, self.row, self.own, self.query = k, row, own, query
        self.held = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def meet(self, block: _Block) -> None:
        own = np.flatnonzero(block.row == self.row)
        floor = int(self.held[0][-1]) if len(self.held[0]) == self.k else None
        rows = block.possible(self.query, own, self.k, floor)
        if not len(rows):
            return
        new = (block.scores(self.query, rows), ~block.has[rows], block.id[rows], block.row[rows])
        score, without, number, row = (np.append(a, b) for a, b in zip(self.held, new, strict=True))
        # Complement, not negation: the smallest long has no opposite.
        order = np.lexsort((row, number, without, ~score))[: self.k]
        self.held = (score[order], without[order], number[order], row[order])


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: list[_Best] = []
        current = None

        def out() -> Iterator[pa.RecordBatch]:
            for q in asked:
                score, without, number, row = q.held
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(score), q.row), pa.int64()), pa.array(np.full(len(score), q.own), pa.int64()),
                        pa.array(number, pa.int64(), mask=without), pa.array(score, pa.int64()), pa.array(row, pa.int64()),
                    ],
                    names=["asker", "query_id", "vec_id", "score", "row"],
                )

        for batch in batches:
            for group, part, kind, blob in zip(*(batch.column(c) for c in ("group", "part", "kind", "blob")), strict=True):
                key = (group.as_py(), part.as_py())
                if key != current:
                    yield from out()
                    asked, current = [], key
                held = unpack(blob.as_py())
                if kind.as_py() == 1:
                    block = _Block(held)
                    for q in asked:
                        q.meet(block)
                    continue
                n, width = (int(v) for v in held["shape"])
                wide = held["raw"].reshape(n, width) if "raw" in held else None
                for i in range(n):
                    query = _exact_ints(wide[i]) if wide is not None else held["x"].reshape(n, width)[i].astype(np.int64)
                    asked.append(_Best(k, int(held["row"][i]), int(held["id"][i]), query))
        yield from out()

    return run


def _ask(groups: int):
    """Queries of an index block, dealt to groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob"):
                held = unpack(blob.as_py())
                n, width = (int(v) for v in held["shape"])
                name = "raw" if "raw" in held else "x"
                values, mine = held[name].reshape(n, width), np.flatnonzero(held["asks"])
                # Fibonacci hashing of the row's number.
                to = ((held["row"][mine].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(groups)
                for g in np.unique(to):
                    some = mine[to == g]
                    made = {"id": held["id"][some], "row": held["row"][some], "shape": np.array([len(some), width]), name: values[some].ravel()}
                    yield pa.RecordBatch.from_arrays([pa.array([int(g)], pa.int64()), pa.array([pack(made)], pa.binary())], names=["group", "blob"])

    return run


def top_k(vectors: DataFrame, asks: Column, k: int = 10, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``asks`` holds, the k best other rows.

    The index is built in place and stored once. Groups of at most about ``GROUP_QUERIES`` queries
    meet it in ``PARTS`` parts, a task for each pair, which reads its blocks one after another and
    keeps k rows for each query; what is shuffled is the packed index, once for each group.
    """
    slim = vectors.select(
        F.col(id).cast("long").alias("id"), F.coalesce(asks, F.lit(False)).alias("asks"), F.col(vector).alias("vector"),
        F.monotonically_increasing_id().alias("row"),
    )
    index = stored(mapped(slim, _index, "block long, asking long, blob binary"))
    asking = index.agg(F.coalesce(F.sum("asking"), F.lit(0))).first()[0]
    groups = max(1, -(-asking // GROUP_QUERIES))
    queries = mapped(index.where("asking > 0").select("blob"), _ask(groups), "group long, blob binary")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = queries.select("group", each(PARTS).alias("part"), F.lit(0).alias("kind"), "blob")
    right = index.select(
        each(groups).alias("group"), F.pmod(F.xxhash64("block"), F.lit(PARTS)).alias("part"), F.lit(1).alias("kind"), "blob"
    )
    dealt = left.union(right).repartition(groups * PARTS, "group", "part").sortWithinPartitions("group", "part", "kind")
    found = mapped(dealt, _search(k), "asker long, query_id long, vec_id long, score long, row long")
    place = Window.partitionBy("asker").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    ranked = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
