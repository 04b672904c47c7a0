"""Benchmark decontamination: size-partitioned MinHash containment search.

Items (short) are sought inside documents (long). A text's set holds the hashes of its distinct
five-word shingles, A-Z lower-cased (a text with fewer words has one shingle, all of it). Hashes are
random, so the smallest ones of a set are its MinHash sample. An item of q shingles contained to at
least ``least`` can lack at most q - ceil(least * q) of them; one of its floor(missing) + 1 smallest
hashes must therefore lie in the document: that sample is the item's signature, and the search
misses nothing. Items are partitioned by size; a partition's largest signature hash bounds which
document hashes are looked up for it, so large items are sought among few hashes.

Candidates are verified by the shingles themselves, word for word.

Items come to the tasks in blocks of bounded bytes, one pass over the documents each; documents are
never shuffled.

Defined cases: a null or empty text has no shingles, contains nothing and is contained in nothing;
repeated documents and items each count; null ids are passed on; extra columns are kept (a column of
the output's name is replaced); empty tables give no leaks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .deploy import mapped
from .flat import byte_sums, flat, lowered, pieces, ragged, span_hashes, window_hashes, words

SHINGLE = 5
#: Item text that travels with one pass.
BLOCK_BYTES = 16 << 20
LEAKS = "array<struct<item_id:bigint,n_item:int,n_shared:int>>"


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Hashes of all shingles (repeats included), shingles before each text, and their words."""
    buffer, offsets = flat(column)
    buffer = lowered(buffer)
    starts, ends, before = words(buffer, offsets)
    hashes = span_hashes(byte_sums(buffer), starts, ends)
    counts = np.diff(before)
    per_text = np.where(counts >= SHINGLE, counts - SHINGLE + 1, (counts > 0).astype(np.int64))
    edges = np.concatenate([[0], np.cumsum(per_text)])
    first = ragged(before[:-1], per_text)
    size = np.repeat(np.minimum(counts, SHINGLE), per_text)
    windows = np.zeros(len(first), np.uint64)
    long = size == SHINGLE
    if long.any():
        windows[long] = window_hashes(hashes, SHINGLE)[first[long]]
    for n in range(1, SHINGLE):
        here = size == n
        if here.any():
            windows[here] = window_hashes(hashes, n)[first[here]]
    return windows, edges, (buffer, starts, ends, first, size)


def _shingle_text(view: tuple, at: int) -> bytes:
    buffer, starts, ends, first, size = view
    w = range(first[at], first[at] + size[at])
    return b" ".join(buffer[starts[i] : ends[i]].tobytes() for i in w)


@dataclass
class Items:
    """One block of items: their shingle sets, and signatures by size partition."""

    ids: list
    hashes: list[np.ndarray]
    texts: list[dict[int, bytes]]
    least: Fraction

    @staticmethod
    def of(ids: list, texts: list[str | None], least: Fraction) -> Items:
        windows, edges, view = shingles(pa.array(texts, pa.string()))
        sets, spelled = [], []
        for i in range(len(ids)):
            own, at = np.unique(windows[edges[i] : edges[i + 1]], return_index=True)
            sets.append(own)
            spelled.append({int(h): _shingle_text(view, int(edges[i] + a)) for h, a in zip(own, at, strict=True)})
        return Items(ids, sets, spelled, least)

    def needed(self, q: int) -> int:
        return -(-q * self.least.numerator // self.least.denominator)

    def partitions(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Sorted signature hashes and their items, one pair of arrays for each power of two of the size."""
        by_size: dict[int, list] = {}
        for i, own in enumerate(self.hashes):
            if len(own):
                sample = own[: len(own) - self.needed(len(own)) + 1]
                by_size.setdefault(int(len(own)).bit_length(), []).append((sample, np.full(len(sample), i)))
        found = []
        for parts in by_size.values():
            h, i = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(h, kind="stable")
            found.append((h[order], i[order]))
        return found


def _search(column: pa.Array, items: Items, partitions: list) -> list[list[tuple]]:
    """For every text the contained items: (item_id, shingles of the item, shared)."""
    windows, edges, view = shingles(column)
    found: list[list[tuple]] = [[] for _ in range(len(column))]
    pairs = []
    for sample, owner in partitions:
        at = np.flatnonzero(windows <= sample[-1])
        lo, hi = np.searchsorted(sample, windows[at], "left"), np.searchsorted(sample, windows[at], "right")
        hit = hi > lo
        at, lo, n = at[hit], lo[hit], (hi - lo)[hit]
        docs = np.searchsorted(edges, at, "right") - 1
        pairs.append(np.stack([np.repeat(docs, n), owner[ragged(lo, n)]], 1))
    pairs = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
    doc, order = -1, None
    for d, i in pairs.tolist():
        if d != doc:
            doc, own = d, windows[edges[d] : edges[d + 1]]
            order = np.argsort(own, kind="stable")
            own = own[order]
        wanted = items.hashes[i]
        at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
        shared = 0
        for h, a in zip(wanted[own[at] == wanted].tolist(), at[own[at] == wanted].tolist(), strict=True):
            # All places of an equal hash are read: the words decide.
            while a < len(own) and own[a] == h:
                if _shingle_text(view, int(edges[d] + order[a])) == items.texts[i][h]:
                    shared += 1
                    break
                a += 1
        if shared >= items.needed(len(wanted)):
            found[d].append((items.ids[i], len(wanted), shared))
    return found


def _pass(docs: DataFrame, rows: list, least: Fraction, out: str) -> DataFrame:
    items_in = ([r["item_id"] for r in rows], [r["text"] for r in rows])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("n_item", pa.int32()), ("n_shared", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items.of(*items_in, least)
        partitions = items.partitions()
        for batch in batches:
            place = batch.schema.get_field_index(out)
            for part in pieces(batch, "text"):
                found = _search(part.column("text"), items, partitions)
                old = part.column(out).to_pylist()
                new = pa.array([[*a, *[dict(zip(("item_id", "n_item", "n_shared"), f, strict=True)) for f in b]] for a, b in zip(old, found, strict=True)], kind)
                columns = list(part.columns)
                columns[place] = new
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return mapped(docs, run, schema)


def with_leaks(docs: DataFrame, benchmark: DataFrame, least: str = "0.8", out: str = "leaks", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with the items that each contains to at least ``least`` of the item's shingles."""
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = benchmark.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    blocks = max(1, -(-total // block_bytes))
    numbered = benchmark.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    found = docs.drop(out).withColumn(out, F.expr(f"CAST(array() AS {LEAKS})"))
    for block in range(blocks):
        rows = numbered.where(F.col("_block") == block).select("item_id", "text").collect()
        if rows:
            found = _pass(found, rows, Fraction(least), out)
    return found


def contained_items(docs: DataFrame, benchmark: DataFrame, least: str = "0.8") -> DataFrame:
    """One row for each document and item it contains: doc_id, item_id, n_item, n_shared, containment."""
    found = with_leaks(docs.select("doc_id", "text"), benchmark, least)
    return found.select("doc_id", F.inline("leaks")).withColumn("containment", F.col("n_shared") / F.col("n_item"))
