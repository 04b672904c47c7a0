"""Substring deduplication by super-k-mers.

A window is ``k`` consecutive words of one text. Its minimiser is the smallest hash among its runs
of ``M`` words; consecutive windows that share one travel as one string of words, packed by bucket
of the minimiser, so equal windows always meet in one bucket. There windows are sorted by hash and
document, and equal hashes are confirmed byte by byte. A window is repeated if its words also start
in a text of smaller doc_id; every word that a repeated window covers is removed.

Each piece of the input first settles what repeats inside it: a common passage leaves a piece once,
however many of its texts hold it, so no bucket gathers all copies.

Defined cases: a null text has no words; a null doc_id is larger than any other; rows with equal
doc_id do not remove each other's words; a text with fewer than ``k`` words has no window; repeated
rows, very long texts and empty tables need no care; other columns are kept, except ones named like
the result's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .deploy import mapped
from .flat import byte_sums, covered, flat, mixed, pieces, ragged, same_spans, span_hashes, spaced, string_array, window_hashes
from .store import groups_of, pack, stored

M = 4
PIECE = 3 << 20
#: Packed words that one bucket should hold.
BUCKET_BYTES = 5 << 20
#: Flagged texts up to this many bytes of spans are hinted for broadcast; beyond they join by shuffle.
BROADCAST_BYTES = 48 << 20
_LAST = np.int64((1 << 63) - 1)
_FLAGS = ("flag_doc", "flag_key", "flag_lo", "flag_hi")


def window_places(per_text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First word (global index) and text of every window, from the words of each text."""
    windows = np.maximum(per_text - k + 1, 0)
    start = np.cumsum(per_text) - per_text
    return ragged(start, windows), np.repeat(np.arange(len(per_text)), windows)


def repeated(clean: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, group: np.ndarray, doc: np.ndarray, hashes: np.ndarray, k: int) -> np.ndarray:
    """Windows whose words also occur in a smaller document of the same arrays.

    ``first`` is a window's first word, ``group`` the string it lies in, ``doc`` its document.
    Equal hashes are confirmed on bytes, whole runs of consecutive windows at a time.
    """
    flags = np.zeros(len(first), bool)
    order = np.lexsort((doc, hashes))
    h, d = hashes[order], doc[order]
    head = np.append(True, h[1:] != h[:-1])[: len(h)]
    lead = np.maximum.accumulate(np.where(head, np.arange(len(h)), 0))
    later = d > d[lead]
    own, rep = order[later], order[lead[later]]
    if not len(own):
        return flags
    by_place = np.argsort(own)
    own, rep = own[by_place], rep[by_place]
    joined = (own[1:] == own[:-1] + 1) & (rep[1:] == rep[:-1] + 1) & (group[own[1:]] == group[own[:-1]]) & (group[rep[1:]] == group[rep[:-1]])
    run = np.flatnonzero(np.append(True, ~joined))
    last = np.append(run[1:], len(own)) - 1
    a0, a1 = starts[first[own[run]]], ends[first[own[last]] + k - 1]
    b0, b1 = starts[first[rep[run]]], ends[first[rep[last]] + k - 1]
    good = (a1 - a0) == (b1 - b0)
    good[good] = same_spans(clean, a0[good], clean, b0[good], (a1 - a0)[good])
    flags[own] = np.repeat(good, last - run + 1)
    # Unequal words of equal hash: those hashes are settled by their bytes.
    for value in np.unique(hashes[own[np.repeat(~good, last - run + 1)]]).tolist():
        least: dict[bytes, int] = {}
        same = np.flatnonzero(hashes == np.uint64(value)).tolist()
        spelled = [clean[starts[first[w]] : ends[first[w] + k - 1]].tobytes() for w in same]
        for w, text in zip(same, spelled, strict=True):
            least[text] = min(int(doc[w]), least.get(text, int(doc[w])))
        for w, text in zip(same, spelled, strict=True):
            flags[w] = doc[w] > least[text]
    return flags


def _runs(flags: np.ndarray, first: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first and last window of each run of flagged neighbours in one string."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    cut = np.append(True, (at[1:] != at[:-1] + 1) | (group[at[1:]] != group[at[:-1]]))
    begin = np.flatnonzero(cut)
    return at[begin], at[np.append(begin[1:], len(at)) - 1]


def _spread(part: pa.RecordBatch, k: int, buckets: int) -> pa.RecordBatch:
    """Super-k-mers of one piece by bucket, and the spans already known to repeat."""
    buffer, offsets = flat(part.column("text"))
    clean, starts, ends, before = spaced(buffer, offsets)
    per_text = np.diff(before)
    first, text = window_places(per_text, k)
    doc = part.column("doc_id").fill_null(int(_LAST)).to_numpy(zero_copy_only=False).astype(np.int64)
    key = part.column("_key").to_numpy(zero_copy_only=False).astype(np.uint32)
    words = span_hashes(byte_sums(clean), starts, ends)
    known = repeated(clean, starts, ends, first, text, doc[text], window_hashes(words, k)[first], k) if len(first) else np.zeros(0, bool)
    lo, hi = _runs(known, first, text)
    place = first - before[:-1][text] if len(first) else first
    rows = {"bucket": [], "blob": []}
    if len(lo):
        t = text[lo]
        rows["bucket"].append(int(mixed(doc[t[:1]].view(np.uint64))[0] % np.uint64(buckets)))
        rows["blob"].append(pack({"flag_doc": doc[t], "flag_key": key[t], "flag_lo": place[lo].astype(np.uint32), "flag_hi": (place[hi] + k).astype(np.uint32)}))
    at = np.flatnonzero(~known)
    if len(at):
        small = window_hashes(words, M)
        least = small[first[at]].copy()
        where = first[at].copy()
        for j in range(1, k - M + 1):
            candidate = small[first[at] + j]
            better = candidate < least
            least[better] = candidate[better]
            where[better] = first[at][better] + j
        cut = np.append(True, (where[1:] != where[:-1]) | (at[1:] != at[:-1] + 1) | (text[at[1:]] != text[at[:-1]]))
        begin = np.flatnonzero(cut)
        final = np.append(begin[1:], len(at)) - 1
        bucket = (mixed(least[begin]) >> np.uint64(7)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        begin, final, bucket = begin[order], final[order], bucket[order].astype(np.int64)
        b0, b1 = starts[first[at[begin]]], ends[first[at[final]] + k - 1] + 1
        sizes = b1 - b0
        t = text[at[begin]]
        fields = {"size": sizes.astype(np.uint32), "doc": doc[t], "key": key[t], "place": place[at[begin]].astype(np.uint32)}
        cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            rows["bucket"].append(int(bucket[a]))
            rows["blob"].append(pack({"words": clean[ragged(b0[a:b], sizes[a:b])], **{n: v[a:b] for n, v in fields.items()}}))
    return pa.RecordBatch.from_arrays([pa.array(rows["bucket"], pa.int64()), pa.array(rows["blob"], pa.binary())], names=["bucket", "blob"])


def _spans(doc, key, lo, hi) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, mask=doc == _LAST), pa.array(key.astype(np.int64)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["doc_id", "_key", "lo", "hi"]
    )


def _settle(blobs: list[dict[str, np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    """Repeated spans of one bucket."""
    told = [b for b in blobs if "flag_lo" in b]
    if told:
        yield _spans(*(np.concatenate([b[n] for b in told]) for n in _FLAGS))
    packed = [b for b in blobs if "words" in b]
    if not packed:
        return
    clean, size, doc, key, place = (np.concatenate([b[n] for b in packed]) for n in ("words", "size", "doc", "key", "place"))
    ends = np.flatnonzero(clean == 0x20)
    starts = np.concatenate([[0], ends[:-1] + 1])
    edges = np.searchsorted(ends, np.concatenate([[0], np.cumsum(size.astype(np.int64))]))
    first, group = window_places(np.diff(edges), k)
    words = span_hashes(byte_sums(clean), starts, ends)
    flags = repeated(clean, starts, ends, first, group, doc[group], window_hashes(words, k)[first], k)
    lo, hi = _runs(flags, first, group)
    if len(lo):
        g = group[lo]
        base = place[g].astype(np.int64) - edges[:-1][g]
        yield _spans(doc[g], key[g], base + first[lo], base + first[hi] + k)


def keyed(docs: DataFrame) -> DataFrame:
    """The documents with ``_key``: 32 bits of the text's hash, which tell rows of one doc_id apart."""
    return docs.withColumn("_key", F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(0xFFFFFFFF)))


def repeated_spans(docs: DataFrame, k: int = 13) -> DataFrame:
    """(doc_id, _key, spans) of texts with repeated windows; spans are word ranges [lo, hi)."""
    total = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    buckets = max(8, -(-3 * total // BUCKET_BYTES))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                yield _spread(part, k, buckets)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in groups_of(batches, "bucket", "blob"):
            yield from _settle(blobs, k)

    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    packed = mapped(rows, spread, "bucket long, blob binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    found = mapped(packed, settle, "doc_id long, _key long, lo int, hi int")
    # A text's spans are bounded by its own words.
    return found.groupBy("doc_id", "_key").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def attach(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The documents with the stored spans of their text, joined without a shuffle of texts while these are few."""
    bytes_held = spans.agg(F.sum(F.size("spans") * 8 + 48).alias("b")).first()["b"] or 0
    side = spans.select(F.col("doc_id").alias("_doc"), F.col("_key").alias("_text_key"), "spans")
    side = F.broadcast(side) if bytes_held <= BROADCAST_BYTES else side
    left = keyed(docs.drop("spans"))
    return left.join(side, F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_text_key")), "left").drop("_doc", "_text_key", "_key")


def without_repeats(docs: DataFrame, k: int = 13) -> DataFrame:
    """The documents with kept_text (kept words joined by one blank), n_words and n_removed."""
    docs = docs.drop("kept_text", "n_words", "n_removed")
    spans = stored(repeated_spans(docs, k))
    rows = attach(docs, spans)
    kept_fields = [f for f in rows.schema if f.name != "spans"]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept_fields], "kept_text string, n_words long, n_removed long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                clean, starts, ends, before = spaced(*flat(part.column("text")))
                gone = np.zeros(len(starts), bool)
                for i, ranges in enumerate(part.column("spans").to_pylist()):
                    if ranges:
                        lo, hi = np.array([(r["lo"], r["hi"]) for r in ranges], np.int64).T
                        gone[before[i] : before[i + 1]] = covered(int(before[i + 1] - before[i]), lo, hi)
                left = np.concatenate([[0], np.cumsum(~gone)])[before]
                sizes = ends - starts + 1
                text = clean[np.repeat(~gone, sizes)]
                # Each kept word stands with one blank after it; a text's last blank goes.
                edges = np.concatenate([[0], np.cumsum(np.where(gone, 0, sizes))])[before]
                some = np.diff(left) > 0
                text = np.delete(text, edges[1:][some] - 1)
                edges = edges - np.concatenate([[0], np.cumsum(some)])
                n = np.diff(before)
                columns = [part.column(f.name) for f in kept_fields]
                yield pa.RecordBatch.from_arrays([*columns, string_array(text, edges), pa.array(n), pa.array(n - np.diff(left))], names=[*[f.name for f in kept_fields], "kept_text", "n_words", "n_removed"])

    return mapped(rows, run, schema)
