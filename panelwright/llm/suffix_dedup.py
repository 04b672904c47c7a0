"""Suffix-array deduplication of byte strings.

A window is ``K`` consecutive bytes of one text. Its anchor is the smallest hash among its runs of
``ANCHOR`` bytes, and consecutive windows of one anchor form a string. Equal windows have equal
anchors, so only strings of anchors that occur more than once can repeat: a first pass counts
anchors and the hashes of their strings, and keeps two bit tables of fixed size: of the repeated
anchors, and of those whose strings differ (a false bit costs work, never a result). A second pass
packs the strings of repeated anchors into buckets. Where an anchor's strings are all equal, and none
can repeat inside itself, their hashes travel alone: equal ones repeat as a whole. The others travel
with their bytes; each anchor's strings get a suffix array by Lyndon grouping (``lyndon``), in which
equal windows are neighbours. Every byte that a repeated window covers is removed, all its
occurrences alike.

Equal strings meet once: a task settles those it holds itself and sends one. Anchors of very many
strings are split by a second anchor of another hash order.

Defined cases: a null text is empty; a text shorter than ``K`` bytes keeps all; overlapping
occurrences count; equal texts of ``K`` bytes or more lose everything; rows with equal doc_id are
texts of their own unless their texts are equal too, and then they repeat each other; a null doc_id
is like any other; empty tables return none; other columns are kept, except ones named like the
result's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .deploy import mapped
from .flat import byte_sums, covered, flat, mixed, pieces, ragged, same_spans, span_hashes
from .lyndon import suffix_arrays
from .store import groups_of, pack, stored, unpack
from .substring import attach, keyed

K = 200
ANCHOR = 64
PIECE = 1 << 19
#: Bits of a table of anchors, by their leading bits: fixed, whatever the data.
TABLE_BITS = 27
#: Text for one bucket of strings, and for one bucket of counted anchors.
BUCKET_BYTES = 32 << 20
COUNTED_BYTES = 128 << 20
#: Anchors that a task counts before it sends them.
HELD_ANCHORS = 1 << 20
#: At most so many anchors are split by a second one.
HOT_ANCHORS = 20_000
#: Bytes of strings that a task packs together.
HELD_BYTES = 16 << 20
#: Bytes of suffix arrays built side by side.
BATCH = 750_000
_U = np.uint64
_LAST = np.int64((1 << 63) - 1)
_SECOND = _U(0xA24BAED4963EE407)


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` consecutive values."""
    out, span = values, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class Strings:
    """Strings of windows with one anchor, of all texts of a piece."""

    def __init__(self, column: pa.Array, k: int, hot: np.ndarray | None = None) -> None:
        self.buffer, self.offsets = flat(column)
        anchor = min(ANCHOR, k)
        empty = np.zeros(0, np.int64)
        self.begin = self.windows = self.text = empty
        self.anchor = self.name = self.content = empty.astype(np.uint64)
        self.again = empty.astype(bool)
        if len(self.buffer) < k:
            self.sums = byte_sums(self.buffer)
            return
        self.sums = byte_sums(self.buffer)
        at = np.arange(len(self.buffer) - anchor + 1)
        hashes = span_hashes(self.sums, at, at + anchor)
        least = _smallest(hashes, k - anchor + 1)
        lengths = np.diff(self.offsets)
        valid = ragged(self.offsets[:-1], np.maximum(lengths - k + 1, 0))
        if not len(valid):
            return
        text = np.repeat(np.arange(len(lengths)), np.maximum(lengths - k + 1, 0))
        value = least[valid]
        name = value
        if hot is not None and len(hot):
            is_hot = hot[np.minimum(np.searchsorted(hot, value), len(hot) - 1)] == value
            if is_hot.any():
                second = _smallest(mixed(hashes ^ _SECOND), k - anchor + 1)[valid]
                name = np.where(is_hot, mixed(value ^ mixed(second)), value)
        cut = np.append(True, (name[1:] != name[:-1]) | (value[1:] != value[:-1]) | (text[1:] != text[:-1]))
        first = np.flatnonzero(cut)
        self.begin, self.text = valid[first], text[first]
        self.windows = np.diff(np.append(first, len(valid)))
        self.anchor, self.name = value[first], name[first]
        self.content = span_hashes(self.sums, self.begin, self.begin + self.windows + k - 1)
        # Strings in which their anchor occurs more than once: between two occurrences no other
        # place is the smallest of a window, so they are neighbours among such places.
        width = k - anchor + 1
        edge = np.zeros(width - 1, np.uint64)
        largest = ~_smallest(~np.concatenate([edge, least, edge]), width)
        places = np.flatnonzero(hashes == largest)
        pairs = np.concatenate([[0], np.cumsum(hashes[places[1:]] == hashes[places[:-1]])])
        lo = np.searchsorted(places, self.begin)
        hi = np.searchsorted(places, self.begin + self.windows - 1 + k - anchor, "right") - 1
        self.again = pairs[np.maximum(hi, lo)] > pairs[lo]


def _bits_at(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    place = values >> _U(64 - TABLE_BITS)
    return (table[(place >> _U(3)).astype(np.int64)] >> (place & _U(7)).astype(np.uint8)) & 1 == 1


def _by_anchor(anchor: np.ndarray, content: np.ndarray, parts: int) -> pa.RecordBatch:
    """Rows (bucket, blob) of the distinct pairs and how often they occur; a bucket is a range of anchors."""
    order = np.lexsort((content, anchor))
    anchor, content = anchor[order], content[order]
    head = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])))
    times = np.diff(np.append(head, len(anchor)))
    anchor, content = anchor[head], content[head]
    part_of = (anchor >> _U(64 - (parts - 1).bit_length())).astype(np.int64)
    cuts = np.append(np.flatnonzero(np.append(True, part_of[1:] != part_of[:-1])), len(anchor))
    blobs = [pack({"value": anchor[a:b], "content": content[a:b], "times": times[a:b].astype(np.uint32)}) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(part_of[cuts[:-1]]), pa.array(blobs, pa.binary())], names=["bucket", "blob"])


def repeated_anchors(rows: DataFrame, total: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit tables of anchors that occur more than once and of those whose strings differ or may repeat
    inside themselves, and the sorted anchors of very many strings.
    """
    parts = 1 << min(12, max(4, (total // COUNTED_BYTES).bit_length()))
    often = max(512, total // 64 // HOT_ANCHORS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                s = Strings(part.column("text"), k)
                if not len(s.anchor):
                    continue
                # A string that may repeat inside itself counts as two that differ.
                held.append((np.concatenate([s.anchor, s.anchor[s.again]]), np.concatenate([s.content, ~s.content[s.again]])))
                size += len(held[-1][0])
                if size > HELD_ANCHORS:
                    yield _by_anchor(*(np.concatenate(x) for x in zip(*held, strict=True)), parts)
                    held, size = [], 0
        if held:
            yield _by_anchor(*(np.concatenate(x) for x in zip(*held, strict=True)), parts)

    def total_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blobs in groups_of(batches, "bucket", "blob"):
            value, content, times = (np.concatenate([b[n] for b in blobs]) for n in ("value", "content", "times"))
            order = np.argsort(value)
            value, content, times = value[order], content[order], times[order].astype(np.int64)
            head = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
            sums, value = np.add.reduceat(times, head), value[head]
            differ = np.minimum.reduceat(content, head) != np.maximum.reduceat(content, head)
            size = (1 << TABLE_BITS) // parts
            place = (value >> _U(64 - TABLE_BITS)).astype(np.int64) - bucket * size
            found = {"hot": value[sums >= often]}
            for name, chosen in (("bits", sums >= 2), ("mixed", differ)):
                bits = np.zeros(size, bool)
                bits[place[chosen]] = True
                found[name] = np.packbits(bits, bitorder="little")
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([pack(found)], pa.binary())], names=["bucket", "blob"])

    packed = mapped(rows.select("text"), count, "bucket long, blob binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    tables, hot = np.zeros((2, (1 << TABLE_BITS) // 8), np.uint8), []
    # Together the rows hold the bit tables and at most HOT_ANCHORS anchors.
    for row in mapped(packed, total_up, "bucket long, blob binary").collect():
        found = unpack(bytes(row["blob"]))
        for table, name in zip(tables, ("bits", "mixed"), strict=True):
            size = len(found[name])
            table[row["bucket"] * size : (row["bucket"] + 1) * size] = found[name]
        hot.append(found["hot"])
    return tables, np.sort(np.concatenate(hot)) if hot else np.zeros(0, np.uint64)


def _spans(doc, key, lo, hi) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, mask=doc == _LAST), pa.array(key.astype(np.int64)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["doc_id", "_key", "lo", "hi"]
    )


def _joined(doc: np.ndarray, key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """The ranges [lo, hi) of each text, those that meet made one."""
    if not len(doc):
        return doc, key, lo, hi
    order = np.lexsort((lo, key, doc))
    doc, key, lo, hi = doc[order], key[order], lo[order].astype(np.int64), hi[order].astype(np.int64)
    new = np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))
    # Ends so far, each text in a range of numbers of its own.
    base = (np.cumsum(new) - 1) << 32
    reach = np.maximum.accumulate(base + hi)
    first = np.flatnonzero(new | np.append(True, (base + lo)[1:] > reach[:-1]))
    last = np.append(first[1:], len(lo)) - 1
    return doc[first], key[first], lo[first], (reach - base)[last]


def _same_strings(name: np.ndarray, content: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For every string the first one of its name, hash and size."""
    order = np.lexsort((sizes, content, name))
    same = (name[order][1:] == name[order][:-1]) & (content[order][1:] == content[order][:-1]) & (sizes[order][1:] == sizes[order][:-1])
    first = np.empty(len(order), np.int64)
    first[order] = order[np.maximum.accumulate(np.where(np.append(True, ~same), np.arange(len(order)), 0))]
    return first


def _equal_strings(buffer: np.ndarray, begin: np.ndarray, sizes: np.ndarray, name: np.ndarray, content: np.ndarray) -> np.ndarray:
    """For every string the first one equal to it; bytes confirm equal hashes.

    A string whose hash but not bytes equal the first one's stays alone, which later comparison by
    suffixes makes good.
    """
    first = _same_strings(name, content, sizes)
    other = np.flatnonzero(first != np.arange(len(first)))
    good = same_spans(buffer, begin[other], buffer, begin[first[other]], sizes[other])
    first[other[~good]] = other[~good]
    return first


def _whole(first: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """Whether each string is known to occur more than once; ``first`` names its group."""
    return ((np.bincount(first, minlength=len(first)) > 1) | (np.bincount(first, weights=twice, minlength=len(first)) > 0))[first]


_PLACES = ("size", "name", "content", "doc", "key", "place", "twice")
_FLAGS = ("flag_doc", "flag_key", "flag_lo", "flag_hi")
_Arrays = dict[str, np.ndarray]


def _settled(strings: _Arrays, first: np.ndarray) -> tuple[_Arrays, tuple[np.ndarray, ...]]:
    """One string of each group, and the spans of those now found to occur more than once."""
    whole = _whole(first, strings["twice"])
    now = whole & ~strings["twice"]
    place = strings["place"][now].astype(np.int64)
    spans = strings["doc"][now], strings["key"][now], place, place + strings["size"][now]
    kept = first == np.arange(len(first))
    return {**{n: strings[n][kept] for n in _PLACES}, "twice": whole[kept]}, spans


def _strings(part: pa.RecordBatch, k: int, tables: np.ndarray, hot: np.ndarray) -> tuple[_Arrays, _Arrays, _Arrays] | None:
    """Strings of repeated anchors in one piece, one of each equal ones: those with bytes and those
    without; and the spans known to repeat.
    """
    s = Strings(part.column("text"), k, hot)
    chosen = np.flatnonzero(_bits_at(tables[0], s.anchor))
    if not len(chosen):
        return None
    begin, text = s.begin[chosen], s.text[chosen]
    sizes = s.windows[chosen] + k - 1
    strings = {
        "size": sizes.astype(np.uint32), "name": s.name[chosen], "content": s.content[chosen],
        "doc": part.column("doc_id").fill_null(int(_LAST)).to_numpy(zero_copy_only=False).astype(np.int64)[text],
        "key": part.column("_key").to_numpy(zero_copy_only=False).astype(np.uint32)[text],
        "place": (begin - s.offsets[:-1][text]).astype(np.uint32), "twice": np.zeros(len(chosen), bool),
    }
    first = _equal_strings(s.buffer, begin, sizes, strings["name"], strings["content"])
    sent, spans = _settled(strings, first)
    i = chosen[first == np.arange(len(first))]
    full = _bits_at(tables[1], s.anchor[i])
    light = {n: sent[n][~full] for n in _PLACES}
    sent = {n: sent[n][full] for n in _PLACES}
    sent["again"] = s.again[i[full]]
    sent["data"] = s.buffer[ragged(s.begin[i[full]], sent["size"].astype(np.int64))]
    return sent, light, dict(zip(_FLAGS, spans, strict=True))


def _packed(held: list[tuple[_Arrays, _Arrays, _Arrays]], buckets: int) -> pa.RecordBatch:
    """Rows (bucket, blob) of the strings of several pieces, again one of each equal ones."""
    sent, light, flags = ({n: np.concatenate([h[j][n] for h in held]) for n in held[0][j]} for j in range(3))
    spans = [tuple(flags.values())]
    sizes = sent["size"].astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    first = _equal_strings(sent["data"], begin, sizes, sent["name"], sent["content"])
    data, again, begin = sent["data"], sent["again"], begin[first == np.arange(len(first))]
    again = again[first == np.arange(len(first))]
    sent, found = _settled(sent, first)
    spans.append(found)
    light, found = _settled(light, _same_strings(light["name"], light["content"], light["size"]))
    spans.append(found)
    rows = {"bucket": [], "blob": []}
    told = _joined(*(np.concatenate(x) for x in zip(*spans, strict=True)))
    if len(told[0]):
        rows["bucket"].append(int(mixed(told[0][:1].view(np.uint64))[0] % _U(buckets)))
        rows["blob"].append(pack(dict(zip(_FLAGS, (told[0], told[1], told[2].astype(np.uint32), told[3].astype(np.uint32)), strict=True))))
    for strings, full in ((sent, True), (light, False)):
        bucket = (mixed(strings["name"]) % _U(buckets)).astype(np.int64)
        # Strings of one anchor stand together: near copies compress to little.
        order = np.lexsort((strings["name"], bucket))
        cuts = np.append(np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1])), len(order)) if len(order) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            i = order[a:b]
            rows["bucket"].append(int(bucket[i[0]]))
            own = {n: strings[n][i] for n in _PLACES}
            if full:
                own |= {"again": again[i], "data": data[ragged(begin[i], own["size"].astype(np.int64))]}
            rows["blob"].append(pack(own))
    return pa.RecordBatch.from_arrays([pa.array(rows["bucket"], pa.int64()), pa.array(rows["blob"], pa.binary())], names=["bucket", "blob"])


def repeated_windows(data: np.ndarray, begin: np.ndarray, sizes: np.ndarray, name: np.ndarray, k: int) -> np.ndarray:
    """Places in ``data`` where a window starts that another place of the same name's strings repeats.

    Strings of one name are laid end to end, a low separator after each, and sorted by suffixes;
    windows of equal bytes are then neighbours.
    """
    order = np.argsort(name, kind="stable")
    begin, sizes, name = begin[order], sizes[order], name[order]
    group = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
    strings = np.diff(np.append(group, len(name)))
    bytes_of = np.add.reduceat(sizes + 1, group)
    by_size = np.argsort(bytes_of, kind="stable")
    batch = np.cumsum(bytes_of[by_size]) // BATCH
    found = []
    for number in np.unique(batch):
        g = by_size[batch == number]
        own = ragged(group[g], strings[g])
        total = int((sizes[own] + 1).sum())
        text, origin = np.zeros(total, np.int64), np.zeros(total, np.int64)
        left = np.zeros(total, np.int64)  # bytes from here to the string's end
        to = ragged(np.cumsum(sizes[own] + 1) - sizes[own] - 1, sizes[own])
        origin[to] = ragged(begin[own], sizes[own])
        text[to] = data[origin[to]].astype(np.int64) + 1
        left[to] = np.repeat(sizes[own], sizes[own]) - ragged(np.zeros(len(own), np.int64), sizes[own])
        edges = np.concatenate([[0], np.cumsum(bytes_of[g])])
        suffixes = suffix_arrays(text, edges)
        owner = np.repeat(np.arange(len(g)), bytes_of[g])
        full = left[suffixes] >= k
        suffixes, owner = suffixes[full], owner[full]
        a, b = origin[suffixes[:-1]], origin[suffixes[1:]]
        sums = byte_sums((text - 1).astype(np.uint8))
        h = span_hashes(sums, suffixes, suffixes + k)
        alike = np.flatnonzero((h[1:] == h[:-1]) & (owner[1:] == owner[:-1]))
        alike = alike[same_spans(data, a[alike], data, b[alike], np.full(len(alike), k))]
        found += [a[alike], b[alike]]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _settle(blobs: list[_Arrays], k: int) -> Iterator[pa.RecordBatch]:
    told = [b for b in blobs if "flag_lo" in b]
    if told:
        yield _spans(*(np.concatenate([b[n] for b in told]) for n in _FLAGS))
    light = [b for b in blobs if "name" in b and "data" not in b]
    if light:
        strings = {n: np.concatenate([b[n] for b in light]) for n in _PLACES}
        yield _spans(*_settled(strings, _same_strings(strings["name"], strings["content"], strings["size"]))[1])
    packed = [b for b in blobs if "data" in b]
    if not packed:
        return
    strings = {n: np.concatenate([b[n] for b in packed]) for n in _PLACES}
    data, again = (np.concatenate([b[n] for b in packed]) for n in ("data", "again"))
    sizes = strings["size"].astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    first = _equal_strings(data, begin, sizes, strings["name"], strings["content"])
    kept = np.flatnonzero(first == np.arange(len(first)))
    strings, found = _settled(strings, first)
    yield _spans(*found)
    begin, sizes, again, name = begin[kept], sizes[kept], again[kept], strings["name"]
    # A string alone with its name has nothing to meet, unless it can repeat inside itself.
    _, code, many = np.unique(name, return_inverse=True, return_counts=True)
    meet = (many[code] > 1) | again
    if not meet.any():
        return
    starts = repeated_windows(data, begin[meet], sizes[meet], name[meet], k)
    if not len(starts):
        return
    of = np.searchsorted(begin, starts, "right") - 1
    cut = np.flatnonzero(np.append(True, (starts[1:] != starts[:-1] + 1) | (of[1:] != of[:-1])))
    lo, hi = starts[cut], starts[np.append(cut[1:], len(starts)) - 1] + k
    of = of[cut]
    open_ = ~strings["twice"][of]
    of, lo, hi = of[open_], lo[open_], hi[open_]
    base = strings["place"][of].astype(np.int64) - begin[of]
    yield _spans(strings["doc"][of], strings["key"][of], base + lo, base + hi)


def repeated_spans(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, _key, spans) of texts with repeated windows; spans are byte ranges [lo, hi)."""
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    total = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    tables, hot = repeated_anchors(rows, total, k)
    shared = rows.sparkSession.sparkContext.broadcast((tables, hot))
    buckets = max(8, -(-total // BUCKET_BYTES))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, split = shared.value
        held, size = [], 0
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                if found := _strings(part, k, bits, split):
                    held.append(found)
                    size += len(found[0]["data"]) + 32 * len(found[1]["name"])
                if size > HELD_BYTES:
                    yield _packed(held, buckets)
                    held, size = [], 0
        if held:
            yield _packed(held, buckets)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in groups_of(batches, "bucket", "blob"):
            yield from _settle(blobs, k)

    packed = mapped(rows, spread, "bucket long, blob binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    found = mapped(packed, settle, "doc_id long, _key long, lo int, hi int")
    # A text's spans are bounded by its own bytes.
    return found.groupBy("doc_id", "_key").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def without_repeats(docs: DataFrame, k: int = K) -> DataFrame:
    """The documents with kept (remaining bytes), kept_text (those of whole characters), n_bytes, n_removed, n_spans.

    ``kept`` loses exactly the covered bytes. ``kept_text`` drops a character only if all its bytes
    are covered, so that it stays text.
    """
    docs = docs.drop("kept", "kept_text", "n_bytes", "n_removed", "n_spans")
    spans = stored(repeated_spans(docs, k))
    rows = attach(docs, spans)
    kept_fields = [f for f in rows.schema if f.name != "spans"]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept_fields], "kept binary, kept_text string, n_bytes long, n_removed long, n_spans long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                buffer, offsets = flat(part.column("text"))
                kept, texts, counts = [], [], []
                for i, ranges in enumerate(part.column("spans").to_pylist()):
                    data = buffer[offsets[i] : offsets[i + 1]]
                    if not ranges:
                        whole = data.tobytes()
                        kept.append(whole)
                        texts.append(whole.decode("utf-8"))
                        counts.append((len(data), 0, 0))
                        continue
                    lo, hi = np.array([(r["lo"], r["hi"]) for r in ranges], np.int64).T
                    gone = covered(len(data), lo, hi)
                    runs = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                    kept.append(data[~gone].tobytes())
                    heads = np.flatnonzero((data & 0xC0) != 0x80)
                    whole_char = np.repeat(np.logical_and.reduceat(gone, heads), np.diff(np.append(heads, len(data))))
                    texts.append(data[~whole_char].tobytes().decode("utf-8"))
                    counts.append((len(data), int(gone.sum()), runs))
                columns = [part.column(f.name) for f in kept_fields]
                numbers = np.array(counts, np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(kept, pa.binary()), pa.array(texts, pa.string()), *[pa.array(numbers[:, j]) for j in range(3)]],
                    names=[*[f.name for f in kept_fields], "kept", "kept_text", "n_bytes", "n_removed", "n_spans"],
                )

    return mapped(rows, run, schema)
