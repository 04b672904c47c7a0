"""Flat numpy views of text columns, used inside Arrow tasks.

Texts of a batch stay one byte buffer with offsets; words, spans and windows are index arrays into
it. Nothing here holds more than one piece of a batch (``pieces``), except a single longer text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 2 << 20
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = _U(0xD1B54A32D192ED03)
_powers: dict[str, np.ndarray] = {}
_BYTE_VALUES = np.random.default_rng(20250101).integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``limit`` bytes (a longer text stands alone)."""
    _, offsets = flat(batch.column(column))
    row = 0
    while row < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), batch.num_rows)
        yield batch.slice(row, end - row)
        row = end


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; a null is an empty text."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buffer = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    buffer = buffer[offsets[0] : offsets[-1]] if len(offsets) else buffer
    offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
    if column.null_count:
        gone = column.is_null().to_numpy(zero_copy_only=False)
        lengths = np.diff(offsets)
        if lengths[gone].any():
            keep = np.repeat(~gone, lengths)
            buffer, offsets = buffer[keep], np.concatenate([[0], np.cumsum(np.where(gone, 0, lengths))])
    return buffer, offsets


def lowered(buffer: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, other bytes as they are."""
    return _LOWER[buffer]


def words(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs without white space inside one text), and words before each text."""
    if not len(buffer):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inked = ~_SPACE[buffer]
    first = np.empty(len(buffer), bool)
    first[0] = True
    np.logical_not(inked[:-1], out=first[1:])
    inner = offsets[(offsets > 0) & (offsets < len(buffer))]
    first[inner] = True
    starts = np.flatnonzero(inked & first)
    last = np.empty(len(buffer), bool)
    last[-1] = True
    np.logical_not(inked[1:], out=last[:-1])
    last[inner - 1] = True
    ends = np.flatnonzero(inked & last) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of a 64-bit value."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, PIECE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"][:n], _powers["down"]


def byte_sums(buffer: np.ndarray) -> np.ndarray:
    """Running polynomial sums; ``span_hashes`` of any span follows from two of them."""
    up, _ = _power_tables(len(buffer) + 1)
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[buffer] * up[:-1], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal spans have equal hashes wherever they stand."""
    _, down = _power_tables(len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _STEP)


def window_hashes(items: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive items (len - k + 1 values, none when shorter)."""
    n = len(items) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total *= _BASE
        total += items[j : j + n]
    return mixed(total)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each range, one after another."""
    if not len(lengths):
        return np.zeros(0, np.int64)
    total = int(lengths.sum())
    shift = starts - np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return np.arange(total, dtype=np.int64) + np.repeat(shift, lengths)


def same_spans(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, lengths: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """Whether the bytes of two lists of equally long spans agree, compared in full, ``step`` bytes at a time."""
    same = np.ones(len(lengths), bool)
    upto = np.concatenate([[0], np.cumsum(lengths)])
    lo = 0
    while lo < len(lengths):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + step, "right")) - 1)
        part = lengths[lo:hi]
        differ = a[ragged(a_start[lo:hi], part)] != b[ragged(b_start[lo:hi], part)]
        before = np.concatenate([[0], np.cumsum(differ)])
        same[lo:hi] = before[upto[lo + 1 : hi + 1] - upto[lo]] == before[upto[lo:hi] - upto[lo]]
        lo = hi
    return same


def string_array(buffer: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Arrow strings over a byte buffer."""
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(np.ascontiguousarray(buffer).tobytes())).cast(pa.string())


def spaced(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts, each followed by one blank: bytes, word starts and ends, words before each text."""
    data = np.insert(buffer, offsets[1:], 0x20)
    inked = ~_SPACE[data]
    keep = inked.copy()
    keep[1:] |= inked[:-1]
    after = keep & ~inked
    before = np.concatenate([[0], np.cumsum(after)[offsets[1:] + np.arange(len(offsets) - 1)]])
    clean = np.where(inked, data, np.uint8(0x20))[keep]
    ends = np.flatnonzero(clean == 0x20)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    return clean, starts, ends, before


def covered(total: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which of ``total`` places lie in some range [lo, hi)."""
    change = np.bincount(lo, minlength=total + 1)[: total + 1].astype(np.int64) - np.bincount(hi, minlength=total + 1)[: total + 1]
    return np.cumsum(change)[:total] > 0
