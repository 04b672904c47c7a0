"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on what toxic texts hold beyond
ordinary ones. A text is cut into windows of about 64 bytes at word ends; each window is compressed
twice, with the ordinary dictionary and with the toxic one laid before the ordinary one, and the
bytes that toxic content saves are the window's evidence. The most telling windows of a text go
through a logistic curve whose weights and threshold are calibrated on other labelled texts.

Only fitting samples: at most ``Sample`` labelled texts, chosen by the smallest hash of their id,
reach the driver. Scoring reads every window of every whole text, without a shuffle.

Defined cases: a null or empty text has no evidence and gets the lowest score; equal texts have equal
scores; labels that are null, or of unknown documents, are not used; without labels of both kinds
every score is 0; other columns, lang and source never enter a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .deploy import mapped

WINDOW_BYTES = 64
LEVEL = 12
FEATURES = ("top", "top3", "strong")
_GRAM = 5
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class Sample:
    """Bounds of what fitting reads: texts per kind and characters per text."""

    toxic: int = 1500
    ordinary: int = 3000
    characters: int = 8000
    calibration: int = 1000


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    bias: float


def _grams(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = max(0, len(a) - _GRAM + 1)
    packed = np.zeros(n, np.uint64)
    for j in range(_GRAM):
        packed = (packed << np.uint64(8)) | a[j : j + n]
    return packed


def _novel_words(data: bytes, known: np.ndarray) -> bytes:
    """The words that hold a byte sequence which ordinary text does not."""
    grams = _grams(data)
    if not len(grams) or not len(known):
        return data
    new = known[np.minimum(np.searchsorted(known, grams), len(known) - 1)] != grams
    kept = [m.group() for m in _WORD.finditer(data) if new[max(0, m.start() - 1) : max(0, m.end() - _GRAM + 2)].any()]
    return b" " + b" ".join(kept) + b" "


def _padded(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "surrogatepass") + b" "


def train_dictionaries(toxic: list[str], ordinary: list[str], toxic_bytes: int = 4096, ordinary_bytes: int = 131072) -> tuple[bytes, bytes]:
    """Ordinary content, and toxic content laid before it (nearer matches are the cheaper ones)."""
    plain = [_padded(t) for t in ordinary]
    known = np.unique(np.concatenate([np.unique(_grams(t)) for t in plain]))
    novel = [s for t in toxic if len(s := _novel_words(_padded(t), known)) > _GRAM + 3]
    return _trained(plain, ordinary_bytes, 64, 8), _trained([s * 3 for s in novel], toxic_bytes, 16, 6)


def _trained(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """Content of a trained dictionary; the end of the samples themselves where they are too few to train on."""
    total = sum(map(len, samples))
    size = min(size, max(512, total // 4))
    try:
        content = zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()
    except zstandard.ZstdError:  # too few or too short samples
        return b"".join(samples)[-size:]
    return content[min(len(content) // 4, 256) :]  # entropy tables come first and are no text


def windows(data: bytes) -> list[bytes]:
    """Consecutive windows of at least ``WINDOW_BYTES``, ended at a blank where one is near."""
    found, start = [], 0
    while start < len(data):
        end = start + WINDOW_BYTES
        if end < len(data):
            blank = data.find(b" ", end, end + WINDOW_BYTES)
            end = blank if blank >= 0 else end
        found.append(b" " + data[start:end] + b" ")
        start = end
    return found


class Scorer:
    """Both compressors of a task."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        self.plain, self.marked = self._compressor(ordinary), self._compressor(toxic + ordinary)

    @staticmethod
    def _compressor(content: bytes):
        params = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0
        )
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(dict_data=data, compression_params=params)

    def evidence(self, text: str | None) -> tuple[float, float, float]:
        """Most bytes saved in a window, in its three best windows, and windows with strong savings (log)."""
        plain, marked = self.plain.compress, self.marked.compress
        saved = sorted((len(plain(w)) - len(marked(w)) for w in windows((text or "").lower().encode("utf-8", "surrogatepass"))), reverse=True)
        if not saved:
            return 0.0, 0.0, 0.0
        return float(max(saved[0], 0)), float(sum(x for x in saved[:3] if x > 0)), math.log1p(sum(x >= 4 for x in saved))


def with_evidence(docs: DataFrame, ordinary: bytes, toxic: bytes) -> DataFrame:
    """The documents with the three figures of ``Scorer.evidence`` as columns."""
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], *[f"_{n} double" for n in FEATURES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(ordinary, toxic)
        for batch in batches:
            found = np.array([scorer.evidence(t.as_py()) for t in batch.column("text")], float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(found[:, j]) for j in range(3)]], names=[*batch.schema.names, *[f"_{n}" for n in FEATURES]]
            )

    return mapped(docs, run, schema)


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 200, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Newton steps of a ridge logistic curve, both kinds weighted alike, then moved to the best F1 at 0.5."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (share * (p - y)) + ridge * w
        hess = (z * (share * p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    raw = z @ w
    order = np.argsort(-raw)
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    # Equal scores can't be parted: only places before a drop are thresholds.
    drop = np.append(np.diff(raw[order]) < -1e-9, True)
    best = int(np.argmax(np.where(drop, f1, -1)))
    low = raw[order[best + 1]] if best + 1 < len(y) else raw[order[best]] - 1
    return w[:-1], float(w[-1] - (raw[order[best]] + low) / 2)


def sampled_labels(labels: DataFrame, usable: Column, bounds: Sample) -> list[tuple[int, int, bool]]:
    """(doc_id, toxic, for calibration) of at most the bounded number of labels, by smallest hash."""
    usable_rows = labels.where(usable & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = []
    for kind, most in ((1, bounds.toxic), (0, bounds.ordinary)):
        rows = usable_rows.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most + bounds.calibration).collect()
        # The last fifth of a short list, or what exceeds the bound, calibrates.
        first = max(min(most, len(rows) - bounds.calibration), 4 * len(rows) // 5)
        chosen += [(r["doc_id"], kind, i >= min(first, most)) for i, r in enumerate(rows)]
    return chosen


def fit(docs: DataFrame, labels: DataFrame, usable: Column, bounds: Sample = Sample()) -> Model | None:
    """Dictionaries and calibrated curve from labels for which ``usable`` holds; None without both kinds."""
    chosen = sampled_labels(labels, usable, bounds)
    if {k for _, k, _ in chosen} != {0, 1}:
        return None
    # Bounded by Sample: its ids are the hinted side.
    wanted = F.broadcast(docs.sparkSession.createDataFrame(chosen, "doc_id long, _toxic int, _later boolean"))
    rows = docs.select("doc_id", "text").join(wanted, "doc_id").where("text is not null")
    texts = rows.where("not _later").select("_toxic", F.substring("text", 1, bounds.characters).alias("text")).collect()
    toxic, ordinary = ([r["text"] for r in texts if r["_toxic"] == k] for k in (1, 0))
    if not toxic or not ordinary:
        return None
    plain, marked = train_dictionaries(sorted(toxic), sorted(ordinary))
    seen = with_evidence(rows.where("_later").repartition(12), plain, marked).select("_toxic", *[f"_{n}" for n in FEATURES]).collect()
    seen = sorted(tuple(r) for r in seen)
    if {r[0] for r in seen} != {0, 1}:
        return Model(plain, marked, (1.0, 0.0, 0.0), -5.0)
    x, y = np.array([r[1:] for r in seen], float), np.array([r[0] for r in seen], float)
    w, b = fit_logistic(x, y)
    return Model(plain, marked, tuple(float(v) for v in w), b)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents with ``score`` (0 to 1) and ``predicted`` (1 where it is 0.5 or more)."""
    kept = docs.drop("score", "predicted")
    if model is None:
        return kept.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0))
    raw = F.lit(model.bias)
    for name, w in zip(FEATURES, model.weights, strict=True):
        raw = raw + F.lit(w) * F.col(f"_{name}")
    scored = with_evidence(kept, model.ordinary, model.toxic).withColumn("score", 1 / (1 + F.exp(-raw)))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).drop(*[f"_{n}" for n in FEATURES])


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5
