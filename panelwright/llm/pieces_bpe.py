"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

Symbols of many words lie in flat numpy arrays. A round finds the smallest pair rank of each word
(a segmented minimum), merges its leftmost occurrences in all words at once, and compacts the
arrays; words without a mergeable pair leave. Pieces never reach over the start of a run of word
marks, so words are independent; each distinct word of a task is merged once.

Occurrences in one word merge together only if no new pair would have gone first; otherwise that
word merges its leftmost pair alone, so results equal one-by-one merging.

Defined cases: a null text is encoded as an empty one; a null id list is an empty one; a text may be
one long word; repeated texts give repeated ids; an existing column of the output's name is
replaced; all other columns are kept.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .deploy import mapped
from .flat import pieces, ragged

MARK = "▁"
_WORDS = re.compile(f"{MARK}+[^{MARK}]*")
_NONE = np.int64(1 << 40)
#: Distinct words, and characters in them, that a task remembers before it starts anew.
CACHE_WORDS, CACHE_CHARACTERS = 400_000, 4_000_000

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


@dataclass
class Vocabulary:
    """Pieces of a BPE model with byte fallback: texts, scores and kinds by id."""

    texts: list[str]
    scores: list[float]
    kinds: list[str]
    end_id: int
    _built: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_built"} | {"_built": {}}

    @staticmethod
    def load(path: str) -> Vocabulary:
        """From a sentencepiece model file, read on the driver; the tables travel with the job."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = []
        for i in range(model.get_piece_size()):
            kind = "unknown" if model.is_unknown(i) else "control" if model.is_control(i) else "byte" if model.is_byte(i) else "piece"
            kinds.append(kind)
        n = range(len(kinds))
        found = Vocabulary([model.id_to_piece(i) for i in n], [model.get_score(i) for i in n], kinds, model.eos_id())
        if any(MARK in t.lstrip(MARK) for t, k in zip(found.texts, kinds, strict=True) if k == "piece"):
            raise ValueError("a piece reaches over the start of a word; words can't be encoded alone")
        return found

    def tables(self) -> dict:
        """Symbol numbers, the pair table sorted by (left, right), and the ids of symbols."""
        if self._built:
            return self._built
        piece_ids = [i for i, k in enumerate(self.kinds) if k == "piece"]
        symbol = {self.texts[i]: s for s, i in enumerate(piece_ids)}
        for i in piece_ids:
            for c in self.texts[i]:
                symbol.setdefault(c, len(symbol))
        size = len(symbol)
        # Equal scores share a rank: then the leftmost pair goes first.
        ranks = {s: r for r, s in enumerate(sorted({self.scores[i] for i in piece_ids}, reverse=True))}
        keys, values, merged = [], [], []
        for i in piece_ids:
            text = self.texts[i]
            for cut in range(1, len(text)):
                left, right = symbol.get(text[:cut]), symbol.get(text[cut:])
                if left is not None and right is not None:
                    keys.append(left * size + right)
                    values.append(ranks[self.scores[i]])
                    merged.append(symbol[text])
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        bytes_at = {int(self.texts[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == "byte"}
        singles = np.full(0x110000, -1, np.int64)
        for text, s in symbol.items():
            if len(text) == 1:
                singles[ord(text)] = s
        ids = np.full(size, -1, np.int64)
        ids[: len(piece_ids)] = piece_ids
        self._built.update(
            size=size, keys=np.array(keys, np.int64)[order], ranks=np.array(values, np.int64)[order], merged=np.array(merged, np.int64)[order],
            singles=singles, ids=ids, bytes_at=bytes_at, unknown=next((i for i, k in enumerate(self.kinds) if k == "unknown"), 0),
        )
        return self._built


def _pair_ranks(left: np.ndarray, right: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """Rank and merged symbol of pairs; symbols from ``size`` on are characters of no piece."""
    key = np.where((left < t["size"]) & (right < t["size"]), left * t["size"] + right, -1)
    at = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
    hit = t["keys"][at] == key
    return np.where(hit, t["ranks"][at], _NONE), np.where(hit, t["merged"][at], -1)


def merge_words(symbols: np.ndarray, word: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """Merged symbols of all words and the word of each, in word order.

    ``symbols`` is flat, ``word`` the non-decreasing word number of each symbol.
    """
    done_symbols, done_words = [], []
    rank = np.full(len(symbols), _NONE)
    merged = np.full(len(symbols), -1, np.int64)
    if len(symbols) > 1:
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside], merged[inside] = _pair_ranks(symbols[inside], symbols[inside + 1], t)
    while len(symbols):
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        lengths = np.diff(np.append(starts, len(word)))
        least = np.repeat(np.minimum.reduceat(rank, starts), lengths)
        over = least == _NONE
        if over.any():
            done_symbols.append(symbols[over])
            done_words.append(word[over])
            keep = ~over
            symbols, word, rank, merged, least = symbols[keep], word[keep], rank[keep], merged[keep], least[keep]
            if not len(symbols):
                break
        chosen = rank == least
        chosen &= ~_odd_in_run(chosen)
        picked = _merge_round(symbols, word, rank, merged, chosen, t)
        # Words whose new pairs would have gone before their other occurrences merge the leftmost only.
        sites = np.flatnonzero(chosen)
        first_site = np.append(True, word[sites][1:] != word[sites][:-1])
        if not first_site.all():
            many = np.unique(word[sites][~first_site])
            new_word, new_rank = picked[1], picked[2]
            floor = np.full(int(word[-1]) + 1, _NONE)
            floor[word] = least
            early = np.unique(new_word[new_rank < floor[new_word]])
            again = np.intersect1d(many, early, assume_unique=True)
            if len(again):
                chosen[sites[~first_site & np.isin(word[sites], again)]] = False
                picked = _merge_round(symbols, word, rank, merged, chosen, t)
        symbols, word, rank, merged = picked
    if not done_symbols:
        return symbols, word
    all_symbols, all_words = np.concatenate(done_symbols), np.concatenate(done_words)
    order = np.argsort(all_words, kind="stable")
    return all_symbols[order], all_words[order]


def _odd_in_run(mask: np.ndarray) -> np.ndarray:
    """Every second True of a run of Trues: its pair overlaps the one before."""
    place = np.arange(len(mask))
    start = np.maximum.accumulate(np.where(mask & ~np.append(False, mask[:-1]), place, -1))
    return mask & ((place - start) % 2 == 1)


def _merge_round(symbols, word, rank, merged, chosen, t):
    symbols = np.where(chosen, merged, symbols)
    keep = ~np.append(False, chosen[:-1])
    changed = chosen | np.append(chosen[1:], False) | np.append(chosen[2:], [False] * min(2, len(chosen)))[: len(chosen)]
    symbols, word, rank, merged, changed = symbols[keep], word[keep], rank[keep].copy(), merged[keep].copy(), changed[keep]
    at = np.flatnonzero(changed)
    rank[at], merged[at] = _NONE, -1
    at = at[at + 1 < len(symbols)]
    at = at[word[at] == word[at + 1]]
    rank[at], merged[at] = _pair_ranks(symbols[at], symbols[at + 1], t)
    return symbols, word, rank, merged


class Encoder:
    """Encodes texts; remembers the words of its task."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v, self.t = vocabulary, vocabulary.tables()
        self._clear()

    def _clear(self) -> None:
        self.code: dict[str, int] = {}
        self.characters = 0
        self.ids, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, new: list[str]) -> None:
        points = np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, new), np.int64, len(new))
        self.characters += int(lengths.sum())
        single = self.t["singles"][points]
        symbols = np.where(single >= 0, single, self.t["size"] + points)
        symbols, word = merge_words(symbols, np.repeat(np.arange(len(new)), lengths), self.t)
        ids = np.where(symbols < self.t["size"], self.t["ids"][np.minimum(symbols, self.t["size"] - 1)], -1)
        lacking = np.flatnonzero(ids < 0)
        if len(lacking):
            # Characters of no piece become the pieces of their bytes.
            texts = {s: s - self.t["size"] if s >= self.t["size"] else None for s in np.unique(symbols[lacking]).tolist()}
            names = {s: k for k, s in enumerate(self.t["singles"].tolist()) if s in texts} if any(v is None for v in texts.values()) else {}
            spelled = {s: [self.t["bytes_at"].get(b, self.t["unknown"]) for b in chr(names[s] if p is None else p).encode("utf-8", "surrogatepass")] for s, p in texts.items()}
            times = np.ones(len(ids), np.int64)
            times[lacking] = [len(spelled[s]) for s in symbols[lacking].tolist()]
            flat = np.repeat(ids, times)
            at = np.cumsum(times) - times
            for i, s in zip(lacking.tolist(), symbols[lacking].tolist(), strict=True):
                flat[at[i] : at[i] + times[i]] = spelled[s]
            word, ids = np.repeat(word, times), flat
        sizes = np.bincount(word, minlength=len(new))
        for text in new:
            self.code[text] = len(self.code)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids with the end id after each text, and offsets."""
        if len(self.code) > CACHE_WORDS or self.characters > CACHE_CHARACTERS:
            self._clear()
        split = [_WORDS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        seen = dict.fromkeys(w for words in split for w in words)
        new = [w for w in seen if w not in self.code]
        if new:
            self._learn(new)
        counts = np.fromiter(map(len, split), np.int64, len(split))
        get = self.code.__getitem__
        codes = np.fromiter((get(w) for words in split for w in words), np.int64, int(counts.sum()))
        sizes = self.sizes[codes]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        edges = ends[np.concatenate([[0], np.cumsum(counts)])]
        ids = self.ids[ragged(self.starts[codes], sizes)]
        ids = np.insert(ids, edges[1:], self.v.end_id)
        return ids.astype(np.int32), edges + np.arange(len(edges))


class Decoder:
    """Decodes ids: bytes of pieces joined, one word mark dropped from the start."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.spelled = []
        for text, kind in zip(vocabulary.texts, vocabulary.kinds, strict=True):
            if kind == "byte":
                self.spelled.append(bytes([int(text[3:5], 16)]))
            elif kind == "control":
                self.spelled.append(b"")
            elif kind == "unknown":
                self.spelled.append(" ⁇ ".encode())
            else:
                self.spelled.append(text.replace(MARK, " ").encode())
        self.drops = [k == "piece" and t.startswith(MARK) for t, k in zip(vocabulary.texts, vocabulary.kinds, strict=True)]
        self.silent = [k == "control" for k in vocabulary.kinds]

    def decode(self, ids: list[int]) -> str:
        data = b"".join(map(self.spelled.__getitem__, ids))
        first = next((i for i in ids if not self.silent[i]), None)
        if first is not None and self.drops[first]:
            data = data[1:]
        return data.decode("utf-8", "each_byte")


def _with(df: DataFrame, column: str, kind: str) -> tuple[DataFrame, str]:
    df = df.drop(column)
    return df, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], f"`{column}` {kind}"])


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "ids") -> DataFrame:
    """The rows with the ids of their text, end id last."""
    df, schema = _with(df, out, "array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            for part in pieces(batch, text):
                ids, offsets = encoder.encode(part.column(text).to_pylist())
                column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, out])

    return mapped(df, run, schema)


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The rows with the text that their ids stand for."""
    df, schema = _with(df, out, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(vocabulary)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = []
                for row in part.column(ids):
                    values = row.values
                    texts.append(decoder.decode(values.to_numpy(zero_copy_only=False).tolist() if values is not None else []))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, out])

    return mapped(df, run, schema)


def encode_decode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The rows with ids and with the text they stand for in place of their text, in one pass.

    A task holds one worker, and in it one piece of a batch with its ids; the text leaves it no more.
    """
    kept = [f for f in df.schema if f.name not in (text, ids, decoded)]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], f"`{ids}` array<int>", f"`{decoded}` string"])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(vocabulary), Decoder(vocabulary)
        for batch in batches:
            for part in pieces(batch, text):
                flat, offsets = encoder.encode(part.column(text).to_pylist())
                texts = [decoder.decode(flat[a:b].tolist()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], column, pa.array(texts, pa.string())], names=[*names, ids, decoded])

    return mapped(df.select(*names, text), run, schema)
