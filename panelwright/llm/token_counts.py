"""Token counts of a unigram tokenizer without making its tokens.

An Aho-Corasick automaton enumerates every vocabulary match of a word; dynamic programming keeps,
for each position, the best score and the number of pieces of the best path. Ties follow the
tokenizer: a later candidate wins only with a strictly better score, and candidates of one position
come longest first. A character that no one-character piece covers may become an unknown piece of
score min - 10; with byte fallback a piece out of the vocabulary counts its bytes, and neighbouring
unknown characters are one piece.

Texts are cut before every blank, which becomes a word mark (the pre-tokenizer that prepends marks
and splits at them), so each distinct word of a task is scored once.

Defined cases: a null or empty text has no tokens; texts may be one long word; repeated texts give
repeated counts; an existing column of the output's name is replaced, other columns are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .deploy import mapped

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 500_000


@dataclass(frozen=True)
class Unigram:
    """Pieces with log scores, in id order."""

    pieces: tuple[tuple[str, float], ...]
    unknown_id: int = 0
    byte_fallback: bool = True


def ranked_unigram(path: str) -> Unigram:
    """Unigram vocabulary of a sentencepiece model's pieces.

    The box holds no unigram model and none may be trained, so scores are a rule: -ln(rank + 2) by
    id, the shape of word frequencies.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return Unigram(tuple((model.id_to_piece(i), -math.log(i + 2)) for i in range(model.get_piece_size())), model.unk_id())


class Counter:
    """Automaton and remembered words of a task."""

    def __init__(self, vocabulary: Unigram) -> None:
        self.automaton = ahocorasick.Automaton()
        for text, score in vocabulary.pieces:
            self.automaton.add_word(text, (len(text), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary.pieces) - UNKNOWN_PENALTY
        names = {t for t, _ in vocabulary.pieces}
        self.fallback = vocabulary.byte_fallback and all(f"<0x{b:02X}>" in names for b in range(256))
        self.seen: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Pieces of the best path."""
        n = len(word)
        best, count = [0.0] + [0.0] * n, [0] + [-1] * n
        # Whether the best path ends in an unknown piece, which its neighbour would join.
        open_end = [False] * (n + 1)
        place, single = 0, False
        for end, (length, score) in self.automaton.iter(word):
            while place < end:
                if not single:
                    self._unknown(word, place, best, count, open_end)
                place, single = place + 1, False
            start = end + 1 - length
            if length == 1:
                single = True
            candidate = best[start] + score
            if count[end + 1] < 0 or candidate > best[end + 1]:
                best[end + 1], count[end + 1], open_end[end + 1] = candidate, count[start] + 1, False
        while place < n:
            if not single:
                self._unknown(word, place, best, count, open_end)
            place, single = place + 1, False
        return count[n]

    def _unknown(self, word: str, at: int, best: list, count: list, open_end: list) -> None:
        candidate = best[at] + self.unknown
        if count[at + 1] < 0 or candidate > best[at + 1]:
            pieces = len(word[at].encode("utf-8", "surrogatepass")) if self.fallback else int(not open_end[at])
            best[at + 1], count[at + 1], open_end[at + 1] = candidate, count[at] + pieces, True

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        seen, total = self.seen, 0
        if len(seen) > CACHE_WORDS:
            seen.clear()
        marked = MARK + text.replace(" ", MARK) if not text.startswith((" ", MARK)) else text.replace(" ", MARK)
        for part in marked.split(MARK)[1:]:
            found = seen.get(part)
            if found is None:
                found = seen[part] = self.word(MARK + part)
            total += found
        return total


def with_token_counts(docs: DataFrame, vocabulary: Unigram, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """The rows with the token count of their whole text."""
    docs = docs.drop(out)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], f"`{out}` long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for batch in batches:
            counts = np.fromiter((counter.text(t.as_py()) for t in batch.column(text)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts)], names=[*batch.schema.names, out])

    return mapped(docs, run, schema)
