"""Small document frames and plain-Python forms of the contracts."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, token string, bucket long"


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text: str | None) -> frozenset:
    words = WORD.findall(lower(text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < 5 else frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def texts() -> list[tuple[int | None, str | None]]:
    """Copies, near copies, shared passages, self-repeats, empty, null, short and very long texts."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice(["an", "the", "re", "ción", "ü", "ti", "on", "x"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = prose(70)
    base = prose(150)
    rows: list[tuple[int | None, str | None]] = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "ONE"), (5, "two three four"), (6, base), (7, base), (8, base.upper())]
    words = base.split(" ")
    for i in range(9, 40):  # near copies
        changed = list(words)
        changed[rng.randrange(150)] = "edit"
        rows.append((i, " ".join(changed)))
    for i in range(40, 70):  # one passage in many texts
        rows.append((i, prose(40) + "\n" + passage + "  " + prose(30)))
    rows.append((70, "ab" * 400))  # repeats inside itself
    rows.append((71, prose(9000)))
    rows.append((72, "z" * 50_000))
    rows.append((73, passage + " " + passage))
    rows.append((74, "é" * 150 + "中文 \U0001F600 " + "é" * 150))
    rows += [(i, prose(rng.randint(5, 120))) for i in range(75, 100)]
    rows += [(99, rows[-1][1]), (None, base), (None, "only here and nowhere else at all")]
    return rows


def frame(spark, rows, parts: int = 5):
    """A documents frame with extra columns whose names clash with those that operators use."""
    data = [(i, t, "en", "src0", len(t or ""), "clash", 3) for i, t in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
