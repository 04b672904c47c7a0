"""Top-k search, conversation trie and source divergence against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import divergence, impact, prefix_trie

LONG = 2**63 - 1


# -- op13 ---------------------------------------------------------------------------------------------


def best(rows, asks, k):
    """(query_id, rank, vec_id, score) by whole products of all pairs."""
    usable = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ints = [[int(x) * 1024 if abs(x) >= 2**53 else math.floor(1024 * x) for x in v] for _, v in usable]
    out = []
    for a, (i, _) in enumerate(usable):
        if i is None or not asks(i):
            continue
        found = []
        for b, (j, _) in enumerate(usable):
            if a != b:
                score = min(max(sum(x * y for x, y in zip(ints[a], ints[b])), -LONG - 1), LONG)  # noqa: B905
                found.append((-score, j is None, j or 0, j))
        for rank, (score, _, _, j) in enumerate(sorted(found, key=lambda x: x[:3])[:k]):
            out.append((i, rank + 1, j, -score))
    return out


def vectors(spark, rows, parts=4):
    data = [(i, v, "clash", 7, True) for i, v in rows]
    return spark.createDataFrame(data, "vec_id long, embedding array<double>, blob string, row long, asks boolean").repartition(parts)


def order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v or 0) for v in r))


def test_top_k_equals_all_pairs(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(24)]) for i in range(700)]
    rows += [(1000 + i, list(rows[5][1])) for i in range(40)]  # ties
    rows += [(100, list(rows[3][1])), (None, list(rows[0][1])), (None, None), (2000, None)]  # repeated id, no id, no vector
    rows += [(2100, [0.1, None]), (2200, [float("nan")] * 24), (2300, [float("inf")] * 24), (2400, []), (2500, [0.0] * 24)]
    rows += [(2600, [0.3] * 5), (2700, [-0.1] * 60)]  # shorter and longer
    got = impact.top_k(vectors(spark, rows), F.col("vec_id") % 100 == 0, k=10)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert order(map(tuple, got.collect())) == order(best(rows, lambda i: i % 100 == 0, 10))


def test_top_k_of_huge_components(spark):
    rows = [(0, [1e30, -2.0]), (1, [1e30, 1.0]), (2, [-1e12, 0.5]), (3, [2000.5, 3.0]), (4, [1e-30, -1e-30]), (5, [5e5, 5e5]), (6, [1.7e308, 0.0])]
    got = impact.top_k(vectors(spark, rows, 1), F.col("vec_id") >= 0, k=3)
    assert order(map(tuple, got.collect())) == order(best(rows, lambda i: True, 3))


def test_top_k_of_few_and_no_rows(spark):
    rows = [(0, [1.0]), (100, [0.5])]
    assert order(map(tuple, impact.top_k(vectors(spark, rows), F.col("vec_id") % 100 == 0).collect())) == order(best(rows, lambda i: True, 10))
    assert impact.top_k(vectors(spark, []), F.col("vec_id") % 100 == 0).collect() == []


def test_reading_stops_before_the_end():
    """Bounds that prove a stop leave few rows to rescore, and the best are always among them."""
    rng = np.random.default_rng(1)
    x = np.floor(1024 * rng.normal(0, 0.1, (2000, 32)) * np.geomspace(4, 0.05, 32)).astype(np.int32)
    block = impact._Block({"id": np.arange(2000), "has": np.ones(2000, bool), "row": np.arange(2000), "shape": np.array(x.shape), "x": x.ravel(), **impact._postings(x)})
    query = x[7].astype(np.int64)
    rows = block.possible(query, np.array([7]), 10, None)
    scores = x.astype(np.int64) @ query
    scores[7] = -(2**62)
    assert len(rows) <= 2000 * impact.RESCORED_SHARE and set(np.argsort(-scores)[:10]) <= set(rows)
    tenth = int(np.sort(scores)[-10])
    assert set(np.flatnonzero(scores >= tenth)) <= set(block.possible(query, np.array([7]), 10, tenth))


# -- op11 ---------------------------------------------------------------------------------------------


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), (role or "", text or "")))
    for c in own:
        own[c] = [k for _, k in sorted(own[c], key=lambda z: z[0])]
    members, ends = defaultdict(list), defaultdict(list)
    for c in list(own):
        h = zlib.crc32(str(c).encode()) % 6
        path = (own.get(c - int(math.fmod(c, 100)), []))[:h] + own[c][h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in kids[p]) or 1
        saved[p] = sum(saved[q] for q in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    return [
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    ]


def conversation_rows():
    rng = random.Random(5)
    rows = []
    texts = ["", "a", "bé", "中文 \U0001f600", "x" * 5000, "hello there"]
    for c in [*range(0, 30), *range(100, 160), 205, 310, 311, -3, -100, -150, 9_000_000_000_000]:
        for turn in range(rng.randint(1, 7)):
            rows.append((c, turn if turn else rng.choice([0, None]), rng.choice(["user", "assistant"]), rng.choice(texts) if turn > 1 else texts[c % 2]))
    rows += [(400, None, None, None)]
    # A long conversation with a prefix and an extension of it, and equal rows.
    long = [("user" if i % 2 else "assistant", f"turn {i % 50}") for i in range(600)]
    for c, n in ((500, 600), (600, 300), (700, 600), (801, 3)):
        rows += [(c, i, *long[i]) for i in range(n)]
    rows += [(700, 601, "user", "more"), (701, 5, "user", "same"), (701, 5, "user", "same")]
    rows += [(None, 0, "user", "nobody"), (None, None, None, None)]
    # Copies of one conversation.
    rows += [(1000 + i, t, "user", f"copy {t}") for i in range(0, 200) for t in range(7, 9)]
    return rows


def conversations(spark, rows, parts=5):
    schema = "conv_id long, turn long, role string, text string, p1 long, depth string, n long"
    return spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], schema).repartition(parts)


@pytest.mark.parametrize("shard_size, queue", [(256, 500_000), (2, 1)])
def test_trie_equals_plain_python(spark, monkeypatch, shard_size, queue):
    monkeypatch.setattr(prefix_trie, "QUEUE_MESSAGES", queue)
    rows = conversation_rows()
    got = prefix_trie.trie(conversations(spark, rows), shard_size)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    key = lambda r: tuple((v is None, v or 0) if not isinstance(v, str) else v for v in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_trie(rows), key=key)


def test_trie_of_no_rows(spark):
    assert prefix_trie.trie(conversations(spark, [])).collect() == []


def test_queue_keeps_what_it_spills():
    queue = prefix_trie.LevelQueue(3)
    rng = np.random.default_rng(2)
    pushed = defaultdict(list)
    for _ in range(20):
        level = rng.integers(0, 6, 5)
        message = rng.integers(0, 100, (5, 7))
        queue.push(level, message)
        for at, m in zip(level, message, strict=True):
            pushed[int(at)].append(tuple(m))
    assert queue.file is not None
    for at in range(5, -1, -1):
        assert sorted(map(tuple, queue.pop(at))) == sorted(pushed[at])
    assert queue.pop(3) is None


# -- op12 ---------------------------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute_divergence(rows, top=200):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = [low(w) for w in TERM.findall(text or "")]
        counts[(lang or "", source or "")].update(words)
        docs[lang or ""].update(set(words))
    kept = {lang: [t for t, n in found.items() if n >= 3] for lang, found in docs.items()}

    def shares(found, lang):
        terms = kept[lang]
        total = sum(found[t] for t in terms)
        return {t: 1 + 10**9 * (found[t] + 1) // (total + len(terms)) for t in terms}

    p = {g: shares(c, g[0]) for g, c in counts.items()}
    q = {lang: shares(sum((c for g, c in counts.items() if g[0] == lang), Counter()), lang) for lang in kept}
    f = lambda a, b: (a - b) ** 2 // b
    out = []
    for lang, source in p:
        mine = p[(lang, source)]
        pairs = [(s, sum(f(mine[t], theirs[t]) for t in kept[lang])) for (k, s), theirs in p.items() if k == lang and s != source]
        terms = [(t, f(mine[t], q[lang][t])) for t in kept[lang] if counts[(lang, source)][t] > 0 and mine[t] > q[lang][t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return out


def source_rows():
    rng = random.Random(11)
    words = ["The", "the", "Été", "été", "naïve", "x1y", "a-b", "中文", "ß", "end."] + ["".join(rng.choices("abcde", k=rng.randint(1, 3))) for _ in range(80)]
    rows = []
    for i in range(260):
        source = rng.choice(["src0"] * 5 + ["src1", "src2", "É", None, ""])
        rows.append((" ".join(rng.choices(words, k=rng.randint(0, 40))), rng.choice(["en", "en", "fr", None]), source))
    rows += [(None, "en", "only nulls"), ("", "xx", "a"), ("rare words here", "xx", "b"), ("one two", "yy", "alone"), (rows[0][0], rows[0][1], rows[0][2])]
    rows += [("z" * 60_000 + " the " * 5000, "en", "long")] * 3
    return rows


@pytest.mark.parametrize("broadcast, held", [(50_000, 400_000), (0, 20)])
def test_divergence_equals_plain_python(spark, monkeypatch, broadcast, held):
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", broadcast)
    monkeypatch.setattr(divergence, "HELD_TERMS", held)
    rows = source_rows()
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "text string, lang string, source string, term string, rank int").repartition(4)
    got = divergence.divergence(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == sorted(brute_divergence(rows))


def test_divergence_of_no_rows(spark):
    assert divergence.divergence(spark.createDataFrame([], "text string, lang string, source string")).collect() == []
