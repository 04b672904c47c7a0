"""Duplicate, containment and fingerprint operators against brute force, and the pipeline."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from panelwright.llm import decontaminate, iblt, lyndon, ngram_join, substring, suffix_dedup
from panelwright.llm.lyndon import suffix_arrays

from .fixtures import WORD, empty, frame, shingles, texts


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", max_size=30) | st.text("abcd", max_size=12), max_size=8))
def test_suffix_arrays(strings):
    data = [s.encode() for s in strings]
    text = np.frombuffer(b"".join(data), np.uint8).astype(np.int64)
    edges = np.concatenate([[0], np.cumsum([len(s) for s in data])]).astype(np.int64)
    want = [o + i for s, o in zip(data, edges) for i in sorted(range(len(s)), key=lambda i: s[i:])]
    for few in (0, 3, 300):  # emission one by one, mixed, and by standing suffixes
        lyndon.FEW = few
        assert suffix_arrays(text, edges).tolist() == want


def no_id_last(i):
    return (1 << 63) - 1 if i is None else i


def kept_words(rows, k):
    first: dict = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for p in range(len(w) - k + 1):
            key = tuple(w[p : p + k])
            first[key] = min(first.get(key, no_id_last(i)), no_id_last(i))
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for p in range(len(w) - k + 1):
            if first[tuple(w[p : p + k])] < no_id_last(i):
                gone.update(range(p, p + k))
        out.append((no_id_last(i), len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out)


@pytest.mark.parametrize("k", [13, 5])
def test_substring_dedup(spark, k):
    rows = texts()
    got = substring.without_repeats(frame(spark, rows), k).collect()
    assert sorted((no_id_last(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == kept_words(rows, k)
    assert {r["token"] for r in got} == {"clash"}


def test_substring_confirms_equal_hashes(monkeypatch):
    """Where all window hashes are equal, the bytes alone decide."""
    words = "a b c d e f a b c x y z d e f".split()
    clean = np.frombuffer((" ".join(words) + " ").encode(), np.uint8)
    ends = np.flatnonzero(clean == 0x20)
    starts = np.concatenate([[0], ends[:-1] + 1])
    first, group = substring.window_places(np.array([6, 9]), 3)
    flags = substring.repeated(clean, starts, ends, first, group, group.copy(), np.zeros(len(first), np.uint64), 3)
    assert flags.tolist() == [False] * 4 + [True] + [False] * 5 + [True]


def kept_bytes(rows, k):
    seen: Counter = Counter()
    data = [(no_id_last(i), (t or "").encode()) for i, t in rows]
    for _, b in data:
        seen.update(b[p : p + k] for p in range(len(b) - k + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - k + 1):
            if seen[b[p : p + k]] > 1:
                gone[p : p + k] = b"\1" * k
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(b), sum(gone), runs, bytes(c for c, g in zip(b, gone) if not g)))
    return sorted(out)


@pytest.mark.parametrize("k", [200, 40])
def test_suffix_dedup(spark, k):
    rows = texts()
    got = suffix_dedup.without_repeats(frame(spark, rows), k).collect()
    assert sorted((no_id_last(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == kept_bytes(rows, k)
    for r in got:
        assert bytes(r["kept_text"], "utf-8") == bytes(r["kept"]) or "é" in r["text"] or "ü" in r["text"] or "ó" in r["text"]


def test_suffix_dedup_splits_hot_anchors(spark, monkeypatch):
    """A second anchor parts the strings of a common one without changing the result."""
    rows = [r for r in texts() if r[0] is not None and r[0] < 72]
    docs = frame(spark, rows)
    plain = suffix_dedup.repeated_anchors

    def all_hot(df, total, k):
        table, _ = plain(df, total, k)
        values = [suffix_dedup.Strings(__import__("pyarrow").array([t for _, t in rows]), k).anchor]
        return table, np.unique(np.concatenate(values))

    monkeypatch.setattr(suffix_dedup, "repeated_anchors", all_hot)
    got = suffix_dedup.without_repeats(docs, 100).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == kept_bytes(rows, 100)


def test_suffix_dedup_sends_bytes_only_where_strings_differ(spark, monkeypatch):
    """Copies in different tasks travel as hashes; a near copy and a text that repeats inside itself as bytes."""
    import pyarrow as pa

    rng = random.Random(6)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    copied, near, inside, alone = prose(300), prose(120), prose(60), prose(300)
    rows = [(i, copied) for i in range(6)] + [(10, near), (11, near.replace(near[400:410], "#" * 10)), (20, inside + " " + inside), (30, alone)]
    docs = frame(spark, rows, 10)
    tables, hot = suffix_dedup.repeated_anchors(docs, sum(len(t) for _, t in rows), 200)

    def bytes_sent(i, text):
        part = pa.RecordBatch.from_pydict({"doc_id": pa.array([i], pa.int64()), "text": [text], "_key": pa.array([1], pa.int64())})
        found = suffix_dedup._strings(part, 200, tables, hot)
        return len(found[0]["data"]) if found else 0

    assert bytes_sent(0, copied) == 0 and bytes_sent(30, alone) == 0
    assert bytes_sent(10, near) and bytes_sent(11, rows[7][1]) and bytes_sent(20, rows[8][1])
    for held in (suffix_dedup.HELD_ANCHORS, 1):
        monkeypatch.setattr(suffix_dedup, "HELD_ANCHORS", held)
        got = suffix_dedup.without_repeats(docs).collect()
        assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == kept_bytes(rows, 200)


def test_joined_spans():
    """Ranges of one text that meet are one; those of other texts and keys stay apart."""
    spans = [(1, 5, 0, 10), (1, 5, 10, 20), (1, 5, 30, 40), (1, 5, 32, 34), (1, 6, 5, 15), (2, 5, 8, 9), (1, 5, 39, 50)]
    got = suffix_dedup._joined(*(np.array(x, np.int64) for x in zip(*spans)))
    assert list(zip(*(x.tolist() for x in got))) == [(1, 5, 0, 20), (1, 5, 30, 50), (1, 6, 5, 15), (2, 5, 8, 9)]
    assert all(len(x) == 0 for x in suffix_dedup._joined(*[np.zeros(0, np.int64)] * 4))


def linked_components(rows, percent=80):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(x)] = root(y)
    members: dict = {}
    for x in range(len(sets)):
        members.setdefault(root(x), []).append(sets[x][0])
    out = []
    for x in range(len(sets)):
        ids = [i for i in members[root(x)] if i is not None]
        out.append((no_id_last(sets[x][0]), len(sets[x][1]), min(ids) if ids and sets[x][1] else (sets[x][0] if sets[x][0] is not None else -1)))
    return sorted(out)


@pytest.mark.parametrize("percent", [80, 50])
def test_jaccard_join(spark, percent):
    rows = texts()
    got = ngram_join.near_duplicates(frame(spark, rows), percent).collect()
    found = sorted((no_id_last(r["doc_id"]), r["n_shingles"], r["component_id"] if r["component_id"] is not None else -1) for r in got)
    assert found == linked_components(rows, percent)


def test_jaccard_threshold_is_exact(spark):
    """Overlaps of exactly 80 percent link, a hair below does not."""
    words = [f"w{i}" for i in range(200)]
    a = " ".join(words[:94])  # 90 shingles
    b = " ".join(words[:84] + [f"v{i}" for i in range(10)])  # shares 80 of 100
    c = " ".join(words[100:194])
    d = " ".join(words[100:183] + [f"u{i}" for i in range(11)])  # shares 79 of 101
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(frame(spark, [(1, a), (2, b), (3, c), (4, d)])).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


@pytest.mark.parametrize("percent", [80, 50])
def test_sketches_lose_no_link(spark, percent):
    """Sketches never differ in more bits than the sets in members, and leave few pairs that are no links."""
    rng = np.random.default_rng(5)
    sets, pairs = [], []
    for n in (1, 2, 3, 9, 40, 250, 256, 257, 3000):
        for kept in (0, 30, 60, 80, 89, 90, 95, 100):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            more = rng.integers(0, 1 << 63, n - n * kept // 100 + int(rng.integers(0, 1 + n // 8)), dtype=np.uint64)
            b = np.unique(np.concatenate([a[: n * kept // 100], more]))
            if len(b):
                assert ngram_join.bits_apart(ngram_join.sketch_of(a), ngram_join.sketch_of(b)) <= len(np.setxor1d(a, b))
                pairs.append((len(sets), len(sets) + 1, len(a), len(b)))
                sets += [a, b]
    reps = spark.createDataFrame([(i, ngram_join.sketch_of(s)) for i, s in enumerate(sets)], "node long, sketch binary")
    kept = {(r["a"], r["b"]) for r in ngram_join.likely(reps, spark.createDataFrame(pairs, "a long, b long, na long, nb long"), percent).collect()}
    shared = {(a, b): len(np.intersect1d(sets[a], sets[b])) for a, b, _, _ in pairs}
    links = {(a, b) for a, b, na, nb in pairs if 100 * shared[a, b] >= percent * (na + nb - shared[a, b])}
    far = {(a, b) for a, b, na, nb in pairs if na > 30 and 100 * shared[a, b] < (percent - 30) * (na + nb - shared[a, b])}
    assert links and links <= kept and far and not far & kept


def test_one_of_each(spark):
    rows = texts()
    kept = ngram_join.one_of_each(frame(spark, rows)).collect()
    ids = [r["doc_id"] for r in kept if r["doc_id"] is not None]
    want = {c for i, _, c in linked_components(rows) if i == c} | {i for i, n, _ in linked_components(rows) if n == 0}
    assert sorted(ids) == sorted(want)


def test_decontamination(spark):
    rng = random.Random(4)
    rows = texts()
    long = next(t for i, t in rows if i == 71)
    words = long.split(" ")
    items = [(i, " ".join(words[p : p + n])) for i, (p, n) in enumerate([(100, 30), (5000, 8), (8000, 5), (3000, 4), (10, 60)])]
    broken = words[200:240]
    broken[20] = "changed"
    items += [(20, " ".join(broken)), (21, None), (22, ""), (23, "one"), (24, " ".join(rng.sample(words, 30))), (0, items[0][1]), (None, items[1][1])]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, leaks string")
    want = []
    for d, t in rows:
        for i, q in items:
            a, b = shingles(q), shingles(t)
            if a and len(a & b) * 10 >= len(a) * 8:
                want.append((no_id_last(d), no_id_last(i), len(a), len(a & b)))
    for block in (16 << 20, 60):
        docs = decontaminate.with_leaks(frame(spark, rows), bench, block_bytes=block)
        got = [(no_id_last(r["doc_id"]), no_id_last(x["item_id"]), x["n_item"], x["n_shared"]) for r in docs.collect() for x in r["leaks"]]
        assert sorted(got) == sorted(want)
    assert decontaminate.contained_items(empty(spark), bench).count() == 0
    assert decontaminate.contained_items(frame(spark, rows), bench.limit(0)).count() == 0


def test_fingerprints(spark):
    rows = [r for r in texts() if r[0] is not None and r[0] not in (71, 99)]
    rng = random.Random(9)
    rows += [(200 + i, "\n".join(f"line {rng.randrange(400)}" for _ in range(n))) for i, n in enumerate([1, 3, 30, 200, 400, 60])]
    got = {r["doc_id"]: r for r in iblt.compare_edits(frame(spark, rows)).collect()}
    data = {i: t or "" for i, t in rows}
    ids = sorted(data, reverse=True)
    pieces = lambda t: {p for p in re.split(r"\n+|(?<=[.!?])\s+(?=[A-M])", t) if p}
    like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    prints: dict = {}
    for n, i in enumerate(ids):
        text, follows = data[i], data[ids[(n + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + follows[:half]
        row = got[i]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert row["near_edited"] == pytest.approx(like(pieces(text), pieces(edited)))
        assert row["near_next"] == pytest.approx(like(pieces(text), pieces(follows)))
        prints.setdefault(text, set()).add(row["fingerprint"])
        prints.setdefault(edited, set()).add(row["edited_fingerprint"])
    assert all(len(p) == 1 for p in prints.values())


def test_fingerprint_edges(spark):
    assert iblt.compare_edits(empty(spark)).count() == 0
    alone = iblt.compare_edits(frame(spark, [(5, "a\nb")])).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0
    rows = [(None, "x"), (None, "y"), (None, "x"), (3, "p\nq"), (3, "p\nq")]
    assert iblt.compare_edits(frame(spark, rows)).count() == 5


@pytest.mark.parametrize("operator", [lambda d: substring.without_repeats(d), lambda d: suffix_dedup.without_repeats(d), lambda d: ngram_join.near_duplicates(d), lambda d: ngram_join.one_of_each(d)])
def test_empty_tables(spark, operator):
    assert operator(empty(spark)).count() == 0
    assert operator(frame(spark, [(1, None), (2, "")])).count() == 2


def test_pipeline_stages(spark):
    """Each stage does its whole job on what the stage before kept."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    bench = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        after = stage(spark, docs, sf)
        rows = after.collect()
        if name != "sentencepiece":
            assert after.columns == columns
            kept = {r["doc_id"]: r["text"] for r in rows}
            assert len(kept) == len(rows) and set(kept) <= set(before)
        if name == "ngram_jaccard_join":
            assert set(kept) == {c for i, n, c in linked_components(list(before.items()))}
        if name == "suffix_array_dedup":
            want = {i: b for i, _, _, _, b in kept_bytes(list(before.items()), 200)}
            assert set(kept) == set(before)
            assert all(t == before[i] or len(t.encode()) - len(want[i]) < 4 * before[i].count("\n") + 40 for i, t in kept.items())
        if name == "benchmark_decontamination":
            leaks = {i for i, t in before.items() if any((a := shingles(q)) and 10 * len(a & shingles(t)) >= 8 * len(a) for q in bench)}
            assert set(kept) == set(before) - leaks
        if name == "sentencepiece":
            assert {r["doc_id"] for r in rows} == set(before)
            assert all(r["decoded"] == (before[r["doc_id"]] or "") for r in rows)
        docs = spark.createDataFrame(rows, after.schema)


def test_components_of_chains_and_stars(spark):
    from panelwright.llm.store import components

    rng = random.Random(8)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 530)]
    odd = [(rng.randrange(1000, 1060), rng.randrange(1000, 1060)) for _ in range(40)]
    links = chain + star + odd + chain[:5]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    least = {x: x for pair in links if pair[0] != pair[1] for x in pair}
    for _ in range(200):
        for a, b in links:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert got == least
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents_without_id_link_others(spark):
    """A - X - C, where X has no doc_id: both links count; twice the same row doesn't make a link."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    a, x, c = words[:104], words[8:112], words[16:120]
    far = words[:60] + [f"v{i}" for i in range(60)]
    rows = [(1, " ".join(a)), (None, " ".join(x)), (5, " ".join(c)), (None, " ".join(x))]
    sets = [shingles(t) for _, t in rows]
    assert len(sets[0] & sets[1]) * 100 >= 80 * len(sets[0] | sets[1]) and len(sets[0] & sets[2]) * 100 < 80 * len(sets[0] | sets[2])
    repeated = [(7, " ".join(far)), (7, " ".join(far)), (7, " ".join(far)), (9, " ".join(far[:60] + words[60:]))]
    assert len(shingles(repeated[0][1]) & shingles(repeated[3][1])) * 100 < 80 * len(shingles(repeated[0][1]) | shingles(repeated[3][1]))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"]) for r in ngram_join.near_duplicates(frame(spark, rows + repeated)).collect())
    assert got[:3] == [(False, 1, 1), (False, 5, 1), (False, 7, 7)] and got[-2:] == [(True, 0, 1), (True, 0, 1)]
    assert [g for g in got if g[1] == 9] == [(False, 9, 1)] or [g for g in got if g[1] == 9] == [(False, 9, 9)]
