"""Encoding, counting, sharding, toxicity and URL rules against plain forms."""

import hashlib
import random
import zlib

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from panelwright.llm import pieces_bpe, sharding, token_counts, toxicity, url_filter
from panelwright.llm.queries import PIECE_MODEL, PLACE_RULES, QUERIES

from .fixtures import empty, frame, texts


@pytest.fixture(scope="module")
def noise():
    rng = random.Random(11)
    return ["".join(rng.choice("abetinhos  ▁\n.é中\U0001F600") for _ in range(rng.randint(0, 60))) for _ in range(800)] + ["a" * 3000, "<s> </s>", "\x00 x"]


def test_codec_equals_sentencepiece(spark, noise):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    vocabulary = pieces_bpe.Vocabulary.load(PIECE_MODEL)
    rows = texts() + list(enumerate(noise, 1000))
    encoded = pieces_bpe.encode(frame(spark, rows), vocabulary)
    got = pieces_bpe.decode(encoded, vocabulary).select("text", "ids", "decoded", "token").collect()
    assert len(got) == len(rows)
    for row in got:
        want = model.encode(row["text"] or "", add_eos=True)
        assert row["ids"] == want
        assert row["decoded"] == model.decode(want)
        assert row["token"] == "clash"


def test_codec_decodes_any_ids(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    rng = random.Random(5)
    ids = [[rng.choice([rng.randrange(3, 300), rng.randrange(32000)]) for _ in range(rng.randint(0, 12))] for _ in range(400)] + [[], [2], [0, 5]]
    vocabulary = pieces_bpe.Vocabulary.load(PIECE_MODEL)
    decoder = pieces_bpe.Decoder(vocabulary)
    for x in ids:
        assert decoder.decode(x) == model.decode(x), x
    df = spark.createDataFrame([(x,) for x in ids] + [(None,)], "ids array<int>")
    assert {r["decoded"] for r in pieces_bpe.decode(df, vocabulary).where("ids is null").collect()} == {""}


def test_codec_merges_one_by_one_where_new_pairs_go_first():
    """Pieces whose merges feed a better pair: simultaneous merging alone would differ."""
    names = ["▁", "a", "b", "ab", "aba", "abab"]
    v = pieces_bpe.Vocabulary(names, [0.0, -9.0, -9.0, -5.0, -1.0, -7.0], ["piece"] * 6, 0)
    ids, offsets = pieces_bpe.Encoder(v).encode(["abab", "ababab"])

    def slow(word):
        parts = list(word)
        while True:
            best = None
            for i in range(len(parts) - 1):
                joined = parts[i] + parts[i + 1]
                if joined in names and (best is None or v.scores[names.index(joined)] > best[0]):
                    best = (v.scores[names.index(joined)], i)
            if best is None:
                return [names.index(p) for p in parts] + [0]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    for k, word in enumerate(["▁abab", "▁ababab"]):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == slow(word)


def test_codec_empty(spark):
    vocabulary = pieces_bpe.Vocabulary.load(PIECE_MODEL)
    assert pieces_bpe.decode(pieces_bpe.encode(empty(spark), vocabulary), vocabulary).count() == 0


@pytest.mark.parametrize("fallback", [True, False])
def test_token_counts_equal_tokenizer(spark, noise, fallback):
    whole = token_counts.ranked_unigram(PIECE_MODEL)
    vocabulary = token_counts.Unigram(whole.pieces, whole.unknown_id, fallback)
    tokenizer = Tokenizer(models.Unigram(list(vocabulary.pieces), unk_id=0, byte_fallback=fallback))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    rows = [r for r in texts() if r[0] != 72] + list(enumerate(noise, 1000))
    got = token_counts.with_token_counts(frame(spark, rows), vocabulary).select("text", "n_tokens").collect()
    assert len(got) == len(rows)
    for row in got:
        assert row["n_tokens"] == len(tokenizer.encode(row["text"] or "", add_special_tokens=False).ids), row["text"][:50]


def test_token_count_ties():
    """Equal scores: the first candidate, the longest last piece, stays."""
    pieces = (("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("▁a", -2.0), ("▁aa", -3.0))
    tokenizer = Tokenizer(models.Unigram(list(pieces), unk_id=0))
    counter = token_counts.Counter(token_counts.Unigram(pieces, 0, False))
    for word in ("▁", "▁a", "▁aa", "▁aaa", "▁aaaaa", "▁b", "▁abba"):
        assert counter.word(word) == len(tokenizer.encode(word).ids)


def test_sharding(spark):
    rows = texts()
    got = sharding.shard_by_bytes(frame(spark, rows), 4).collect()
    assert len(got) == len(rows)
    want = sorted((i if i is not None else -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"]) for r in got) == want
    for s in range(4):
        places = sorted(r["slot"] for r in got if r["shard"] == s)
        assert places == list(range(len(places)))
    many = spark.range(20000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', cast(10 + id % 90 as int))").alias("text"))
    load = [r["b"] for r in sharding.shard_by_bytes(many, 40).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(load) == 40 and max(load) / min(load) < 1.01
    assert sharding.shard_by_bytes(empty(spark), 4).count() == 0


def test_slot_map_versions(spark):
    rng = random.Random(1)
    weights = {s: (1, rng.randint(1, 1000)) for s in range(500)}
    first = sharding.assign(weights, 10, 500)
    grown = sharding.rebalance(first, weights, 11)
    assert grown.version == 2 and 0 < first.moved(grown) < 90
    assert all(b == 10 for a, b in zip(first.shard, grown.shard) if a != b)
    table = sharding.map_table(spark, [first, grown])
    assert sharding.load_map(table) == grown and sharding.load_map(table, 1) == first


def test_url_rules(spark):
    def plain(url):
        url = url or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
        fits = [(len(h + p), h + p, v) for h, p, v in PLACE_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, None)

    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x?y#z", "http://example.org", "http://example.org?/es/", "http://example.org/en/12", "http://notexample.org/en/1",
            "http://x.com/fr/a", "http://x.com/DE/a", "http://com/de/", "a://b://c/d", "http://x.net/cgi-bin/a", "http://x.net/a.zip", "http://é.org/É", "http://example.org/en/1"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(0, None, "x")], "page_id long, url string, host string")
    rules = [url_filter.place_rule(*r) for r in PLACE_RULES] + list(url_filter.METHOD_RULES)
    got = url_filter.judge_urls(df, rules).collect()
    assert len(got) == len(urls) + 1
    for row in got:
        host, path, rule, verdict = plain(urls[row["page_id"]])
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule)
        assert row["verdict"] == (verdict or ("block" if row["method_rule"] else "allow"))
    blocked = {row["page_id"]: row["method_rule"] for row in got if row["method_rule"]}
    assert blocked == {13: "cgi", 14: "archive"}
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0


def test_toxicity_learns_and_keeps_labels_apart(spark):
    sf = "/root/testdata/sf0.01"
    rng = random.Random(2)
    plain = [" ".join(rng.choice(["the", "onan", "retion", "inthe", "and", "shon", "eaha"]) + rng.choice(["", "er", "ing"]) for _ in range(60)) for _ in range(300)]
    rows = [(i, t if i % 3 else t.replace(" and ", " vexgrub ", 2)) for i, t in enumerate(plain)] + [(900, None), (901, ""), (902, "vexgrub " * 30)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (5000, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, usable=toxicity.fold(F.col("doc_id")) != 0)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0 and " vexgrub " in dict(rows)[i] or i % 3]
    right = sum(got[i]["predicted"] == int("vexgrub" in dict(rows)[i]) for i in held)
    assert right >= 0.9 * len(held)
    assert got[900]["score"] == got[901]["score"] == min(r["score"] for r in got.values())
    # Without labels of both kinds nothing is rejected.
    assert toxicity.fit(docs, labels.where("toxic = 1"), usable=F.lit(True)) is None
    assert toxicity.score(docs, None).where("predicted = 1").count() == 0
    assert toxicity.score(empty(spark), model).count() == 0
    assert sf


def test_query_columns(spark):
    df = QUERIES["op4_sentencepiece_codec"](spark, "/root/testdata/sf0.001")
    assert df.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in df.collect():
        ids = model.encode(docs[r["doc_id"]] or "", add_eos=True)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(model.decode(ids).encode()).hexdigest()


def test_codec_in_one_pass_equals_two(spark, monkeypatch):
    """Also with a memory of few characters, and with columns that clash."""
    monkeypatch.setattr(pieces_bpe, "CACHE_CHARACTERS", 50)
    vocabulary = pieces_bpe.Vocabulary.load(PIECE_MODEL)
    docs = frame(spark, texts()).withColumn("ids", F.lit("clash"))
    one = pieces_bpe.encode_decode(docs, vocabulary)
    two = pieces_bpe.decode(pieces_bpe.encode(docs, vocabulary), vocabulary).drop("text")
    assert one.columns == two.columns
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["ids"])
    assert sorted(one.collect(), key=key) == sorted(two.collect(), key=key)
    assert pieces_bpe.encode_decode(empty(spark), vocabulary).collect() == []
