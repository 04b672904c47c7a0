"""One registered query per operator, over its whole table, and its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, iblt, impact, ngram_join, pieces_bpe, prefix_trie, sharding, substring, suffix_dedup, token_counts, toxicity, url_filter

#: Folder of the public tokenizers' files; the path of a file is a parameter of its operator.
TOKENIZERS = "/opt/tokenizers"
PIECE_MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


@query("op2_sharding")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )


#: The rules of the contract: (host, path, verdict).
PLACE_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def _op5_sql() -> str:
    text = lambda s: "'" + s.replace("'", "''") + "'"
    places = ", ".join(f"({text(h)}, {text(p)}, {text(v)})" for h, p, v in PLACE_RULES)
    methods = ", ".join(f"({text(r.name)}, {text(r.verdict)}, {text(r.pattern)}, {r.length})" for r in url_filter.METHOD_RULES)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH rules(rh, rp, v) AS (VALUES {places}), patterns(name, v, p, n) AS (VALUES {methods}),
u AS (SELECT DISTINCT coalesce(url, '') AS url FROM pages),
r AS (SELECT url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM u),
h AS (SELECT url, {lower.format("regexp_extract(rest, '^[^/?#]*', 0)")} AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
fit AS (SELECT url, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS verdict
        FROM h, rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY url),
own AS (SELECT url, arg_min(name, (-n, name)) AS name, arg_min(v, (-n, name)) AS verdict
        FROM h, patterns WHERE regexp_matches(host || path, p) GROUP BY url)
SELECT page_id, host, path, rule, coalesce(fit.verdict, own.verdict, 'allow') AS verdict,
       CASE WHEN rule IS NULL THEN own.name END AS method_rule
FROM pages JOIN h ON coalesce(pages.url, '') = h.url LEFT JOIN fit ON h.url = fit.url LEFT JOIN own ON h.url = own.url"""


@query("op5_url_filter", _op5_sql())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filter.place_rule(*r) for r in PLACE_RULES] + list(url_filter.METHOD_RULES)
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


@query("op8_document_fingerprints")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.compare_edits(table(spark, sf_dir, "documents"))


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.with_token_counts(docs, token_counts.ranked_unigram(PIECE_MODEL)).select("doc_id", "n_tokens")


def hex_digest(text: Column) -> Column:
    """Lowercase hex sha256 of a string column's UTF-8 bytes."""
    return F.sha2(F.encode(text, "UTF-8"), 256)


@query("op4_sentencepiece_codec")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = pieces_bpe.Vocabulary.load(PIECE_MODEL)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces_bpe.encode_decode(docs, vocabulary).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        hex_digest(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        hex_digest(F.col("decoded")).alias("decoded_sha256"),
    )


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = toxicity.fold(F.col("doc_id"))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), usable=fold != 0)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", "predicted")


@query("op10_benchmark_decontamination")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_ngram_jaccard_join")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_substring_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), k=13)
    return kept.select("doc_id", "n_words", "n_removed", hex_digest(F.col("kept_text")).alias("kept_sha256"))


@query("op9_suffix_array_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), k=200)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


_OP13_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


@query("op13_exact_top_k_search", _OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


_OP12_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM d),
kept AS (SELECT lang, t, count(*) AS total FROM w GROUP BY lang, t HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, t, count(*) AS n FROM w SEMI JOIN kept USING (lang, t) GROUP BY lang, source, t),
l AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT lang, source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT kept.lang, gn.source, kept.t, coalesce(c.n, 0) AS n,
             1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1) // (gn.n + l.v) AS p,
             1 + CAST(1000000000 AS HUGEINT) * (kept.total + 1) // (l.n + l.v) AS q
      FROM kept JOIN l USING (lang) JOIN gn USING (lang) LEFT JOIN c ON c.lang = kept.lang AND c.source = gn.source AND c.t = kept.t),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
          UNION ALL SELECT lang, source, 'term', t, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
                  CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM parts)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200"""


@query("op12_source_divergence", _OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


_OP11_SQL = """
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n
           FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT c, CAST(c AS VARCHAR) AS s FROM t GROUP BY c),
h AS (SELECT c, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(substr(s, i, 1)) AS BIGINT))),
             lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 6 AS h FROM s),
m AS (SELECT h.c, 0 AS k, n, role, text FROM h JOIN t ON t.c = h.c - h.c % 100 AND n <= h
      UNION ALL SELECT c, 1, n, role, text FROM t JOIN h USING (c) WHERE n > h),
d AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY k, n) AS d, role, text FROM m),
k AS (SELECT c, d, length(text) AS chars, sha256(CAST(to_json(list({'r': role, 't': text}) OVER (PARTITION BY c ORDER BY d)) AS VARCHAR)) AS node FROM d),
x AS (SELECT c, d, chars, node, lag(node, 1, '') OVER (PARTITION BY c ORDER BY d) AS parent FROM k UNION ALL SELECT c, 0, 0, '', NULL FROM h),
nodes AS (SELECT node, d, min(parent) AS parent, min(c) AS c, count(*) AS n, min(chars) AS chars FROM x GROUP BY node, d),
kids AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
totals AS (SELECT a.node, a.d, count(*) FILTER (kids.n IS NULL) AS leaves, sum((y.n - 1) * y.chars) AS saved
           FROM nodes y JOIN x a ON a.c = y.c AND a.d <= y.d LEFT JOIN kids ON kids.node = y.node GROUP BY a.node, a.d),
e AS (SELECT node, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS e FROM (SELECT c, arg_max(node, d) AS node FROM x GROUP BY c) GROUP BY node)
SELECT nodes.c AS conv_id, nodes.d AS depth, up.c AS parent_conv_id, nodes.n AS n_convs, coalesce(kids.n, 0) AS n_children, leaves AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, coalesce(e, sha256('')) AS ends_sha256
FROM nodes JOIN totals USING (node, d) LEFT JOIN nodes up ON nodes.parent = up.node LEFT JOIN kids ON kids.node = nodes.node LEFT JOIN e ON e.node = nodes.node"""


@query("op11_conversation_prefix_trie", _OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))
