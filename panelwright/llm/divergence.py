"""Term divergence between the sources of a language, in exact whole numbers.

Every source gives every kept term a share p = 1 + floor(10^9 (count + 1) / (N + V)); the divergence
of p from another share q is floor((p - q)^2 / q). A pair of sources sums it over all V terms of the
language, of which most have no count in either. So the sum is

    V f(p0, q0) + sum over the one's terms of [f(p, q0) - f(p0, q0)]
                + sum over the other's terms of [f(p0, q) - f(p0, q0)] + corrections of shared terms

with p0, q0 the shares of a count of 0. The corrections come from a frequent-pattern tree: a term is
the row of its nonzero shares in one order of the sources, commonest first; equal rows are one row
with a multiplicity; rows that begin alike share a path. A node's weight is the number of terms
below it, and each node meets each of its ancestors once, whatever that number.

Distribution: texts are counted per (language, source) inside a task and leave it as partial counts;
distinct rows are sorted by range, so a task holds a contiguous part of the tree and builds it a
batch at a time. A path cut between tasks or batches is counted in parts and the parts are summed.

Defined cases: null text, lang and source are ''; a group without terms still has its shares; a
language without kept terms gives 0 for every pair and no term rows; equal texts count each; other
columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keyed import attach_by_key
from .deploy import mapped
from .store import stored

#: Shares are parts of this whole.
WHOLE = 1_000_000_000
#: Entries that a task counts before it hands them on.
HELD_TERMS = 200_000
#: Groups up to which their table is broadcast (some 60 bytes each).
BROADCAST_GROUPS = 50_000
#: Node-ancestor pairs worked on at once.
_PAIRS = 1 << 20
_SALTS = 32

#: Letters A-Z in lower case, a-z and all bytes of other characters stay; everything else ends a term.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to (lang, source, term, n, docs)."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (times, docs) in held.items():
            n = len(times)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.repeat(pa.scalar(lang, pa.string()), n), pa.repeat(pa.scalar(source, pa.string()), n), pa.array(list(times), pa.binary()),
                    pa.array(np.fromiter(times.values(), np.int64, n)), pa.array(np.fromiter(map(docs.__getitem__, times), np.int64, n)),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )
        held.clear()

    entries = 0
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True):
            times, docs = held.setdefault((lang, source), (Counter(), Counter()))
            words = text.as_py().translate(_TERM_BYTES).split()
            before = len(times)
            times.update(words)
            docs.update(set(words))
            entries += len(times) - before
            if entries >= HELD_TERMS:
                yield from out()
                entries = 0
    yield from out()


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (total + terms)) as long; null without terms."""
    wide = lambda c: c.cast("decimal(27,0)")
    above, below = wide(count + 1) * F.lit(WHOLE).cast("decimal(10,0)"), wide(total + terms)
    return F.when(terms > 0, F.lit(1).cast("long") + F.call_function("div", above, below))


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most 10^9 + 1, so the square is a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (lang, path, m) to corrections (lang, a, b, high, low) of the shares of a seen from b.

    The correction is high * 2^32 + low; the parts are summed apart, so no sum leaves the longs.
    """
    for batch in batches:
        langs, paths = batch.column("lang").to_pylist(), batch.column("path")
        lengths = paths.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        items = paths.flatten()
        rank, p, p0 = (items.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("rank", "p", "p0"))
        weight = np.append(0, np.cumsum(batch.column("m").to_numpy(zero_copy_only=False)))
        ends = np.cumsum(lengths)
        begins = ends - lengths
        n = len(langs)
        # New nodes of a row: all beyond what it shares with the row before.
        shared = np.zeros(n, np.int64)
        for i in range(1, n):
            if langs[i] == langs[i - 1]:
                most = min(lengths[i], lengths[i - 1])
                a, b = begins[i], begins[i - 1]
                odd = np.flatnonzero((rank[a : a + most] != rank[b : b + most]) | (p[a : a + most] != p[b : b + most]))
                shared[i] = odd[0] if len(odd) else most
        made = lengths - shared
        row = np.repeat(np.arange(n), made)
        depth = np.arange(made.sum()) - np.repeat(np.cumsum(made) - made, made) + np.repeat(shared, made)
        # A node lasts until the first later row that shares less than its depth + 1 with its predecessor.
        last = np.full(len(row), n, np.int64)
        open_nodes: list[int] = []
        first = np.cumsum(made) - made
        for i in range(n):
            while open_nodes and depth[open_nodes[-1]] >= shared[i]:
                last[open_nodes.pop()] = i
            open_nodes.extend(range(first[i], first[i] + made[i]))
        terms = weight[last] - weight[row]
        place = begins[row] + depth
        name = {lang: k for k, lang in enumerate(dict.fromkeys(langs))}
        names = list(name)
        code = np.array([name[lang] for lang in langs], np.int64)[row]
        ends_of = np.cumsum(depth)
        at = 0
        while at < len(row):
            to = max(at + 1, int(np.searchsorted(ends_of, (ends_of[at - 1] if at else 0) + _PAIRS, side="right")))
            d = depth[at:to]
            node = np.repeat(np.arange(at, to), d)
            up = np.arange(len(node)) - np.repeat(np.cumsum(d) - d, d)
            x, y, times = place[node], begins[row[node]] + up, terms[node]
            both = []
            for a, b in ((x, y), (y, x)):
                each = _f(p[a], p[b]) - _f(p[a], p0[b]) - _f(p0[a], p[b]) + _f(p0[a], p0[b])
                both.append((code[node], rank[a], rank[b], (each >> 32) * times, (each & 0xFFFFFFFF) * times))
            lang, a, b, high, low = (np.concatenate(c) for c in zip(*both, strict=True))
            at = to
            if not len(lang):
                continue
            order = np.lexsort((b, a, lang))
            lang, a, b, high, low = (c[order] for c in (lang, a, b, high, low))
            head = np.flatnonzero(np.append(True, (lang[1:] != lang[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([names[k] for k in lang[head]], pa.string()), pa.array(a[head], pa.int32()), pa.array(b[head], pa.int32()),
                    pa.array(np.add.reduceat(high, head), pa.int64()), pa.array(np.add.reduceat(low, head), pa.int64()),
                ],
                names=["lang", "a", "b", "high", "low"],
            )


def _within_lang(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join on lang, both sides spread over salts: a language may hold most rows."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(_SALTS)).cast("int"))
    return spread.join(right.withColumn("_salt", salts), ["lang", "_salt"]).drop("_salt")


def divergence(docs: DataFrame, least_docs: int = 3, top_terms: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) of every occurring (lang, source)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    slim = docs.select(blank("lang"), blank("source"), blank("text"))
    partial = mapped(slim, _count, "lang string, source string, term binary, n long, docs long")
    counted = partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = counted.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("counts")
    )
    kept = stored(kept.where(F.col("docs") >= least_docs).drop("docs"))

    flat = kept.select("lang", "term", "total", F.inline("counts"))
    sizes = flat.groupBy("lang", "source").agg(F.sum("n").alias("n_source"), F.count("*").alias("here"))
    langs = kept.groupBy("lang").agg(F.sum("total").alias("n_lang"), F.count("*").alias("terms"))
    groups = docs.select(blank("lang"), blank("source")).distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.fillna(0, ["n_source", "here", "n_lang", "terms"])
    commonest = Window.partitionBy("lang").orderBy(F.col("here").desc(), "source")
    groups = groups.withColumns({
        "rank": F.row_number().over(commonest), "p0": share(F.lit(0).cast("long"), F.col("n_source"), F.col("terms")),
    })
    groups = stored(groups)
    if groups.count() <= BROADCAST_GROUPS:
        known = flat.join(F.broadcast(groups), ["lang", "source"])
    else:
        known = attach_by_key(flat, groups, ["lang", "source"], "here")
    p = share(F.col("n"), F.col("n_source"), F.col("terms"))
    q = share(F.col("total"), F.col("n_lang"), F.col("terms"))
    items = known.select("lang", "source", "term", "rank", p.alias("p"), "p0", q.alias("q"))

    # Terms that a source uses more than its language.
    above = items.where("p > q").select("lang", "source", "term", apart(F.col("p"), F.col("q")).alias("value"))
    place = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "term")
    above = above.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top_terms)
    term_part = above.select("lang", "source", F.lit("term").alias("part"), F.decode("term", "UTF-8").alias("item"), "value", "rank")

    # Pairs: shares of one side only, from the sources' tables of shares ...
    big = lambda c: c.cast("decimal(19,0)")
    shares = items.groupBy("lang", F.col("rank").alias("a"), "p", F.col("p0").alias("p0_a")).agg(big(F.count("*")).alias("m"))
    others = groups.where("terms > 0").select("lang", F.col("rank").alias("b"), F.col("p0").alias("p0_b"))
    met = _within_lang(shares, others).where("a <> b")
    mine, theirs, here, there = F.col("p"), F.col("p0_b"), F.col("p0_a"), F.col("m")
    single = met.groupBy("lang", "a", "b").agg(
        F.sum(there * big(apart(mine, theirs) - apart(here, theirs))).alias("seen_from"),
        F.sum(there * big(apart(theirs, mine) - apart(theirs, here))).alias("seen_by"),
    )
    # ... and of terms that both have, from the tree.
    node = F.struct("rank", "p", "p0")
    rows = items.groupBy("lang", "term").agg(F.sort_array(F.collect_list(node)).alias("path"))
    rows = stored(rows.where(F.size("path") > 1).groupBy("lang", "path").agg(F.count("*").alias("m")))
    parts = mapped(
        rows.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path"), _tree, "lang string, a int, b int, high long, low long"
    )
    shared = parts.groupBy("lang", "a", "b").agg(
        (F.sum(big(F.col("high"))) * F.lit(1 << 32).cast("decimal(10,0)") + F.sum(big(F.col("low")))).alias("shared")
    )
    one = groups.select("lang", "source", F.col("rank").alias("a"), F.col("p0").alias("p0_a"), "terms")
    other = groups.select("lang", F.col("source").alias("item"), F.col("rank").alias("b"), F.col("p0").alias("p0_b"))
    pairs = _within_lang(one, other).where("a <> b")
    back = single.select("lang", F.col("a").alias("b"), F.col("b").alias("a"), "seen_by")
    pairs = pairs.join(single.drop("seen_by"), ["lang", "a", "b"], "left").join(back, ["lang", "a", "b"], "left").join(shared, ["lang", "a", "b"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("decimal(38,0)"))
    base = F.coalesce(big(F.col("terms")) * big(apart(F.col("p0_a"), F.col("p0_b"))), F.lit(0).cast("decimal(38,0)"))
    value = (base + zero("seen_from") + zero("seen_by") + zero("shared")).cast("long")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pair_part = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")).withColumn("rank", F.row_number().over(order))
    return pair_part.unionByName(term_part)
