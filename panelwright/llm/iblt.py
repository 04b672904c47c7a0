"""Document fingerprints: invertible Bloom lookup sketches over paragraph digests.

A text is a set of paragraphs (pieces between line breaks, cut further before sentences that begin
with certain letters, so that the cuts move with the text). Each distinct paragraph has a 64-bit
digest that proves itself: 40 bits of hash and 24 bits that check them. A sketch adds every digest by
exclusive or to three of its cells. Subtracting two sketches leaves the digests in which the texts
differ; a cell that proves itself holds one digest alone, and peeling such cells recovers them all.
Where a difference doesn't peel, the pair is tried again with a larger sketch: as many parts of the
stored size as the two sets ask for, digests dealt to parts by their check bits. A part that still
doesn't peel is tried with larger parts. So work grows with the number of digests, not with its
square.

Everything is Spark column functions. Updates copy cells with ``slice`` and ``concat`` instead of
running a lambda on every cell.

Defined cases: a null text is empty; an empty text has an empty sketch, and two empty texts are
fully alike; repeated paragraphs count once; rows of equal doc_id follow each other by text hash and
rows without doc_id come last; extra columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keyed import settle

#: Cells for each of the three places of a digest: stored fingerprint, and retries of a part.
PARTS = (12, 48, 192)
#: Digests of both sides that a part of a larger sketch is meant for.
PART_LOAD = 16
PARAGRAPH_END = r"\n+|(?<=[.!?])\s+(?=[A-M])"
_ROUNDS = 20
#: Rows of one ordering block, and the most blocks.
BLOCK_ROWS, MAX_BLOCKS, QUANTILES = 1024, 10_000, 64


def _checked(h: Column) -> Column:
    return F.shiftleft(h, 24).bitwiseOR(F.xxhash64(h).bitwiseAND(F.lit(0xFFFFFF)))


def digests(text: Column) -> Column:
    """Distinct digests of a text's paragraphs."""
    pieces = F.filter(F.split(text, PARAGRAPH_END), lambda p: p != "")
    return F.array_distinct(F.transform(pieces, lambda p: _checked(F.xxhash64(p).bitwiseAND(F.lit((1 << 40) - 1)))))


def _proves(cell: Column) -> Column:
    return (cell != 0) & (cell.bitwiseAND(F.lit(0xFFFFFF)) == F.xxhash64(F.shiftrightunsigned(cell, 24)).bitwiseAND(F.lit(0xFFFFFF)))


def _added(cells: Column, keys: Column, part: int) -> Column:
    """Cells with every key put in (or taken out: exclusive or does both) at its three places.

    The three places of a key lie in the three thirds of the cells, in order, so one copy of the
    cells takes all its changes.
    """
    place = lambda k, j: (F.shiftrightunsigned(k, 24 + 13 * j).bitwiseAND(F.lit(8191)) % part + j * part).cast("int")
    placed = F.transform(keys, lambda k: F.struct(place(k, 0).alias("a"), place(k, 1).alias("b"), place(k, 2).alias("c"), k.alias("k")))

    def step(acc: Column, x: Column) -> Column:
        new = lambda i: F.array(F.element_at(acc, i + 1).bitwiseXOR(x["k"]))
        return F.concat(
            F.slice(acc, F.lit(1), x["a"]), new(x["a"]), F.slice(acc, x["a"] + 2, x["b"] - x["a"] - 1), new(x["b"]),
            F.slice(acc, x["b"] + 2, x["c"] - x["b"] - 1), new(x["c"]), F.slice(acc, x["c"] + 2, F.lit(3 * part)),
        )

    return F.aggregate(placed, cells, step)


def sketch(keys: Column, part: int) -> Column:
    """Cells of a set of digests."""
    return _added(F.array_repeat(F.lit(0).cast("long"), 3 * part), keys, part)


def subtract(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: a.bitwiseXOR(b))


def peel(difference: Column, part: int) -> Column:
    """Struct (ok, found): whether all of it peeled, and the digests recovered."""
    none = F.expr("CAST(array() AS array<bigint>)")
    start = F.struct(difference.alias("cells"), F.lit(True).alias("more"), none.alias("found"))

    def rounds(acc: Column, _: Column) -> Column:
        pure = F.array_distinct(F.filter(acc["cells"], _proves))

        def remove(now: Column, keys: Column) -> Column:
            return F.struct(
                _added(now["cells"], keys, part).alias("cells"), (F.size(keys) > 0).alias("more"),
                F.concat(now["found"], keys).alias("found"),
            )

        # One-element array: binds the pure cells so that they are found once a round.
        return F.when(acc["more"], F.aggregate(F.array(pure), acc, remove)).otherwise(acc)

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(_ROUNDS)), start, rounds,
        lambda acc: F.struct((~F.exists(acc["cells"], lambda c: c != 0)).alias("ok"), acc["found"].alias("found")),
    )


def _sizes(peeled: Column, left_keys: Column) -> Column:
    """Numbers of recovered digests of the left and the right; null where the difference did not peel."""
    own = lambda p: F.size(F.array_intersect(p["found"], left_keys))
    return F.aggregate(
        F.array(peeled), F.lit(None).cast("struct<l:int,r:int>"),
        lambda _, p: F.when(p["ok"], F.struct(own(p).alias("l"), (F.size(p["found"]) - own(p)).alias("r"))),
    )


def _larger(left_keys: Column, right_keys: Column) -> Column:
    """Difference sizes by a sketch of several parts; each part is retried on its own."""
    parts = F.greatest(F.ceil((F.size(left_keys) + F.size(right_keys)) / PART_LOAD), F.lit(2)).cast("int")

    def part(j: Column) -> Column:
        own = lambda keys: F.filter(keys, lambda k: k.bitwiseAND(F.lit(0xFFFFFF)) % parts == j)
        pair = F.struct(own(left_keys).alias("a"), own(right_keys).alias("b"))

        def tried(_: Column, x: Column) -> Column:
            # By exclusive or, one sketch of both sides is the difference of two.
            sizes = [_sizes(peel(sketch(F.concat(x["a"], x["b"]), part), part), x["a"]) for part in PARTS]
            exact = F.struct(F.size(F.array_except(x["a"], x["b"])).alias("l"), F.size(F.array_except(x["b"], x["a"])).alias("r"))
            return F.coalesce(*sizes, exact)

        return F.aggregate(F.array(pair), F.lit(None).cast("struct<l:int,r:int>"), tried)

    return F.aggregate(
        F.transform(F.sequence(F.lit(0), parts - 1), part), F.expr("named_struct('l', 0, 'r', 0)"),
        lambda acc, x: F.struct((acc["l"] + x["l"]).alias("l"), (acc["r"] + x["r"]).alias("r")),
    )


def likeness(left_keys: Column, right_keys: Column, left: Column, right: Column) -> Column:
    """Jaccard likeness of two fingerprints: by their own cells, else by larger sketches of both sets.

    ``coalesce`` stops at the first try that peels. A difference of the set sizes that exceeds the
    cells passes over the first try.
    """
    n, m = F.size(left_keys), F.size(right_keys)
    own = F.when(F.abs(n - m) <= 3 * PARTS[0], _sizes(peel(subtract(left, right), PARTS[0]), left_keys))

    def ratio(_: Column, d: Column) -> Column:
        union = n + d["r"]
        return F.when(union == 0, F.lit(1.0)).otherwise((n - d["l"]) / union)

    return F.aggregate(F.array(F.coalesce(own, _larger(left_keys, right_keys))), F.lit(None).cast("double"), ratio)


def shown(keys: Column, cells: Column) -> Column:
    """Fingerprint text: number of digests, then every cell in hex."""
    return F.concat(F.size(keys).cast("string"), F.lit(":"), F.array_join(F.transform(cells, lambda c: F.lpad(F.hex(c), 16, "0")), ""))


def with_next(docs: DataFrame, carried: Sequence[dict[str, Column]], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, text and the columns of ``carried`` (each step may use those before), with ``next_`` columns of the next document in descending doc_id.

    After the last document comes the first. Documents are cut into blocks of consecutive ids; one
    shuffle brings each block together, and only the last row of a block takes its neighbour from
    the first row of the next block.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("_minor", F.xxhash64("text"))
    facts = docs.agg(
        F.count("*").alias("n"), F.percentile_approx("doc_id", F.lit([q / QUANTILES for q in range(QUANTILES + 1)]), F.lit(1000)).alias("q")
    ).first()
    cuts = sorted(set(facts["q"] or [0]))
    wide = max(1, -(-min(facts["n"] // block_rows, MAX_BLOCKS) // QUANTILES))
    cell = F.size(F.filter(F.lit(cuts), lambda b: b <= F.col("doc_id")))
    inner = F.lit(0.0)
    for i in range(len(cuts) - 1):
        inner = F.when(cell == i + 1, (F.col("doc_id") - cuts[i]) / (cuts[i + 1] - cuts[i])).otherwise(inner)
    # Blocks are numbered from 1 in the order of ids; rows without id are spread below by their hash.
    block = F.when(F.col("doc_id").isNotNull(), cell.cast("long") * wide + F.least(F.floor(inner * wide), F.lit(wide - 1))).otherwise(
        F.floor((F.col("_minor") / 2.0**64 + 0.5) * wide) - wide
    )
    rows = rows.withColumn("_block", block).withColumn("_major", F.coalesce("doc_id", "_minor"))
    # At most MAX_BLOCKS + 2 * QUANTILES rows: the first id of each block.
    heads = sorted((r["_block"], r["_major"]) for r in rows.groupBy("_block").agg(F.max("_major").alias("_major")).collect())
    follows = [(b, *heads[i - 1]) for i, (b, _) in enumerate(heads)]
    link = rows.sparkSession.createDataFrame(follows, "_for long, _block long, _major long")
    columns = ["text", *[name for step in carried for name in step]]
    near = F.struct(*columns)

    def worked(df: DataFrame) -> DataFrame:
        for step in carried:
            df = settle(df, step)
        return df

    first = worked(rows.join(F.broadcast(link), ["_block", "_major"])).groupBy("_for").agg(F.max_by(near, "_minor").alias("_first"))
    order = Window.partitionBy("_block").orderBy(F.col("_major").desc(), F.col("_minor").desc())
    return (
        worked(rows).withColumn("_lead", F.lead(near).over(order))
        .join(first.withColumnRenamed("_for", "_block"), "_block", "left")
        .select("doc_id", *columns, *[F.coalesce(F.col(f"_lead.{c}"), F.col(f"_first.{c}")).alias(f"next_{c}") for c in columns])
    )


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edit, and their likeness to each other and to the next text.

    The edit replaces the last half of the code points by as many from the start of the next text.
    """
    pairs = with_next(docs, [{"a": digests(F.col("text"))}, {"sa": sketch(F.col("a"), PARTS[0])}])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - half), F.col("next_text").substr(F.lit(1), half))
    pairs = settle(pairs, {"n_chars": n.cast("long"), "edited": edited})
    pairs = settle(
        pairs.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "edited", "a", "sa", F.col("next_a").alias("c"), F.col("next_sa").alias("sc")),
        {"b": digests(F.col("edited"))},
    ).drop("edited")
    pairs = settle(pairs, {"sb": sketch(F.col("b"), PARTS[0])})
    return pairs.select(
        "doc_id", "n_chars", "edited_sha256",
        shown(F.col("a"), F.col("sa")).alias("fingerprint"), shown(F.col("b"), F.col("sb")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b"), F.col("sa"), F.col("sb")).alias("near_edited"),
        likeness(F.col("a"), F.col("c"), F.col("sa"), F.col("sc")).alias("near_next"),
    )
