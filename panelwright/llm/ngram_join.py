"""N-gram Jaccard join by vertical partitioning.

A document's set holds the hashes of its distinct five-word shingles. All sets follow one global
order (hash order, very common shingles last), and the order is cut into fragments, ranges of it.
Each fragment counts how many shingles a candidate pair shares inside it; summed over fragments,
the counts give the overlap. Documents with equal sets are one node, so copies never meet in pairs.

Candidates share shingles among the first n - ceil(least * n) + 1 of their order: their first common
one stands so early that enough can follow, and so many are common there that the rest can reach the
overlap; two sets of the wanted similarity pass both tests. A first round pairs each
entry of a posting list with the list's first one of fitting size, and takes pairs that often come up:
enough to join groups of near copies with as many pairs as members; a second round takes every candidate pair whose nodes are still in different components, so no link
that could join two components is lost, and a group doesn't expand into all its pairs.

Before their overlap is counted, pairs meet by sketches: a set's sketch has about two bits for each
member, and each member turns one over. Two sketches differ in no more bits than the sets have
members of only one; a pair that differs in more than the similarity allows is no link.

Defined cases: null or empty texts have empty sets and are linked with nothing (a null doc_id is
given its own component null); a text with fewer than five words has one shingle, all of it;
documents of equal sets are linked; repeated rows each return; empty tables return none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .decontaminate import shingles
from .deploy import mapped
from .flat import mixed, pieces, ragged
from .store import by_leading_bits, components, frequent_bits, groups_of, in_table, pack, stored

PERCENT = 80
#: Shingles of more than so many sets go last in the order. Those are looked for among the first
#: COUNTED percent of each set by hash, where first shingles lie; what is missed costs work only.
OFTEN = 16
COUNTED = 30
TASK_TOKENS = 1_000_000
#: Entries of posting lists that a task packs together.
HELD_ENTRIES = 250_000
#: Sliding rounds pair each list entry with so many that follow it.
FOLLOWING = 8
MAX_SLIDING = 6
#: They go on while a round leaves at most this share of the crossing pairs.
WORTH = 0.8
BUCKET_BYTES = 4 << 20
SALTS = 64
PARTNERS = 500
#: Candidate tables up to this many rows are hinted for broadcast; beyond it they join by shuffle.
BROADCAST_ROWS = 300_000
_U = np.uint64


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """ceil(percent * n / 100)."""
    return -(-percent * n // 100)


def node_of(own: np.ndarray) -> int:
    """Node of a set: a hash of its members and size, as a signed long."""
    with np.errstate(over="ignore"):
        total = mixed(np.array([mixed(own ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + _U(len(own)) * _U(0x9E3779B97F4A7C15)], np.uint64))
    return int(total.view(np.int64)[0])


def sketch_of(own: np.ndarray) -> bytes:
    """Parities of how many members fall on each of 2 * n bits or more, a power of two."""
    bits = max(64, 1 << (2 * len(own) - 1).bit_length())
    odd = np.bincount((own & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def bits_apart(x: bytes, y: bytes) -> int:
    """In how many bits two sketches differ, the longer one folded to the other's size."""
    x, y = sorted((x, y), key=len)
    least, more = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    for half in range((len(y) // len(x)).bit_length() - 2, -1, -1):
        width = 8 * len(x) << half
        more = (more >> width) ^ (more & ((1 << width) - 1))
    return (least ^ more).bit_count()


def doc_sets(part: pa.RecordBatch) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    windows, edges, _ = shingles(part.column("text"))
    return [np.unique(windows[edges[i] : edges[i + 1]]) for i in range(part.num_rows)]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the key that finds a row's text again: its doc_id, or a hash of the text without one."""
    number = F.col("doc_id").cast("long")
    return docs.select(number.alias("doc_id"), "text", number.isNull().alias("unnamed"), F.coalesce(number, F.xxhash64("text")).alias("key"))


def profile(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), node, key and sketch of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = doc_sets(part)
                nodes = [node_of(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), part.column("unnamed"), part.column("key"), pa.array([sketch_of(s) if len(s) else None for s in sets], pa.binary())],
                    names=["doc_id", "n", "node", "unnamed", "key", "sketch"],
                )

    return mapped(_keyed(docs), run, "doc_id long, n long, node long, unnamed boolean, key long, sketch binary")


def common_shingles(docs: DataFrame, tokens: int) -> np.ndarray:
    """Bit table of shingles that more than OFTEN sets hold."""
    parts = 1 << min(12, max(4, (tokens // 4_000_000).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = 0
        for batch in batches:
            for part in pieces(batch, "text"):
                for own in doc_sets(part):
                    # Equal sets count once: copies don't make their shingles common.
                    if len(own) and (node := node_of(own)) not in held:
                        held[node] = own[: -(-COUNTED * len(own) // 100)]
                        size += len(held[node])
                if size > TASK_TOKENS:
                    yield by_leading_bits(*np.unique(np.concatenate(list(held.values())), return_counts=True), parts)
                    held, size = {}, 0
        if held:
            yield by_leading_bits(*np.unique(np.concatenate(list(held.values())), return_counts=True), parts)

    return frequent_bits(mapped(docs.select("text"), run, "bucket long, blob binary"), parts, OFTEN + 1)


def _bucketed(bucket: np.ndarray, arrays: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Rows (bucket, blob) of arrays grouped by bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(bucket))
    arrays = {k: v[order] for k, v in arrays.items()}
    blobs = [pack({k: v[a:b] for k, v in arrays.items()}) for a, b in zip(cuts, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts].astype(np.int64)), pa.array(blobs, pa.binary())], names=["bucket", "blob"])


def postings(docs: DataFrame, table: np.ndarray, buckets: int, percent: int) -> DataFrame:
    """Posting lists (token, node, n, place) of first shingles with two nodes or more, and each entry's leader:
    the list's first node that is large enough for it.
    """

    shared = docs.sparkSession.sparkContext.broadcast(table)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        seen, parts, size = set(), [], 0

        def packed() -> pa.RecordBatch:
            token, node, n, place, late = (np.concatenate(x) for x in zip(*parts, strict=True))
            salt = np.where(late, node.view(np.uint64) % _U(SALTS), _U(0))
            bucket = (mixed(token + salt * _U(0x9E3779B97F4A7C15)) >> _U(8)) % _U(buckets)
            return _bucketed(bucket.astype(np.int64), {"token": token, "node": node, "n": n, "place": place, "late": late})

        for batch in batches:
            for part in pieces(batch, "text"):
                for own in doc_sets(part):
                    node = node_of(own) if len(own) else None
                    if node is None or node in seen:
                        continue
                    seen.add(node)
                    late = in_table(common, own)
                    first = len(own) - int(needed(len(own), percent)) + 1
                    order = np.concatenate([np.flatnonzero(~late), np.flatnonzero(late)])[:first]
                    parts.append((own[order], np.full(first, node, np.int64), np.full(first, len(own), np.uint32), np.arange(first, dtype=np.uint32), late[order]))
                    size += first
                if size > HELD_ENTRIES:
                    yield packed()
                    seen, parts, size = set(), [], 0
        if parts:
            yield packed()

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in groups_of(batches, "bucket", "blob"):
            token, node, n, place, late = (np.concatenate([b[k] for b in blobs]) for k in ("token", "node", "n", "place", "late"))
            order = np.lexsort((node, n, token))
            token, node, n, place, late = token[order], node[order], n[order].astype(np.int64), place[order].astype(np.int64), late[order]
            new = np.append(True, (token[1:] != token[:-1]) | (node[1:] != node[:-1]))
            token, node, n, place, late = token[new], node[new], n[new], place[new], late[new]
            same = token[1:] == token[:-1]
            kept = np.append(False, same) | np.append(same, False) | late
            number = np.cumsum(np.append(True, ~same)) - 1
            scale = int(n.max()) + 1
            leader = np.searchsorted(number * scale + n, number * scale + needed(n, percent))
            alone = leader == np.arange(len(n))
            lead = pa.array(node[leader], mask=alone), pa.array(n[leader], mask=alone)
            table = pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(node), pa.array(n), pa.array(place), *lead], names=["token", "node", "n", "place", "lead", "n_lead"])
            yield table.filter(pa.array(kept))

    blobs = mapped(docs.select("text"), spread, "bucket long, blob binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return mapped(blobs, lists, "token long, node long, n long, place long, lead long, n_lead long")


def least_overlap(na: Column, nb: Column, percent: int) -> Column:
    """Shared members that sets of these sizes need: ceil(percent * (na + nb) / (100 + percent))."""
    return F.ceil(percent * (na + nb) / F.lit(100 + percent))


def enough_in_front(na: Column, nb: Column, percent: int) -> Column:
    """How many of the first shingles two sets of the wanted similarity have in common at least."""
    front = lambda n: n - F.ceil(percent * n / F.lit(100)) + 1
    need = least_overlap(na, nb, percent)
    return F.greatest(F.lit(1), F.least(need - na + front(na), need - nb + front(nb)))


def likely(reps: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches don't rule the similarity out."""
    side = lambda node, sketch: reps.select(F.col("node").alias(node), F.col("sketch").alias(sketch))
    met = pairs.join(side("a", "sa"), "a").join(side("b", "sb"), "b").select("a", "b", "na", "nb", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb"))
            most = na + nb - 2 * -(-percent * (na + nb) // (100 + percent))
            apart = [bits_apart(x.as_py(), y.as_py()) for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True)]
            yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(np.array(apart, np.int64) <= most))

    return mapped(met, run, "a long, b long, na long, nb long")


def overlaps(docs: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """Shared shingles of each pair: (a, b, shared), by fragments of the global order.

    ``reps`` has one document (unnamed, key) and its set size for each node. Pairs travel with their
    second node. There are as many fragments as the sets of the pairs fill.
    """
    sides = pairs.select(F.col("b").alias("node"), F.col("a").alias("partner")).union(pairs.select(F.col("a").alias("node"), F.lit(None).cast("long").alias("partner")))
    # A node's partners are split over rows of at most PARTNERS.
    number = F.row_number().over(Window.partitionBy("node").orderBy("partner"))
    wanted = (
        sides.distinct().withColumn("_part", F.floor((number - 1) / PARTNERS)).groupBy("node", "_part").agg(F.collect_set("partner").alias("partners"))
        .join(reps, "node").select("unnamed", "key", "node", "n", "partners")
    )
    wanted = stored(wanted)
    facts = wanted.agg(F.count("*").alias("rows"), F.sum("n").alias("tokens")).first()
    fragments = max(8, -(-(facts["tokens"] or 0) * 10 // BUCKET_BYTES))
    fragments = 1 << (fragments - 1).bit_length()
    wanted = wanted.drop("n")
    if facts["rows"] <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    # Rows of one key and one text come several times; a fragment counts a pair once.
    rows = _keyed(docs).drop("doc_id").join(wanted, ["unnamed", "key"])
    shift = _U(64 - max(1, fragments - 1).bit_length()) if fragments > 1 else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                tokens, owner, lists = [], [], []
                nodes = part.column("node").to_pylist()
                for i, own in enumerate(doc_sets(part)):
                    if len(own) and node_of(own) == nodes[i]:
                        tokens.append(own)
                        owner.append(np.full(len(own), i))
                if not tokens:
                    continue
                token, owner = np.concatenate(tokens), np.concatenate(owner)
                lists = part.column("partners").to_pylist()
                bucket = (token >> shift).astype(np.int64) if shift is not None else np.zeros(len(token), np.int64)
                order = np.lexsort((owner, bucket))
                token, owner, bucket = token[order], owner[order], bucket[order]
                node_array, sizes = np.array(nodes, np.int64), np.array([len(x) for x in lists])
                flat_partners = np.array([p for x in lists for p in x], np.int64)
                begin = np.cumsum(sizes) - sizes
                cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
                keys, blobs = [], []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    own, count = np.unique(owner[a:b], return_counts=True)
                    keys.append(int(bucket[a]))
                    blobs.append(pack({"token": token[a:b], "count": count.astype(np.uint32), "node": node_array[own], "size": sizes[own].astype(np.uint32), "partner": flat_partners[ragged(begin[own], sizes[own])]}))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in groups_of(batches, "bucket", "blob"):
            token, count, node, size, partner = (np.concatenate([b[k] for b in blobs]) for k in ("token", "count", "node", "size", "partner"))
            count, size = count.astype(np.int64), size.astype(np.int64)
            members = np.unique(mixed(token ^ mixed(np.repeat(node, count).view(np.uint64))))
            begin = np.cumsum(count) - count
            # One query for each (segment, partner): how many of the segment's tokens the partner has.
            # A row that came several times brought the same segments and partners; the first one asks.
            first = np.full(len(node), -1, np.int64)
            first[size > 0] = partner[(np.cumsum(size) - size)[size > 0]]
            names = np.stack([node, first, size], axis=1)
            order = np.lexsort(names.T)
            again = np.zeros(len(node), bool)
            again[order[1:]] = (names[order[1:]] == names[order[:-1]]).all(axis=1)
            of = np.repeat(np.arange(len(node)), size)
            if again.any():
                asks = ~again[of]
                of, partner = of[asks], partner[asks]
            for lo in range(0, len(of), 20_000):
                seg, other = of[lo : lo + 20_000], partner[lo : lo + 20_000]
                asked = mixed(token[ragged(begin[seg], count[seg])] ^ np.repeat(mixed(other.view(np.uint64)), count[seg]))
                hit = members[np.minimum(np.searchsorted(members, asked), len(members) - 1)] == asked
                total = np.bincount(np.repeat(np.arange(len(seg)), count[seg]), weights=hit, minlength=len(seg)).astype(np.int64)
                some = total > 0
                yield pa.RecordBatch.from_arrays([pa.array(other[some]), pa.array(node[seg[some]]), pa.array(total[some])], names=["a", "b", "shared"])

    blobs = mapped(rows, cut, "bucket long, blob binary").repartition(fragments, "bucket").sortWithinPartitions("bucket")
    return mapped(blobs, count, "a long, b long, shared long").groupBy("a", "b").agg(F.sum("shared").alias("shared"))


def linked(docs: DataFrame, reps: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the similarity."""
    pairs = stored(likely(reps, pairs, percent))
    if not pairs.limit(1).count():
        return pairs.select("a", "b")
    found = overlaps(docs, reps, pairs).join(pairs, ["a", "b"])
    return stored(found.where(F.col("shared") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b"))


def crossing(lists: DataFrame, labels: DataFrame) -> tuple[DataFrame, int, int]:
    """List entries with their component, of lists that hold two or more; their number and that of crossing pairs."""
    named = lists.select("token", "node", "n", "place").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = named.groupBy("token", "component").agg(F.count("*").alias("m")).groupBy("token").agg(
        F.count("*").alias("components"), F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("inside")
    ).where("components > 1")
    sizes = stored(sizes)
    facts = sizes.agg(F.sum("m").alias("m"), F.sum((F.col("m") * F.col("m") - F.col("inside")) / 2).alias("pairs")).first()
    return named.join(sizes.select("token"), "token"), facts["m"] or 0, facts["pairs"] or 0


def _early(x: str, y: str, percent: int) -> Column:
    """Whether a shared shingle stands early enough in both sets to be their first common one."""
    need = least_overlap(F.col(f"{x}.n"), F.col(f"{y}.n"), percent)
    return F.least(F.col(f"{x}.n") - F.col(f"{x}.place"), F.col(f"{y}.n") - F.col(f"{y}.place")) >= need


def sliding_pairs(named: DataFrame, number: int, percent: int) -> DataFrame:
    """Crossing pairs of each list entry with the FOLLOWING ones in a random order of the nodes."""
    order = Window.partitionBy("token").orderBy(F.xxhash64("node", F.lit(number)), "node")
    entry = F.struct("node", "n", "place", "component")
    after = F.array(*[F.lead(entry, k).over(order) for k in range(1, FOLLOWING + 1)])
    pairs = named.select(entry.alias("x"), after.alias("after")).select("x", F.explode("after").alias("y"))
    pairs = pairs.where("y is not null and x.component <> y.component")
    # The smaller set first, as in the other rounds.
    swap = F.struct(F.col("y.n"), F.col("y.node")) < F.struct(F.col("x.n"), F.col("x.node"))
    pairs = pairs.select(F.when(swap, F.col("y")).otherwise(F.col("x")).alias("x"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("y"))
    return _counted(pairs.where(F.col("x.n") * 100 >= percent * F.col("y.n")), percent, 4)


def crossing_pairs(named: DataFrame, percent: int) -> DataFrame:
    """All candidate pairs of different components."""
    x, y = named.select("token", F.struct("node", "n", "place", "component").alias("x")), named.select("token", F.struct("node", "n", "place", "component").alias("y"))
    apart = (F.col("x.component") != F.col("y.component")) & (F.struct("x.n", "x.node") < F.struct("y.n", "y.node")) & (F.col("x.n") * 100 >= percent * F.col("y.n"))
    return _counted(x.join(y, "token").where(apart), percent, 1)


def _counted(pairs: DataFrame, percent: int, slack: int) -> DataFrame:
    """Distinct pairs whose shared first shingles are early and many enough (by a ``slack``-th)."""
    return (
        pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"), _early("x", "y", percent).cast("int").alias("early"))
        .groupBy("a", "b", "na", "nb").agg(F.count("*").alias("times"), F.max("early").alias("early"))
        .where((F.col("early") == 1) & (F.col("times") * slack >= enough_in_front(F.col("na"), F.col("nb"), percent)))
        .select("a", "b", "na", "nb")
    )


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id that links reach) of every document."""
    rows = stored(profile(docs))
    tokens = rows.agg(F.sum("n").alias("tokens")).first()["tokens"] or 0
    common = common_shingles(docs, tokens)
    buckets = max(8, -(-tokens * 25 * (100 - percent) // 100 // BUCKET_BYTES))
    lists = stored(postings(docs, common, buckets, percent))
    reps = rows.where("node is not null").groupBy("node").agg(F.min(F.struct("unnamed", "key", "n", "sketch")).alias("r"))
    reps = stored(reps.select("node", "r.unnamed", "r.key", "r.n", "r.sketch"))
    near = (
        lists.where("lead is not null").groupBy(F.col("lead").alias("a"), F.col("node").alias("b"), F.col("n_lead").alias("na"), F.col("n").alias("nb")).count()
        .where(F.col("count") * 2 >= enough_in_front(F.col("na"), F.col("nb"), percent))
    )
    first = stored(near.select("a", "b", "na", "nb"))
    links = linked(docs, reps, first, percent)
    labels = components(links)
    tried = first.select("a", "b")
    before = None
    for number in range(MAX_SLIDING):
        named, size, apart = crossing(lists, labels)
        # No more than the sliding rounds would try: take them all.
        if apart <= FOLLOWING * MAX_SLIDING * size:
            break
        # The last round joined little: what remains shares lines and is not similar.
        if before is not None and apart > WORTH * before:
            break
        before = apart
        # Groups of similar sets whose leaders didn't link all: each entry tries some that follow it.
        near = stored(sliding_pairs(named, number, percent).join(tried, ["a", "b"], "left_anti"))
        more = linked(docs, reps, near, percent)
        tried = tried.union(near.select("a", "b"))
        if not more.limit(1).count():
            break
        links = stored(links.union(more))
        labels = components(links)
    named, _, _ = crossing(lists, labels)
    second = stored(crossing_pairs(named, percent).join(tried, ["a", "b"], "left_anti"))
    if second.limit(1).count():
        more = linked(docs, reps, second, percent)
        if more.limit(1).count():
            labels = components(links.union(more))
    # Smallest doc_id of each component of nodes, then back to the documents.
    least = rows.where("node is not null").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of_node = least.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_node = least.select("node", "component").distinct().join(of_node, "component").select("node", "component_id")
    return rows.join(by_node, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


#: Ids to be dropped are hinted for broadcast up to this many.
BROADCAST_IDS = 2_000_000


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents without all but the smallest doc_id of each component.

    Rows that share both doc_id and text are one document; rows without doc_id stay.
    """
    found = stored(near_duplicates(docs, percent))
    gone = stored(found.where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    left = docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
    again = stored(found.where("doc_id is not null").groupBy(F.col("doc_id").alias("_again")).count().where("count > 1").select("_again"))
    if not again.limit(1).count():
        return left
    repeats = F.col("doc_id").cast("long") == F.col("_again")
    return left.join(again, repeats, "left_anti").unionByName(left.join(again, repeats, "left_semi").dropDuplicates(["doc_id", "text"]))
