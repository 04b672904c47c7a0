"""Suffix arrays by Lyndon grouping, for many strings side by side.

Suffixes start in groups by their first symbol. Groups are taken from the highest down; for each of
its suffixes the nearest earlier suffix of a lower group (the previous smaller one) is found over
pointers, and those earlier suffixes move into new groups right behind their old ones, by how often
they were met. In the end a group holds the suffixes of one Lyndon prefix, groups in their order.
A second pass, from the smallest suffix up, then emits each group's members in order: the suffix
before the current one, and its previous smaller ones, take the next places of their groups. No
names are assigned anew and nothing recurses.

The strings are independent and advance in step, one group (or one suffix) of each at a time, so
that every step is a few numpy operations over all strings.
"""

from __future__ import annotations

import numpy as np

from .flat import ragged

#: Below so many strings the emission takes all standing suffixes in a step.
FEW = 300


def suffix_arrays(text: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Places in ``text`` of each string's suffixes in lexicographic order, string after string.

    ``edges`` are the strings' bounds in ``text`` (one more than strings); an end is smaller than
    every symbol.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    group, previous = _groups(text, edges)
    return _emit(group, previous, edges)


def _groups(text: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Final group (the place where it starts) and previous smaller suffix (-1: none) of each place."""
    n, lengths = len(text), np.diff(edges)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    order = np.lexsort((text, owner))
    new = np.append(True, (text[order][1:] != text[order][:-1]) | (owner[order][1:] != owner[order][:-1]))
    begins = np.flatnonzero(new)
    sizes = np.zeros(n, np.int64)
    sizes[begins] = np.diff(np.append(begins, n))
    group = np.empty(n, np.int64)
    group[order] = np.repeat(begins, sizes[begins])
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    previous = np.full(n, -1, np.int64)
    met = np.zeros(n, bool)
    low = edges[:-1].astype(np.int64)
    active = np.flatnonzero(lengths > 0)
    high = edges[1:].astype(np.int64).copy()
    while len(active):
        start = group[order[high[active] - 1]]
        count = high[active] - start
        members = order[ragged(start, count)]
        floor, bottom = np.repeat(start, count), np.repeat(low[active], count)
        high[active] = start
        active = active[start > low[active]]
        # Previous smaller suffix: over pointers of higher groups.
        found = members - 1
        todo = np.flatnonzero(found >= bottom)
        found[found < bottom] = -1
        while len(todo):
            todo = todo[group[found[todo]] > floor[todo]]
            found[todo] = previous[found[todo]]
            todo = todo[found[todo] >= 0]
        # One of the same group: that suffix's previous one (the prefix repeats).
        peer = np.flatnonzero((found >= 0) & (group[np.maximum(found, 0)] == floor))
        previous[members] = found
        while len(peer):
            found[peer] = previous[found[peer]]
            previous[members[peer]] = found[peer]
            peer = peer[(found[peer] >= 0) & (group[np.maximum(found[peer], 0)] == floor[peer])]
        hit = found[found >= 0]
        if not len(hit):
            continue
        moved, times = np.unique(hit, return_counts=True)
        own = group[moved]
        sort = np.lexsort((times, own))
        moved, times, own = moved[sort], times[sort], own[sort]
        head = np.append(True, own[1:] != own[:-1])
        first = np.flatnonzero(head)
        k = np.diff(np.append(first, len(own)))
        g = own[first]
        z = sizes[g]
        split = (k < z) | (np.maximum.reduceat(times, first) > np.minimum.reduceat(times, first))
        if not split.any():
            continue
        keep = np.repeat(split, k)
        moved, times, own = moved[keep], times[keep], own[keep]
        g, z, k = g[split], z[split], k[split]
        tail = ragged(g + z - k, k)
        met[moved] = True
        there = order[tail]
        displaced = there[~met[there]]
        places = at[moved]
        holes = places[places < np.repeat(g + z - k, k)]
        order[holes] = displaced
        at[displaced] = holes
        order[tail] = moved
        at[moved] = tail
        met[moved] = False
        block = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (times[1:] != times[:-1])))
        amount = np.diff(np.append(block, len(own)))
        sizes[g] = z - k
        sizes[tail[block]] = amount
        group[moved] = np.repeat(tail[block], amount)
    return group, previous


def _emit(group: np.ndarray, previous: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sorted suffixes from final groups and previous smaller suffixes.

    One suffix of every string at a time while many strings remain, then all that stand without a
    gap at a time.
    """
    n, lengths = len(group), np.diff(edges)
    out = np.full(n, -1, np.int64)
    free = np.arange(n)  # next free place of the group that starts here
    waiting = np.ones(n, bool)
    by_length = np.argsort(-lengths, kind="stable")
    low, lengths = edges[:-1][by_length].astype(np.int64), lengths[by_length]
    alive = int(np.count_nonzero(lengths))
    low = low[:alive]
    current = low + lengths[:alive]  # the empty suffix comes first
    step = 0
    while alive > FEW:
        s = current - 1
        chain = np.flatnonzero(s >= low[:alive])
        s = s[chain]
        s = s[waiting[s]]
        while len(s):
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            waiting[s] = False
            s = previous[s]
            s = s[s >= 0]
            s = s[waiting[s]]
        while alive and lengths[alive - 1] <= step:
            alive -= 1
        current = out[low[:alive] + step]
        step += 1
    # The suffixes in ``current`` are next; all before them are done.
    return _emit_standing(group, previous, out, free, waiting, low[:alive], lengths[:alive], current[:alive], step)


def _emit_standing(group, previous, out, free, waiting, low, lengths, entries, step) -> np.ndarray:
    """The rest of ``_emit``: each step takes, in every string, the suffixes that stand without a gap.

    A waiting suffix that several of them lead to belongs to the first; those of one group are placed
    in that order.
    """
    n = len(group)
    none = np.int64(1 << 62)
    claim = np.full(n, none)
    done, bottom = np.full(len(low), step, np.int64), low
    while len(low):
        first = np.flatnonzero(entries > bottom)
        s = entries[first] - 1
        ready = waiting[s]
        s, rank = s[ready], first[ready]
        claim[s] = rank
        found = [s]
        while len(s):
            p = previous[s]
            up = p >= 0
            p, rank = p[up], rank[up]
            up = waiting[p] & (rank < claim[p])
            p, rank = p[up], rank[up]
            np.minimum.at(claim, p, rank)
            own = claim[p] == rank
            s, rank = p[own], rank[own]
            found.append(s)
        placed = np.concatenate(found)
        if len(found) > 2:
            placed = np.unique(placed)
        order = np.lexsort((claim[placed], group[placed]))
        placed = placed[order]
        if len(placed):
            g = group[placed]
            head = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            count = np.diff(np.append(head, len(g)))
            out[ragged(free[g[head]], count)] = placed
            free[g[head]] += count
            waiting[placed] = False
            claim[placed] = none
        width = int(np.clip(20_000 // len(low), 1, 512))
        at = done[:, None] + np.arange(width)
        inside = at < lengths[:, None]
        view = np.where(inside, out[np.minimum(low[:, None] + at, n - 1)], -1)
        standing = np.logical_and.accumulate(view >= 0, axis=1)
        taken = standing.sum(axis=1)
        entries, bottom = view[standing], np.repeat(low, taken)
        done = done + taken
        open_ = taken > 0
        if not open_.all():
            low, lengths, done = low[open_], lengths[open_], done[open_]
    return out
