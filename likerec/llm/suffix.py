"""Suffix arrays by linear grouping.

The suffixes of a text are first grouped by their Lyndon prefixes (the longest Lyndon word each starts with), from
the highest group to the lowest, then each group is put in order by one pass from the least suffix up. Nothing is
renamed and solved again for a shorter text.
"""

from __future__ import annotations

import numpy as np


def _group_by_lyndon_prefix(symbols: np.ndarray) -> tuple[list[int], list[int]]:
    """For each suffix the first place of its group in the order, and the last suffix before it of a lower group.

    Groups start as first symbols. When a group is processed, its members' words are known in full; each extends the
    word of the suffix in front of it, found by following pointers over suffixes that are not lower. Suffixes
    extended more often go behind those extended less often, and all of them behind the rest of their group.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    first = np.maximum.accumulate(np.where(np.r_[True, ordered[1:] != ordered[:-1]], np.arange(n), 0))
    place, group = np.empty(n, np.int64), np.empty(n, np.int64)
    place[order], group[order] = np.arange(n), first
    size = np.bincount(first, minlength=n).tolist()
    order, place, group = order.tolist(), place.tolist(), group.tolist()
    before = list(range(-1, n - 1))

    def to_back(suffix: int) -> None:
        start = group[suffix]
        size[start] -= 1
        last = start + size[start]
        other, at = order[last], place[suffix]
        order[at], place[other] = other, at
        order[last], place[suffix] = suffix, last

    end = n - 1
    while end >= 0:
        start = group[order[end]]
        if start == end:
            suffix = order[end]
            p = suffix - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[suffix] = p
            if p >= 0 and size[group[p]] > 1:
                to_back(p)
                group[p] = new = place[p]
                size[new] = 1
        else:
            times: dict[int, int] = {}
            for suffix in sorted(order[start: end + 1]):
                p = suffix - 1
                while p >= 0 and group[p] >= start:
                    p = before[p]
                before[suffix] = p
                if p >= 0:
                    times[p] = times.get(p, 0) + 1
            classes: dict[int, list[int]] = {}
            for p, k in times.items():
                classes.setdefault(k, []).append(p)
            for k in sorted(classes, reverse=True):
                moved = classes[k]
                for p in moved:
                    to_back(p)
                fresh = [group[p] + size[group[p]] for p in moved]
                for p, new in zip(moved, fresh):
                    group[p] = new
                    size[new] += 1
        end = start - 1
    return group, before


def suffix_array(symbols: np.ndarray) -> list[int]:
    """The order of the suffixes of ``symbols``, whose last one must be less than all others."""
    n = len(symbols)
    if not n:
        return []
    group, before = _group_by_lyndon_prefix(symbols)
    order, placed = [-1] * n, bytearray(n)
    order[0], placed[n - 1] = n - 1, 1
    free = list(range(n))  # the next free place of the group that starts here
    for at in range(n):
        suffix = order[at] - 1
        while suffix >= 0 and not placed[suffix]:
            start = group[suffix]
            order[free[start]] = suffix
            free[start] += 1
            placed[suffix] = 1
            suffix = before[suffix]
    return order


def repeated_starts(texts: list[bytes], width: int) -> list[np.ndarray]:
    """For each text, where strings of ``width`` bytes start that start anywhere else in these texts too."""
    joined = b"\x00".join(texts) + b"\x00"
    lengths = np.array([len(t) for t in texts])
    ends = np.cumsum(lengths + 1) - 1
    symbols = np.frombuffer(joined, np.uint8).astype(np.int64) + len(texts)
    symbols[ends] = np.r_[1: len(texts), 0]  # every end is a symbol of its own; the last is the least
    order = np.array(suffix_array(symbols))
    text_of = np.searchsorted(ends, order)
    order = order[order + width <= ends[text_of]]
    found = []
    for a, b in zip(order[:-1].tolist(), order[1:].tolist()):
        if joined[a: a + width] == joined[b: b + width]:
            found += (a, b)
    starts = np.unique(np.array(found, dtype=np.int64))
    begins = ends - lengths
    cuts = np.searchsorted(starts, begins)
    return [part - begin for part, begin in zip(np.split(starts, cuts[1:]), begins)]
