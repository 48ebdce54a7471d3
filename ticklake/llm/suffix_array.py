"""Suffix array by linear grouping.

First phase: suffixes are grouped by their longest Lyndon prefix. Groups start as first symbols and
are taken in descending order; every member points at the nearest suffix to its left in a smaller
group (its previous-smaller pointer), and a suffix that k members point at has its prefix grow by k
copies of the group's, so it moves behind those of its group that grow by less. Second phase: in
ascending order every suffix puts the suffixes that it ends the Lyndon prefix of at the next place of
their groups. Names are never recomputed and nothing recurses.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """Start positions in the order of their suffixes. The last symbol must be smaller than all others."""
    n = len(symbols)
    if n == 0:
        return []
    values = np.asarray(symbols, np.int64)
    by = np.argsort(values, kind="stable")
    ranked = values[by]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    starts = np.flatnonzero(first)
    of_rank = starts[np.cumsum(first) - 1]
    group_of = np.empty(n, np.int64)
    group_of[by] = of_rank
    place_of = np.empty(n, np.int64)
    place_of[by] = np.arange(n)
    order, group, place = by.tolist(), group_of.tolist(), place_of.tolist()
    size = [0] * n
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), n]):
        size[a] = b - a
    smaller = [-1] * n

    high = n
    while high:
        low = group[order[high - 1]]
        members = order[low:high] if high - low == 1 else sorted(order[low:high])
        pointed: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        levels: dict[int, list[int]] = {}
        for j, k in pointed.items():
            levels.setdefault(k, []).append(j)
        for k in sorted(levels, reverse=True):
            parts: dict[int, list[int]] = {}
            for j in levels[k]:
                parts.setdefault(group[j], []).append(j)
            for g, moved in parts.items():
                rest = size[g] - len(moved)
                if not rest:
                    continue
                end = g + size[g]
                for j in moved:
                    end -= 1
                    other, at = order[end], place[j]
                    order[at], place[other] = other, at
                    order[end], place[j] = j, end
                for j in moved:
                    group[j] = end
                size[end], size[g] = len(moved), rest
        high = low

    out, free, done = [-1] * n, list(range(n)), [False] * n
    out[0], done[n - 1] = n - 1, True
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = True
            j = smaller[j]
    return out
