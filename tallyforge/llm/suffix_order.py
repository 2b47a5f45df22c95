"""Suffix order by linear grouping, without recursive renaming.

Phase 1 groups the suffixes by their longest Lyndon prefix. Groups start as one for each symbol and are processed
from the highest to the lowest. For each suffix of a group, the nearest earlier suffix in a lower group is found over
the pointers set so far (its previous smaller one). Each such parent continues with the group's prefix once for every
suffix that points to it, so parents leave their group for new ones just above it, the higher the more often they
were pointed to. What is above the group that is processed never changes again.

Phase 2 goes through the order from its start. The suffix before the one that is met, and the chain of its pointers,
are each the next of their group, so they go to the first free place of it. Each suffix is placed once.
"""

from __future__ import annotations

import numpy as np

_UNSET = -2


def _groups(symbols: np.ndarray) -> tuple[list[int], list[int], list[int], int]:
    """group of each suffix, pointer of each suffix, the next higher group of each group, and the lowest group."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    cuts = np.flatnonzero(np.diff(symbols[order], prepend=symbols[order[0]] - 1)).tolist() + [n]
    flat = order.tolist()
    members = [flat[a:b] for a, b in zip(cuts, cuts[1:])]  # noqa: B905
    k = len(members)
    first = np.empty(n, np.int64)
    first[order] = np.repeat(np.arange(k), np.diff(cuts))
    group = first.tolist()
    higher, lower = [*range(1, k), -1], list(range(-1, k - 1))
    pointer = [_UNSET] * (n + 1)  # the last stands for the place before the first suffix
    g = k - 1
    while g >= 0:
        parents: dict[int, int] = {}
        for s in members[g]:
            if group[s] == g:
                p = s - 1
                q = pointer[p]
                while q != _UNSET:
                    p = q
                    q = pointer[p]
                pointer[s] = p
                if p >= 0:
                    parents[p] = parents.get(p, 0) + 1
        members[g] = []
        if len(parents) == 1:
            ((p, times),) = parents.items()
            moves = [((times, group[p]), [p])]
        else:
            by: dict[tuple[int, int], list[int]] = {}
            for p, times in parents.items():
                key = (times, group[p])
                if key in by:
                    by[key].append(p)
                else:
                    by[key] = [p]
            moves = sorted(by.items(), reverse=True) if len(by) > 1 else by.items()
        for (_, h), moved in moves:
            new, above = len(members), higher[h]
            members.append(moved)
            higher[h] = new
            higher.append(above)
            lower.append(h)
            lower[above] = new  # a group is always above a parent's: the one in process
            for p in moved:
                group[p] = new
        g = lower[g]
    return group, pointer, higher, 0


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of symbols in ascending order. The last symbol must be the one smallest."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    group, pointer, higher, g = _groups(np.asarray(symbols, np.int64))
    sizes = np.bincount(group, minlength=len(higher)).tolist()
    place, at = [0] * len(higher), 0
    while g >= 0:
        place[g] = at
        at += sizes[g]
        g = higher[g]
    out, placed = [-1] * n, [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            placed[s] = True
            g = group[s]
            out[place[g]] = s
            place[g] += 1
            s = pointer[s]
    return np.array(out, np.int64)
