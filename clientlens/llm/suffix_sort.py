"""Suffix array of an integer text by grouping, in linear time.

Suffixes are grouped by a common prefix that grows into the longest Lyndon
word they begin with. Groups are taken in descending order. The suffix before
a group's member that is still in a smaller group, its previous smaller one,
gets the member's word appended as often as members point to it, and moves to
a new group right behind its own. When every group has been taken, the order
of the groups is known, and one pass emits the order inside them: a suffix
that is placed decides the place of the one in front of it, and of those that
the pointers lead to. No step renames the text or recurses."""

from __future__ import annotations

from collections import Counter
from itertools import groupby

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """``text`` ends with a value smaller than all others."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    values = np.asarray(text)[order]
    first = np.concatenate(([True], values[1:] != values[:-1]))
    begins = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    group_of = np.empty(n, np.int64)
    group_of[order] = begins
    place_of = np.empty(n, np.int64)
    place_of[order] = np.arange(n)
    ends = np.zeros(n, np.int64)
    starts = np.flatnonzero(first)
    ends[starts] = np.append(starts[1:], n)
    smaller = _group(order.tolist(), place_of.tolist(), group := group_of.tolist(), ends.tolist())
    return np.array(_emit(n, group, smaller), np.int64)


def _group(order: list, place: list, group: list, end: list) -> list:
    """Regroups all suffixes; ``group[i]`` becomes the place in the order at
    which the group of suffix i begins. Returns the previous-smaller pointers."""
    smaller = [-1] * len(order)
    top = len(order)
    while top > 0:
        current = group[order[top - 1]]
        members = order[current:top]
        top = current
        members.sort()
        targets = []
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= current:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                targets.append(j)
        if len(targets) == 1:  # the usual case late on: one suffix moves to the end of its group
            j = targets[0]
            old = group[j]
            last = end[old] - 1
            if last > old:
                at, other = place[j], order[last]
                order[at], order[last] = other, j
                place[other], place[j] = at, last
                end[old], end[last] = last, last + 1
                group[j] = last
            continue
        often = Counter(targets)
        # by group, those with the most pointers last
        for old, moved in groupby(sorted(often, key=lambda j: (group[j], -often[j])), key=group.__getitem__):
            back = end[old]
            for _, alike in groupby(moved, key=often.__getitem__):
                stop = back
                alike = list(alike)
                for j in alike:
                    back -= 1
                    at, other = place[j], order[back]
                    order[at], order[back] = other, j
                    place[other], place[j] = at, back
                if back > old:
                    for j in alike:
                        group[j] = back
                    end[back] = stop
                    end[old] = back
    return smaller


def _emit(n: int, free: list, smaller: list) -> list:
    """Fills each group from its begin. ``free`` has the begin of each
    suffix's group; the next free place of a group is kept in ``filled``."""
    out = [-1] * n
    out[0] = n - 1
    filled = [0] * n
    done = bytearray(n)
    done[n - 1] = 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not done[j]:
            begin = free[j]
            out[begin + filled[begin]] = j
            filled[begin] += 1
            done[j] = 1
            j = smaller[j]
    return out
