"""Suffix arrays by linear grouping (Baier, "Linear-time Suffix Sorting", 2016)."""

from __future__ import annotations

from collections import defaultdict


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of text in lexicographic order; a suffix that is a prefix of another comes first.

    Phase 1 sorts suffixes into groups by their Lyndon prefix. Groups start as first symbols and are taken in
    descending order; prev[i] points from a suffix of the group to the nearest earlier suffix of a lower group. Those
    pointed at by k members of the group are extended by k copies of its prefix: they leave their own groups for new
    ones just above, the larger k the higher. Phase 2 walks the array from its smallest suffix and puts the suffix before
    it, and then along the prev pointers, into the next free place of each one's group. Nothing is renamed or recursed.
    """
    n = len(text) + 1
    symbols = [*text, -1]  # an end below all symbols
    order = sorted(range(n), key=symbols.__getitem__)
    place, start, last = [0] * n, [0] * n, [0] * n  # start: of a suffix's group; last: of the group that starts here
    first = 0
    for at, i in enumerate(order):
        place[i] = at
        if at and symbols[order[at - 1]] != symbols[i]:
            last[first] = at - 1
            first = at
        start[i] = first
    last[first] = n - 1

    prev = [-1] * n
    high = n - 1
    while high >= 0:
        low = start[order[high]]
        pointed: dict[int, int] = {}
        for i in sorted(order[low : high + 1]) if high > low else (order[low],):
            j = i - 1
            while j >= 0 and start[j] >= low:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        if pointed:
            by_count = defaultdict(list)
            for j, k in pointed.items():
                by_count[k].append(j)
            for k in sorted(by_count, reverse=True):
                moved = defaultdict(list)
                for j in by_count[k]:
                    moved[start[j]].append(j)
                for group, members in moved.items():
                    end = last[group]
                    if end - group + 1 == len(members):
                        continue  # the whole group moves: its place stays
                    top = end
                    for j in members:
                        at, other = place[j], order[top]
                        order[at], order[top], place[other], place[j] = other, j, at, top
                        top -= 1
                    last[group], last[top + 1] = top, end
                    for j in members:
                        start[j] = top + 1
        high = low - 1

    out, done, free = [0] * n, [False] * n, list(range(n))  # free: next place of the group that starts here
    out[0], done[n - 1] = n - 1, True
    for at in range(n):
        j = out[at] - 1
        while j >= 0 and not done[j]:
            done[j] = True
            group = start[j]
            out[free[group]] = j
            free[group] += 1
            j = prev[j]
    return out[1:]
