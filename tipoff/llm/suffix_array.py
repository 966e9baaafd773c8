"""Suffix arrays by linear grouping (no recursion, no renaming).

Phase 1 takes groups of suffixes in descending order. For each member it finds the nearest earlier suffix of a lower group (its previous
smaller suffix, found by hopping over pointers already known) and lifts those suffixes out of their groups, those hit most often
highest; at the end suffixes are grouped by their Lyndon prefix. Phase 2 walks the array in ascending order and puts each suffix that
stands before a placed one, and the chain of its previous smaller suffixes, at the front of its group.
"""

from __future__ import annotations


def suffix_array(text: list[int] | bytes) -> list[int]:
    """Positions of the suffixes of `text` in ascending order; a suffix sorts before those it begins."""
    n = len(text) + 1  # a closing symbol below all others
    symbols = sorted(set(text))
    start, at = {}, 1
    count: dict[int, int] = dict.fromkeys(symbols, 0)
    for c in text:
        count[c] += 1
    for c in symbols:
        start[c] = at
        at += count[c]
    group = [start[c] for c in text]  # of each suffix: where its group starts
    group.append(0)
    size = [0] * n  # by the start of a group
    size[0] = 1
    order, place = [0] * n, [0] * n
    order[0], place[n - 1] = n - 1, 0
    for i in range(n - 1):
        g = group[i]
        p = g + size[g]
        order[p], place[i] = i, p
        size[g] += 1
    previous = [-1] * n
    hits = [0] * n
    end = n - 1
    while end > 0:
        g = group[order[end]]
        members = order[g : end + 1]
        if len(members) > 1:
            members.sort()
        by_count: list[list[int]] = []
        touched = []
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                if not hits[p]:
                    touched.append(p)
                hits[p] += 1
        for p in touched:
            k = hits[p]
            hits[p] = 0
            while len(by_count) < k:
                by_count.append([])
            by_count[k - 1].append(p)
        for lifted in reversed(by_count):
            for p in lifted:
                old = group[p]
                size[old] -= 1
                to, here = old + size[old], place[p]
                other = order[to]
                order[to], order[here] = p, other
                place[p], place[other] = to, here
            for p in lifted:
                new = group[p] + size[group[p]]
                group[p] = new
                size[new] += 1
        end = g - 1
    free = [0] * n
    for i in range(n):
        free[group[i]] = group[i]
    out, placed = [0] * n, bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = previous[j]
    return out[1:]
