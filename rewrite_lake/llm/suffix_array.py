"""Suffix sorting in two passes over Lyndon-prefix groups, without renaming.

Pass one refines groups of suffixes by their longest Lyndon prefix.  Groups are
taken in descending order; each suffix of a group points at its previous smaller
position, which absorbs the group's prefix as often as it is pointed at, so the
positions pointed at move to the upper end of their own group, those with more
repeats above those with fewer.  Pass two walks the order from the end of text
upwards: a placed suffix places, at the next free slot of its group, every
suffix whose Lyndon prefix ends where the placed one starts.
"""

from __future__ import annotations


def lyndon_groups(seq: list[int]) -> tuple[list[int], list[int]]:
    """(group, length): per position the start of its group in suffix order, and
    the length of its longest Lyndon prefix."""
    n = len(seq)
    order = sorted(range(n), key=seq.__getitem__)
    place = [0] * n
    group = [0] * n
    end = {}
    start = 0
    for at, i in enumerate(order):
        if at and seq[i] != seq[order[at - 1]]:
            end[start] = at
            start = at
        place[i], group[i] = at, start
    if n:
        end[start] = n
    length = [1] * n
    skip = [i - 1 for i in range(n)]  # leaps to the left over positions already in higher groups
    top = n
    while top:
        first = group[order[top - 1]]
        members = sorted(order[first:top])
        width = length[members[0]]
        repeats: dict[int, int] = {}
        for i in members:
            j = skip[i]
            while j >= 0 and group[j] >= first:
                j = skip[j]
            k = i
            while k >= 0 and skip[k] != j and group[k] >= first:
                skip[k], k = j, skip[k]
            if j >= 0:
                repeats[j] = repeats.get(j, 0) + 1
        by_count: dict[int, list[int]] = {}
        for j, count in repeats.items():
            by_count.setdefault(count, []).append(j)
        for count in sorted(by_count, reverse=True):
            moved: dict[int, int] = {}
            for j in by_count[count]:
                g = group[j]
                moved[g] = moved.get(g, 0) + 1
                at = end[g] - moved[g]
                other = order[at]
                order[place[j]], place[other] = other, place[j]
                order[at], place[j] = j, at
            cut = {}
            for g, m in moved.items():
                cut[g] = end[g] - m
                if cut[g] != g:
                    end[cut[g]], end[g] = end[g], cut[g]
            for j in by_count[count]:
                group[j] = cut[group[j]]
                length[j] += count * width
        top = first
    return group, length


def suffix_array(seq: list[int]) -> list[int]:
    """Start positions of the suffixes of ``seq`` in ascending order."""
    n = len(seq)
    group, length = lyndon_groups(seq)
    waiting: list[list[int]] = [[] for _ in range(n + 1)]
    for i in range(n):
        waiting[i + length[i]].append(i)
    out = [-1] * n
    free = list(range(n))
    for i in waiting[n]:
        out[free[group[i]]] = i
        free[group[i]] += 1
    for at in range(n):
        for i in waiting[out[at]]:
            g = group[i]
            out[free[g]] = i
            free[g] += 1
    return out


def neighbour_lcp(seq: list[int], order: list[int]) -> list[int]:
    """Symbols each suffix of the order shares with the one before it."""
    n = len(seq)
    rank = [0] * n
    for at, i in enumerate(order):
        rank[i] = at
    lcp = [0] * n
    h = 0
    for i in range(n):
        at = rank[i]
        if at == 0:
            h = 0
            continue
        j = order[at - 1]
        while i + h < n and j + h < n and seq[i + h] == seq[j + h]:
            h += 1
        lcp[at] = h
        if h:
            h -= 1
    return lcp
