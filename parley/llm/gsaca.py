"""Suffix sorting by grouping, in linear time and without recursion.

Suffixes are grouped by a prefix that is a Lyndon word.  Phase one takes the
groups in descending order.  For each member it finds, over the pointers set so
far, the nearest suffix to its left in a smaller group; that suffix's prefix
grows by this group's, and it moves to the end of its own group, as often as
pointed to further back.  Once every group was taken, its prefix is the longest
Lyndon one.  Phase two goes through the array being made: each suffix that comes
next fixes the next place in the groups of those whose prefix ends where it
starts, which are found along the same pointers.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """The starts of all suffixes of ``text`` (small integers) in order."""
    n = len(text)
    if n < 2:
        return list(range(n))
    # groups by first symbol; of(s): where the group of s starts in the order
    order = sorted(range(n), key=text.__getitem__)
    place, of, size = [0] * n, [0] * n, [0] * n
    start, last = 0, -1
    for i, s in enumerate(order):
        if text[s] != last:
            start, last = i, text[s]
        place[s], of[s] = i, start
        size[start] += 1
    left = [-1] * n

    end = n
    while end:
        start = of[order[end - 1]]
        if end - start == 1:
            s = order[start]
            p = s - 1
            while p >= 0 and of[p] >= start:
                p = left[p]
            left[s] = p
            if p >= 0:
                # p goes to the end of its group, as a group of its own
                g = of[p]
                m = size[g]
                if m > 1:
                    to, at = g + m - 1, place[p]
                    if at != to:
                        q = order[to]
                        order[at], order[to] = q, p
                        place[q], place[p] = at, to
                    of[p] = to
                    size[to], size[g] = 1, m - 1
            end = start
            continue
        times: dict[int, int] = {}
        for s in sorted(order[start:end]):
            p = s - 1
            while p >= 0 and of[p] >= start:
                p = left[p]
            left[s] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        end = start
        if not times:
            continue
        # those pointed to most often go to the very end of their groups
        by: dict[tuple[int, int], list[int]] = {}
        for p, k in times.items():
            by.setdefault((k, of[p]), []).append(p)
        for (_, g), moved in sorted(by.items(), reverse=True) if len(by) > 1 else by.items():
            m, k = size[g], len(moved)
            if m == k:
                continue
            to = g + m
            new = to - k
            for p in moved:
                to -= 1
                at = place[p]
                if at != to:
                    q = order[to]
                    order[at], order[to] = q, p
                    place[q], place[p] = at, to
                of[p] = new
            size[new], size[g] = k, m - k

    # phase two: the end of the text first, then what is placed, in order
    out, free, done = [0] * n, list(range(n)), [False] * n
    s = n - 1
    while s >= 0 and not done[s]:
        g = of[s]
        out[free[g]] = s
        free[g] += 1
        done[s] = True
        s = left[s]
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not done[s]:
            g = of[s]
            out[free[g]] = s
            free[g] += 1
            done[s] = True
            s = left[s]
    return out
