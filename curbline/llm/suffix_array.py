"""Suffix arrays by linear grouping: suffixes are grouped by their Lyndon prefix, then put in order.

A suffix's Lyndon prefix reaches to the next smaller suffix, and is its first symbol followed by the Lyndon prefixes
of its children, the suffixes whose previous smaller suffix it is.  Groups begin with the first symbol
alone.  They are processed from the largest down.  When a group's turn has come, all larger suffixes are done, so a member's
previous smaller suffix is the nearest place to its left that is neither done nor in the group: it is found over
the done places by pointers, and no text is compared.  A processed group's members extend the prefixes of their
parents, so the parents leave their group for a higher one, further up the more such children they have.  Once all
groups are done, one ascending pass over them emits the order: a suffix stands where the suffix that follows
its Lyndon prefix has been met.  There is no recursion and no renaming.
"""

from __future__ import annotations

from collections import defaultdict


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of a list of integers, in ascending order."""
    n = len(text)
    if not n:
        return []
    parent = [-1] * n
    jump = [*range(n + 1)]  # place i stands at i + 1, the end before the text at 0; one that is done points further left
    order = sorted(range(n), key=text.__getitem__)  # group by first symbol
    place = [0] * n
    group = [0] * n  # the group of a suffix, named by an index of start and end
    start: list[int] = []
    end: list[int] = []
    last = None
    for at, i in enumerate(order):
        place[i] = at
        if text[i] != last:
            last = text[i]
            start.append(at)
            end.append(at)
        group[i] = len(start) - 1
        end[-1] = at + 1

    top = n
    while top:
        g = group[order[top - 1]]
        low = start[g]
        for i in order[low:top]:
            jump[i + 1] = i
        for i in order[low:top]:
            at = i
            while jump[at] != at:  # pointers on the way are halved
                jump[at] = at = jump[jump[at]]
            parent[i] = at - 1
        if top - low == 1:
            p = parent[order[low]]
            by_count = [(1, [p])] if p >= 0 else []
        else:
            times: dict[int, int] = {}
            for i in order[low:top]:
                p = parent[i]
                if p >= 0:
                    times[p] = times.get(p, 0) + 1
            grouped: dict[int, list[int]] = defaultdict(list)
            for p, k in times.items():
                grouped[k].append(p)
            by_count = sorted(grouped.items(), reverse=True)
        for _, parents in by_count:
            moved: dict[int, list[int]] = {}
            for p in parents:  # to the end of its group
                q = group[p]
                e = end[q] - 1
                end[q] = e
                at, other = place[p], order[e]
                order[at], order[e] = other, p
                place[other], place[p] = at, e
                moved.setdefault(q, []).append(p)
            for q, members in moved.items():
                if end[q] == start[q]:  # all of the group moved: it stays one group
                    end[q] += len(members)
                    continue
                start.append(end[q])
                end.append(end[q] + len(members))
                for p in members:
                    group[p] = len(start) - 1
        top = low

    # Ascending pass.  Suffixes whose Lyndon prefix ends where i begins: i - 1 and its parents, down to i's own parent.
    slot = start[:]
    out = [-1] * n
    s = n - 1
    while s >= 0:  # those that the end of the text follows
        out[slot[group[s]]] = s
        slot[group[s]] += 1
        s = parent[s]
    for at in range(n):
        i = out[at]
        stop, s = parent[i], i - 1
        while s >= 0 and s != stop:
            out[slot[group[s]]] = s
            slot[group[s]] += 1
            s = parent[s]
    return out
