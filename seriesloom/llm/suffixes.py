"""Suffix order by linear grouping.

Suffixes are grouped by their Lyndon prefixes.  Groups are processed in
descending order: every member finds its previous smaller suffix (the nearest
to the left that stands in a lower group) by following pointers, and a suffix
that k members have found moves up, with all of its group that k members have
found, into a new group just above its own.  Then one ascending pass puts each
suffix into the next place of its group along the pointers.  Nothing is
renamed and no suffixes are compared.
"""

from __future__ import annotations


def suffix_order(text: list[int] | bytes) -> list[int]:
    """Start positions of the suffixes of text in lexicographic order."""
    n = len(text)
    symbols = sorted(set(text))
    rank = {c: k for k, c in enumerate(symbols)}
    # a doubly linked list of groups; a group of one suffix is that suffix; stale members have moved up
    members: list[list[int] | int] = [[] for _ in symbols]
    lower = list(range(-1, len(symbols) - 1))
    upper = [*range(1, len(symbols)), -1]
    group = [rank[c] for c in text]
    for i, g in enumerate(group):
        members[g].append(i)
    begins: list[tuple[int, int]] = []  # the processed groups and where each begins in the order
    done = bytearray(n + 1)  # the last one stands for the place before the text, index -1, and stays 0
    before = [-1] * n  # previous smaller suffix
    new = len(symbols)

    def put_above(h: int) -> None:
        """The next group stands directly above h."""
        a = upper[h]
        lower.append(h)
        upper.append(a)
        upper[h] = lower[a] = new

    g, end = len(symbols) - 1, n
    while g >= 0:
        own = members[g]
        if type(own) is int:
            if group[own] == g:
                end -= 1
                begins.append((g, end))
                done[own] = 1
                j = own - 1
                while done[j]:
                    j = before[j]
                before[own] = j
                if j >= 0:
                    put_above(group[j])
                    members.append(j)
                    group[j] = new
                    new += 1
            g = lower[g]
            continue
        own = sorted(i for i in own if group[i] == g)
        members[g] = 0
        end -= len(own)
        begins.append((g, end))
        for i in own:
            done[i] = 1
        found: dict[int, int] = {}
        for i in own:
            j = i - 1
            while done[j]:
                j = before[j]
            before[i] = j
            if j >= 0:
                found[j] = found.get(j, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for j, k in found.items():
            moves.setdefault((k, group[j]), []).append(j)
        for k, h in sorted(moves, reverse=True):  # smaller counts then come between
            put_above(h)
            moved = moves[k, h]
            members.append(moved if len(moved) > 1 else moved[0])
            for j in moved:
                group[j] = new
            new += 1
        g = lower[g]

    place = [0] * new
    for g, begin in begins:
        place[g] = begin
    order, put = [0] * n, bytearray(n + 1)
    put[n] = 1  # index -1
    j, r = n - 1, 0  # the empty suffix comes first of all
    while True:
        while not put[j]:
            g = group[j]
            order[place[g]] = j
            place[g] += 1
            put[j] = 1
            j = before[j]
        if r == n:
            return order
        j, r = order[r] - 1, r + 1
