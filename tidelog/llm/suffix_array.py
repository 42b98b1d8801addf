"""Suffix arrays by linear grouping: suffixes are grouped by their longest Lyndon prefix, highest group first, then each group's order is read off.

Grouping. All suffixes start in groups by first symbol. Groups are processed in descending order. Each member i looks up its previous smaller
position p, the nearest one to the left in a group not yet processed; the Lyndon prefix of p reaches up to i and is extended by that of i.
Positions of one old group that were extended equally often move together into a new group right above the old one, more extensions higher.

Order. A suffix is its Lyndon prefix followed by the next smaller suffix, which stands earlier in the array. So one pass over the array from its start
puts, for every finished suffix, those that it follows into the next place of their groups. Nothing is renamed or sorted again.
"""

from __future__ import annotations

import numpy as np


def lyndon_groups(symbols: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(group of each position, length of its Lyndon prefix, the groups in ascending order).

    A group that would move as a whole stays where it is: nothing lies between its old place and its new one."""
    n = len(symbols)
    places: dict[int, list[int]] = {}
    for i, c in enumerate(symbols):
        if c in places:
            places[c].append(i)
        else:
            places[c] = [i]
    members = [places[c] for c in sorted(places)]
    count = [len(m) for m in members]
    group = [0] * n
    for g, own in enumerate(members):
        for i in own:
            group[i] = g
    above = [*range(1, len(members)), -1]
    below = list(range(-1, len(members) - 1))
    length, previous = [1] * n, [-1] * n
    done = bytearray(n + 1)  # the last place answers for position -1, which is never done

    def raise_(moved: list[int], base: int) -> int:
        """A new group of these right above the group `base`."""
        new, up = len(members), above[base]
        members.append(moved)
        count.append(len(moved))
        above.append(up)
        below.append(base)
        above[base] = new
        if up >= 0:
            below[up] = new
        for p in moved:
            group[p] = new
        return new

    g = len(members) - 1
    while g >= 0:
        own = members[g]
        if count[g] == 1:
            i = own[0]
            if len(own) > 1:
                i = next(x for x in own if group[x] == g)
            done[i] = 1
            p = i - 1
            while done[p]:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                length[p] = i + length[i] - p
                old = group[p]
                if count[old] > 1:
                    count[old] -= 1
                    raise_([p], old)
        elif count[g]:
            if len(own) > count[g]:
                own = [i for i in own if group[i] == g]
            for i in own:
                done[i] = 1
            times: dict[int, int] = {}
            for i in own:
                p = i - 1
                while done[p]:
                    p = previous[p]
                previous[i] = p
                if p >= 0:
                    times[p] = times.get(p, 0) + 1
                    length[p] = i + length[i] - p
            moves: dict[int, dict[int, list[int]]] = {}
            for p, k in times.items():
                old = group[p]
                if count[old] > 1:
                    if old in moves:
                        moves[old].setdefault(k, []).append(p)
                    else:
                        moves[old] = {k: [p]}
            for old, by_times in moves.items():
                if len(by_times) == 1:
                    moved = next(iter(by_times.values()))
                    if len(moved) < count[old]:
                        count[old] -= len(moved)
                        raise_(moved, old)
                else:
                    last = old
                    for k in sorted(by_times):
                        count[old] -= len(by_times[k])
                        last = raise_(by_times[k], last)
        g = below[g]
    order, g = [], 0
    while g >= 0:
        if count[g]:
            order.append(g)
        g = above[g]
    return group, length, order


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The start positions of all suffixes in ascending order; the end of the text is below every symbol."""
    n = len(symbols)
    if not n:
        return np.empty(0, np.int64)
    group, length, order = lyndon_groups(np.asarray(symbols).tolist())
    rank = np.empty(max(order) + 1, np.int64)
    rank[order] = np.arange(len(order))
    of = rank[np.array(group)]
    head = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(order)))[:-1]]).tolist()
    follows = np.arange(n) + np.array(length)
    children = np.argsort(follows, kind="stable")
    first = np.searchsorted(follows[children], np.arange(n + 2))
    # Most suffixes are followed by none or one: -1 for none, -2 for several.
    many = np.diff(first)
    one = np.where(many == 0, -1, np.where(many == 1, children[np.minimum(first[:-1], n - 1)], -2)).tolist()
    children, first, of = children.tolist(), first.tolist(), of.tolist()
    out, j = [-1] * n, n
    for k in range(-1, n):
        if k >= 0:
            j = out[k]
        i = one[j]
        if i >= 0:
            g = of[i]
            at = head[g]
            out[at] = i
            head[g] = at + 1
        elif i == -2:
            for i in children[first[j] : first[j + 1]]:
                g = of[i]
                out[head[g]] = i
                head[g] += 1
    return np.array(out, np.int64)


def window_classes(texts: list[bytes], width: int) -> list[np.ndarray]:
    """For each text, a class for every window of `width` bytes: equal windows anywhere, and only they, share a class."""
    body = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8).astype(np.int64) + 1
    sizes = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(sizes)
    body[ends - 1] = 0
    order = suffix_array(body)
    left = np.repeat(ends - 1, sizes) - np.arange(len(body))
    order = order[left[order] >= width]
    same = np.ones(max(len(order) - 1, 0), bool)
    for c in range(width):
        same &= body[order[:-1] + c] == body[order[1:] + c]
    classes = np.full(len(body), -1, np.int64)
    if len(order):
        classes[order] = np.concatenate([[0], np.cumsum(~same)])
    return [classes[e - s : max(e - s, e - width)] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
