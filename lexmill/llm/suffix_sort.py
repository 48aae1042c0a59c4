"""Suffix sorting by linear grouping, for many strings side by side.

Phase 1 groups suffixes by their Lyndon prefix. Groups are taken in descending order; each member
points to its previous smaller suffix, and the suffixes pointed to, whose prefixes the group's
prefix has thereby extended, move to a new group at the top of their own (those extended more
often, higher). Phase 2 emits the order: from the smallest suffix up, the suffix before it and
that one's chain of previous smaller ones take the next places of their groups. Nothing is renamed
and nothing recurses.

The strings are independent, so each step is taken for all of them at once in NumPy: per string
the work is that of the algorithm, and the steps are as many as the longest string's groups.
"""

from __future__ import annotations

import numpy as np


def suffix_arrays(text: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort the suffixes of strings text[offs[b]:offs[b+1]] of bytes, each by itself.

    Returns (start, order): the suffixes of string b, as positions in text, are order[start[b]:start[b+1]]."""
    n_blocks = len(offs) - 1
    size = np.diff(offs)
    # Each string has a stop before it, where previous-smaller chains end, and a least character after it.
    base = offs[:-1] + 2 * np.arange(n_blocks)
    total = int(offs[-1] + 2 * n_blocks)
    block = np.repeat(np.arange(n_blocks), size)
    char = np.zeros(total, np.int64)
    char[np.arange(len(text)) + 2 * block + 1] = text.astype(np.int64) + 1
    owner = np.repeat(np.arange(n_blocks), size + 2)
    stop = np.zeros(total, bool)
    stop[base] = True

    key = owner * 258 + char + 1
    key[base] = owner[base] * 258
    order = np.argsort(key, kind="stable")
    place = np.empty(total, np.int64)
    place[order] = np.arange(total)
    key = key[order]
    fresh = np.concatenate(([True], key[1:] != key[:-1]))
    heads = np.flatnonzero(fresh)
    group = np.empty(total, np.int64)
    group[order] = np.repeat(heads, np.diff(np.concatenate((heads, [total]))))
    width = np.zeros(total, np.int64)
    width[heads] = np.diff(np.concatenate((heads, [total])))
    group[base] = -1
    prev = np.arange(total) - 1
    prev[base] = base

    moved = np.zeros(total, bool)
    low, high = base + 1, base + size + 2
    while len(low):
        g = group[order[high - 1]]
        count = high - g
        ends = np.cumsum(count)
        slots = np.arange(ends[-1]) + np.repeat(g - ends + count, count)
        member = order[slots]
        level = np.repeat(g, count)
        back = prev[member]
        while True:
            again = np.flatnonzero(group[back] >= level)
            if not len(again):
                break
            prev[member] = back
            back[again] = prev[back[again]]
        prev[member] = back
        hit = back[~stop[back]]
        if len(hit):
            hit.sort()
            first = np.flatnonzero(np.concatenate(([True], hit[1:] != hit[:-1])))
            times = np.diff(np.concatenate((first, [len(hit)])))
            hit = hit[first]
            own = group[hit]
            by = np.argsort(own * (int(times.max()) + 1) + times, kind="stable")
            hit, own, times = hit[by], own[by], times[by]
            seg = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            held = np.diff(np.concatenate((seg, [len(hit)])))
            head = own[seg]
            floor = np.repeat(head + width[head] - held, held)
            target = floor + np.arange(len(hit)) - np.repeat(seg, held)
            old = place[hit]
            moved[hit] = True
            there = order[target]
            there = there[~moved[there]]
            moved[hit] = False
            left = old[old < floor]
            order[left] = there
            place[there] = left
            order[target] = hit
            place[hit] = target
            sub = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (times[1:] != times[:-1]))))
            each = np.diff(np.concatenate((sub, [len(hit)])))
            width[head] -= held
            width[target[sub]] = each
            group[hit] = np.repeat(target[sub], each)
        high = g
        going = high > low
        low, high = low[going], high[going]

    # Phase 2.
    result = np.zeros(total, np.int64)
    free = np.arange(total)
    done = stop.copy()
    last = base + size + 1
    result[base + 1] = last
    done[last] = True
    at, end = base + 1, base + size + 2
    j = last - 1
    while len(at):
        ready = ~done[j]
        k = j[ready]
        if len(k):
            g = group[k]
            slot = free[g]
            result[slot] = k
            free[g] = slot + 1
            done[k] = True
            j[ready] = prev[k]
        rest = np.flatnonzero(~ready)
        if len(rest):
            at[rest] += 1
            going = at < end
            if not going.all():
                at, end, j = at[going], end[going], j[going]
                rest = np.flatnonzero(~ready[going])
            j[rest] = result[at[rest]] - 1
    keep = np.ones(total, bool)
    keep[base] = keep[base + 1] = False
    at = result[keep]
    return offs, at - 2 * owner[at] - 1
