"""T-occurrence search inside one block of shingle sets (DivideSkip), as numpy over inverted lists."""

from __future__ import annotations

import numpy as np


def required(n, m, percent: int):
    """Smallest intersection with 100 * i >= percent * (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def block_links(sets: list[np.ndarray], label: list[int], visitor: list[bool], percent: int) -> list[tuple[int, int]]:
    """Links (i, j) that join the block: afterwards two sets of the block are in one group exactly when a chain of
    links of the block, or of equal labels, connects them. Pairs of visitors are not looked at.

    Sets are taken by size. Each looks in the inverted lists of the smaller ones, cut to the sizes that can reach
    `percent`. A partner needs T shared shingles, so one that reaches T stands at least T - L times in all but the
    L longest lists: those are merged, the L longest only probed by binary search for the candidates. A candidate
    already in the group of the set is skipped, so a group of near copies costs one hit a member.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    size = size[order]
    by_size = [sets[i] for i in order]
    label = [label[i] for i in order]
    visitor = np.array([visitor[i] for i in order], bool)
    tokens = np.concatenate(by_size) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n, dtype=np.int32), size)
    at = np.argsort(tokens, kind="stable")
    st, so = tokens[at], owner[at]
    first = np.flatnonzero(np.concatenate(([True], st[1:] != st[:-1]))) if len(st) else np.zeros(0, np.int64)
    length = np.diff(np.append(first, len(st)))
    list_of = np.empty(len(st), np.int64)
    list_of[at] = np.repeat(np.arange(len(first)), length)
    pointer = np.concatenate(([0], np.cumsum(size)))
    shared = np.add.reduceat((length[list_of] > 1).astype(np.int64), pointer[:-1][size > 0]) if len(st) else []
    count = np.zeros(n, np.int64)
    count[size > 0] = shared
    least = -(-percent * size // 100)  # smallest size of a partner, and the overlap it needs at least

    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    known: dict[int, int] = {}
    for i, x in enumerate(label):
        j = known.setdefault(x, i)
        parent[root(i)] = root(j)
    found = []
    for q in np.flatnonzero((size > 0) & (count >= least)).tolist():
        lo = int(np.searchsorted(size, least[q]))
        if lo >= q:
            continue
        mine = list_of[pointer[q]:pointer[q + 1]]
        mine = mine[length[mine] > 1]
        mine = mine[np.argsort(length[mine], kind="stable")]
        t = int(required(size[q], size[lo], percent))
        longest = int(length[mine[-1]])
        skip = min(t - 1, int(t / (0.01 * np.log2(longest) + 1)), max(0, len(mine) - 1))
        short, long = mine[:len(mine) - skip], tokens_of(st, first, mine[len(mine) - skip:])
        merged = np.concatenate([so[first[x]:first[x] + length[x]] for x in short.tolist()])
        merged = merged[(merged >= lo) & (merged < q)]
        if not len(merged):
            continue
        times = np.bincount(merged - lo)
        candidate = np.flatnonzero(times >= max(1, t - skip)) + lo
        for c in candidate[np.argsort(-times[candidate - lo], kind="stable")].tolist():
            if visitor[q] and visitor[c] or root(c) == root(q):
                continue
            need = int(required(size[q], size[c], percent))
            have = int(times[c - lo])
            if have + skip < need:
                continue
            if have < need and skip:
                place = np.searchsorted(by_size[c], long)
                place[place == len(by_size[c])] = 0
                have += int((by_size[c][place] == long).sum())
            if have >= need:
                found.append((int(order[q]), int(order[c])))
                parent[root(q)] = root(c)
    return found


def tokens_of(tokens: np.ndarray, first: np.ndarray, lists: np.ndarray) -> np.ndarray:
    return tokens[first[lists]]
