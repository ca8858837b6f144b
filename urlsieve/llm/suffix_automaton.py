"""Suffix automata over small alphabets as dense tables, and the cross-parsing of many texts at once."""

from __future__ import annotations

import numpy as np


def automaton(text: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Transitions (state, symbol, next state) and number of states of the smallest automaton that reads exactly the
    substrings of `text`. State 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                link[q] = link[cur] = twin
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
        last = cur
    at = np.repeat(np.arange(len(step), dtype=np.int32), [len(s) for s in step])
    symbol = np.fromiter((c for s in step for c in s), np.uint8, len(at))
    to = np.fromiter((x for s in step for x in s.values()), np.int32, len(at))
    return at, symbol, to, len(step)


def table(at: np.ndarray, symbol: np.ndarray, to: np.ndarray, states: int, symbols: int) -> np.ndarray:
    """The automaton as one array, for `parse`: entry [state * (symbols + 1) + symbol].

    An entry is the next state times symbols + 1. Where there is none, a phrase ends before the symbol, and the
    entry is -1 minus the value of the state that the symbol opens the next phrase with. One state more stands
    for a phrase of one unknown symbol; nothing continues it. The last symbol stands for the end of a text: it
    stays in its state.
    """
    wide = symbols + 1
    opens = np.full(wide, states * wide, np.int32)
    first = at == 0
    opens[symbol[first]] = to[first] * wide
    out = np.tile(-1 - opens, (states + 1, 1))
    out[0] = opens
    out[at, symbol] = to * np.int32(wide)
    out[:, symbols] = np.arange(states + 1, dtype=np.int32) * wide
    return out.reshape(-1)


def parse(tables: list[np.ndarray], blocks: np.ndarray) -> np.ndarray:
    """Number of phrases of each row of `blocks` (symbols) against each table: phrases are the longest matches,
    one after another; a symbol that the automaton does not know is a phrase of its own. Shape (tables, rows)."""
    symbols = np.ascontiguousarray(blocks.T.astype(np.int32))
    count = np.zeros((len(tables), blocks.shape[0]), np.int64)
    for i, t in enumerate(tables):
        state = np.zeros(blocks.shape[0], np.int32)
        ended = np.zeros(blocks.shape[0], np.int32)
        for column in symbols:
            state += column
            state = t[state]
            sign = state >> 31
            ended -= sign
            state ^= sign
        count[i] = ended + 1
    return count
