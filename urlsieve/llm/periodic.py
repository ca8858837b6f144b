"""Periodic runs of words: string synchronising sets propose periods, which are then measured word by word."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_buffers, text_runs
from .shingles import mix

DIRECT = 7  # periods up to here are found by comparing the words with their own shift
FIRST_SCALE = 4  # 2 * FIRST_SCALE is the first period that is not
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)
_JOIN = np.uint64(0xA0761D6478BD642F)


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of the windows made of a left and a right window."""
    return mix(left * _JOIN + right + np.uint64(1))


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of x[i:i + width] for every i where the window fits."""
    blocks = -(-len(x) // width)
    grid = np.full(blocks * width, NEVER, np.uint64)
    grid[:len(x)] = x
    grid = grid.reshape(blocks, width)
    up_to = np.minimum.accumulate(grid, axis=1).reshape(-1)
    since = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    n = len(x) - width + 1
    return np.minimum(since[:n], up_to[width - 1:width - 1 + n])


def _mismatch(a: np.ndarray, b: np.ndarray) -> int:
    """First position where `a` and `b` differ, or their length."""
    at, size = 0, 64
    while at < len(a):
        differ = np.flatnonzero(a[at:at + size] != b[at:at + size])
        if len(differ):
            return at + int(differ[0])
        at, size = at + size, size * 2
    return len(a)


def _extended(x: np.ndarray, s: int, d: int) -> tuple[int, int]:
    """The longest stretch [start, end) around s in which words d apart are equal."""
    right = s + _mismatch(x[s:len(x) - d], x[s + d:]) + d
    left = s - _mismatch(x[:s][::-1], x[d:s + d][::-1])
    return left, right


def synchronising_set(windows: np.ndarray, periodic: np.ndarray, tau: int) -> np.ndarray:
    """Positions whose choice depends on the next 2 * tau symbols alone: the least hash among the windows of `tau`
    symbols that begin from i to i + tau stands at one of both ends. Windows marked `periodic` (a period of at most
    tau / 3) take no part, so the set is sparse; any tau successive positions hold a member unless such a region
    covers them."""
    value = np.where(periodic, NEVER, windows)
    least = _sliding_least(value, tau + 1)
    n = len(least)
    return np.flatnonzero((least != NEVER) & ((value[:n] == least) | (value[tau:tau + n] == least)))


def cubic_runs(x: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of every stretch of `x` that repeats its smallest period three times or more and cannot
    be extended. No run is longer than `longest`.

    Periods up to DIRECT come from comparing `x` with its shift. At scale tau, periods q from 2 tau to 4 tau are
    proposed: a member s of the synchronising set, and s + q one period on, see the same context, so equal contexts
    of successive members give q. A context of 3 tau symbols serves q up to 3 tau, one of 4 tau the rest: either
    holds a whole period, so nothing nearer is equal, and is short enough that three periods hold both ends. The
    regions of small period that a scale leaves out are the runs of the scales before it. Every proposal is measured
    on the symbols, so a clash of hashes makes no false run.
    """
    found: list[tuple[int, int, int]] = []
    seen: set[tuple[int, int]] = set()
    for q in range(1, min(DIRECT, longest // 3) + 1):
        edge = np.diff(np.concatenate(([0], (x[q:] == x[:-q]).astype(np.int8), [0])))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + q
        long = ends - starts >= 3 * q
        for a, b in zip(starts[long].tolist(), ends[long].tolist()):
            if (a, b) not in seen:  # else a smaller period has the same stretch
                seen.add((a, b))
                found.append((a, b, q))
    if longest < 6 * FIRST_SCALE:
        return found
    hashes, width = mix(x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 1
    while width < FIRST_SCALE:
        hashes, width = _joined(hashes[:-width], hashes[width:]), 2 * width
    tau = FIRST_SCALE
    while 6 * tau <= longest:
        double = _joined(hashes[:-tau], hashes[tau:])
        step = np.zeros(len(hashes) + 1, np.int32)
        for a, b, q in found:
            if 3 * q <= tau <= b - a:
                step[a] += 1
                step[b - tau + 1] -= 1
        chosen = synchronising_set(hashes, np.cumsum(step[:-1]) > 0, tau)
        for context, tail in ((3 * tau, hashes), (4 * tau, double)):
            s = chosen[chosen + context <= len(x)]
            see = _joined(double[s], tail[s + 2 * tau])
            order = np.argsort(see, kind="stable")
            s, see = s[order], see[order]
            d = s[1:] - s[:-1]
            take = (see[1:] == see[:-1]) & (d >= 2 * tau) & (d <= 4 * tau)
            s, d = s[:-1][take], d[take]
            order = np.lexsort((s, d))
            s, d = s[order], d[order]
            i = 0
            while i < len(s):
                q = int(d[i])
                a, b = _extended(x, int(s[i]), q)
                if b - a >= 3 * q and (a, b) not in seen:
                    seen.add((a, b))
                    found.append((a, b, q))
                same = int(np.searchsorted(d, q, "right"))
                i = min(same, max(i + 1, i + int(np.searchsorted(s[i:same], b - q))))
        hashes, tau = double, 2 * tau
    return found


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers of all texts, each followed by a number of its own; first position of each text)."""
    first = np.concatenate(([0], np.cumsum([len(w) + 1 for w in texts])))
    x, names, numbers = np.empty(first[-1], np.int64), {}, count()
    for i, words in enumerate(texts):
        x[first[i]:first[i + 1] - 1] = np.fromiter((names.setdefault(w, n) for w, n in zip(words, numbers)), np.int64, len(words))
    x[first[1:] - 1] = -1 - np.arange(len(texts))
    return x, first


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 24) -> DataFrame:
    """For every row of `docs`: key, n_words, runs (array of start, length, period, by start, then period), and
    collapsed: the words that stand in no run after its first period, joined by one space.

    Words are what stands between the six ASCII blanks. A run is a stretch of words with smallest period q (words q
    apart are equal) of at least 3 q and at least `least` words that no neighbouring word extends. All runs are found,
    in time about linear in the words for each doubling of the period. Texts are read whole, many short ones or one
    long one at once. Null or empty text: no words, no runs, collapsed empty. Repeated rows give repeated results,
    null keys stay, an empty table gives an empty one, other columns are not looked at.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for i, j in text_runs(offsets):
                off = offsets[i:j + 1].tolist()
                texts = [data[a:b].tobytes().split() for a, b in zip(off, off[1:])]  # bytes split at ASCII blanks only
                x, first = _numbered(texts)
                of: dict[int, list] = {}
                for a, b, q in cubic_runs(x, max(map(len, texts))):
                    if b - a >= least:
                        t = int(np.searchsorted(first, a, "right")) - 1
                        of.setdefault(t, []).append((a - int(first[t]), b - a, q))
                runs = [sorted(of.get(t, []), key=lambda r: (r[0], r[2])) for t in range(len(texts))]
                flat = [r for each in runs for r in each]
                yield pa.RecordBatch.from_arrays([
                    batch.column("key").slice(i, j - i), pa.array([len(w) for w in texts], pa.int64()),
                    pa.ListArray.from_arrays(
                        pa.array(np.concatenate(([0], np.cumsum([len(r) for r in runs]))), pa.int32()),
                        pa.StructArray.from_arrays([pa.array([r[k] for r in flat], pa.int64()) for k in range(3)], fields=list(run))),
                    pa.array([b" ".join(_kept(w, r)) for w, r in zip(texts, runs)], pa.binary())],
                    ["key", "n_words", "runs", "collapsed"])

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        find, f"key {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return found.select(F.col("key").alias(key), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    if not runs:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]


def best_run(runs):
    """Of an array of runs the one with the greatest length / period: the first of equals. Null for none."""
    better = lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b)
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.reduce(runs, none, better)
