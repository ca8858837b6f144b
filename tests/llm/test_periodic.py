"""Periodic runs: all runs against brute force, and the registered query against a plain reading of its contract."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from urlsieve.llm import periodic as R
from urlsieve.llm import queries as Q


def every_run(x):
    """(start, end, smallest period) of all maximal stretches with three periods or more."""
    out = {}
    for q in range(1, len(x) // 3 + 1):
        i = 0
        while i < len(x) - q:
            j = i
            while j < len(x) - q and x[j] == x[j + q]:
                j += 1
            if j + q - i >= 3 * q:
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return {(a, b, q) for (a, b), q in out.items()}


def repetitive(rng, size):
    x = []
    while len(x) < size:
        if rng.random() < 0.5:
            unit = [rng.randrange(rng.choice([2, 3, 50])) for _ in range(rng.randint(1, rng.choice([3, 10, 60, 150])))]
            if rng.random() < 0.4:
                unit = [0] * rng.randint(1, 60) + unit
            x += (unit * 6)[:rng.randint(1, 6 * len(unit))]
        else:
            x += [rng.randrange(rng.choice([1, 2, 4, 100])) for _ in range(rng.randint(1, 40))]
    return x


@pytest.mark.parametrize("seed", range(4))
def test_all_runs_are_found(seed):
    rng = random.Random(seed)
    for _ in range(150):
        x = repetitive(rng, rng.choice([3, 30, 100, 300, 600]))
        assert set(R.cubic_runs(np.array(x), len(x))) == every_run(x)


def test_words_that_repeat_at_every_scale():
    a, b = [0], [0, 1]
    while len(b) < 800:  # many nested repetitions, none of them cubed but a few
        a, b = b, b + a
    thue = [bin(i).count("1") % 2 for i in range(1024)]  # no cube at all
    for x in (b, thue, b + thue, [0] * 500 + b, thue[:300] * 4):
        assert set(R.cubic_runs(np.array(x), len(x))) == every_run(x)
    assert R.cubic_runs(np.array(thue), len(thue)) == []


def test_long_inputs_take_linear_time():
    rng = np.random.default_rng(5)
    start = time.process_time()
    assert R.cubic_runs(np.zeros(400_000, np.int64), 400_000) == [(0, 400_000, 1)]
    assert R.cubic_runs(np.tile(rng.permutation(1000), 400), 400_000) == [(0, 400_000, 1000)]
    assert R.cubic_runs(rng.integers(0, 100_000, 400_000), 400_000) == []
    assert time.process_time() - start < 20


def contract(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = sorted(((a, b - a, q) for a, b, q in every_run(w) if b - a >= 24), key=lambda r: (r[0], r[2]))
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-(r[1] / r[2]), r[0], r[2])) if runs else (None,) * 3
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def query(spark, folder, monkeypatch, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, runs string, `key` int")
    monkeypatch.setattr(Q, "table", lambda *_: frame)
    return sorted((tuple(r) for r in Q.op11_periodic_runs(spark, "").collect()), key=repr)


def test_query_keeps_its_contract(spark, monkeypatch):
    rng = random.Random(8)
    texts = [None, "", " \n\t", "one", "  \x1c  x", "a " * 23, "a " * 24, "A a " * 40, "x\x0by\x0cz\r" * 30]
    texts += [" ".join(f"w{v}" for v in repetitive(rng, rng.choice([5, 60, 200]))) for _ in range(150)]
    rows = [(i, t, "r", 1) for i, t in enumerate(texts)] + [(None, "b " * 30, "r", 1), (3, "one", "r", 1)]
    got = query(spark, "", monkeypatch, rows)
    assert got == sorted((contract(i, t) for i, t, _, _ in rows), key=repr)
    assert query(spark, "", monkeypatch, []) == []


def test_operator_gives_runs_and_kept_words(spark):
    docs = spark.createDataFrame([("k", "go " + "a b c " * 10 + "end", 5)], "id string, body string, runs int")
    r = R.periodic_runs(docs, "id", "body").first()
    assert (r.id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) == ("k", 32, [(1, 30, 3)], "go a b c end")
    assert R.periodic_runs(docs, "id", "body", least=31).first().runs == []


def test_one_long_text(spark):
    text = "x y z " * 400_000 + "end"
    r = R.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(x) for x in r.runs] == [(0, 1_200_000, 3)] and r.collapsed == "x y z end"


def test_small_tables_against_the_contract(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    short = [(d.doc_id, d.text) for d in docs if len(d.text or "") < 4000]
    got = {r.doc_id: tuple(r) for r in Q.op11_periodic_runs(spark, sf).collect()}
    assert len(got) == len(docs)
    assert all(got[i] == contract(i, t) for i, t in short)
