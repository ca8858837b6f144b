"""LSH forest: components against a comparison of all pairs, alone and with hot regions, small blocks and few trees."""

import random
import re

import numpy as np
import pytest

from urlsieve.llm import lsh_forest as D
from urlsieve.llm import queries as Q

SCHEMA = "doc_id long, text string"


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def contract(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) * 100 >= percent * max(len(sets[i]), len(sets[j])) \
                    and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(least.get(root(i), key), key)
    out = [(key, len(s), least.get(root(i)) if s else key) for i, ((key, _), s) in enumerate(zip(rows, sets))]
    return sorted(((*r, r[0] == r[2]) for r in out), key=repr)


def found(spark, rows):
    d = D.forest_dedup(spark.createDataFrame(rows, SCHEMA))
    return sorted((tuple(r) for r in d.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def corpus(seed, families=30, members=6, hot=0, passage=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    shared = [rng.choice(words) for _ in range(passage)]
    texts = []
    for f in range(families):
        base = [rng.choice(words) for _ in range(rng.randint(30, 250))]
        base = shared + base if passage and f % 2 else base
        for _ in range(hot if f == 0 else members):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, len(w) // 60, len(w) // 30])):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_families_a_hot_family_and_a_shared_passage(spark):
    rows = corpus(1, hot=150, passage=60)
    assert found(spark, rows) == contract(rows)


def test_regions_alone_and_divided_give_the_same(spark, monkeypatch):
    rows = corpus(2, families=25, hot=60, passage=120)
    want = contract(rows)
    monkeypatch.setattr(D, "BLOCK_SHINGLES", 2000)  # hot groups are many blocks
    assert found(spark, rows) == want
    monkeypatch.setattr(D, "_neighbours", lambda posts, *trees: NEIGHBOURS(posts.filter("false"), *trees))
    monkeypatch.setattr(D, "ROUNDS", (1,))
    monkeypatch.setattr(D, "CROWDED", 3)  # regions are taken apart by longer signatures
    assert found(spark, rows) == want


NEIGHBOURS = D._neighbours


def test_defined_results(spark):
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one\ttwo"), (6, "one two three"), (None, "one two"), (None, None),
            (7, long), (8, long + " end"), (None, long), (9, "ÄÖ x"), (10, "äö x"), (None, "alone here"), (4, "One two"), (4, "other")]
    assert found(spark, rows) == contract(rows)
    assert found(spark, []) == []
    clash = spark.createDataFrame([(1, "a b", 3, "x"), (2, "A b", 4, "y")], "doc_id long, text string, n int, forest string")
    assert sorted((r.doc_id, r.component_id, r.kept) for r in D.forest_dedup(clash).collect()) == [(1, 1, True), (2, 1, False)]


def test_signatures_agree_as_often_as_the_sets(spark):
    rng = np.random.default_rng(3)
    factors = rng.integers(0, 1 << 32, 2400, dtype=np.uint32) | np.uint32(1)
    shifts = rng.integers(0, 1 << 32, 2400, dtype=np.uint32)
    for similarity in (0.5, 0.85):
        both = int(2000 * similarity / (1 + similarity))
        x = rng.integers(0, 1 << 63, 2000 - both, dtype=np.uint64)
        a, b = x[:1000], x[1000 - both:]
        sa, sb = (np.frombuffer(D.signatures(s, factors, shifts), ">u2") for s in (a, b))
        assert abs((sa == sb).mean() - similarity) < 0.04


def test_small_tables_against_the_contract(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = Q.op13_lsh_forest(spark, sf)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == contract(rows)
