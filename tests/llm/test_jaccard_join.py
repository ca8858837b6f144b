"""Jaccard join: the search in a block and the whole join against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from urlsieve.llm import components as C
from urlsieve.llm import jaccard_join as J
from urlsieve.llm.components import components
from urlsieve.llm.tsearch import block_links

SCHEMA = "doc_id long, text string"


def shingles(text, k=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def roots(n, edges):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(n)]


def expected(rows, k=3, percent=90):
    """(doc_id, n, component) by comparing all pairs of rows."""
    sets = [shingles(t, k) for _, t in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i)
             if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    of = roots(len(rows), edges)
    least = {}
    for (i, _), r in zip(rows, of):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, len(s), least.get(r) if s else i) for (i, _), s, r in zip(rows, sets, of)), key=repr)


def found(spark, rows, k=3, percent=90):
    d = J.jaccard_join(spark.createDataFrame(rows, SCHEMA), k=k, percent=percent)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in d.collect()), key=repr)


def corpus(seed, families, members, words, edits):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for f in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(*words))]
        if f % 3 == 0:
            base = passage + base
        for _ in range(members):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    return rows


def test_block_links_agree_with_all_pairs():
    rng = np.random.default_rng(1)
    for _ in range(40):
        sets = []
        for _ in range(rng.integers(1, 8)):
            base = rng.integers(0, 5000, size=rng.integers(1, 60)).astype(np.uint64)
            for _ in range(rng.integers(1, 15)):
                x = base.copy()
                k = rng.integers(0, max(1, len(x) // 8) + 1)
                x[rng.integers(0, len(x), k)] = rng.integers(0, 5000, k)
                sets.append(np.unique(x))
        visitor = [bool(v) for v in rng.random(len(sets)) < 0.3]
        for percent in (80, 90):
            links = block_links(sets, list(range(len(sets))), visitor, percent)
            edges = [(i, j) for i in range(len(sets)) for j in range(i) if not (visitor[i] and visitor[j])
                     and 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))]
            assert roots(len(sets), links) == roots(len(sets), edges)


@pytest.mark.parametrize("percent,k", [(90, 3), (80, 5)])
def test_join_agrees_with_all_pairs(spark, monkeypatch, percent, k):
    monkeypatch.setattr(J, "BLOCK_SHINGLES", 1500)  # many blocks, and groups that must be divided
    rows = corpus(percent, 12, 14, (30, 160), 6)
    assert found(spark, rows, k, percent) == expected(rows, k, percent)


def test_a_shingle_has_one_row_a_block(spark):
    rows = [(7, label, label % 2, 10 + label, label) for label in range(40)] + [(7, 5, 0, 99, 41), (8, 1, 1, 10, 1)]
    common, held = J._holders(spark.createDataFrame(rows, "token long, label long, block long, n long, class_id long"))
    assert {tuple(r) for r in common.collect()} == {(7, 5), (8, 1)}
    assert {tuple(r) for r in held.select("token", "block", "lo", "hi", "low", "high", "common_low", "common_high").collect()} == {
        (7, 0, 0, 38, 10, 99, 99, 99), (7, 1, 1, 39, 11, 49, 15, 15), (8, 1, 1, 1, 10, 10, 10, 10)}


def test_a_common_shingle_across_blocks_agrees_with_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_SHINGLES", 300)
    rng = random.Random(6)
    rows = []
    for f in range(60):
        base = [f"v{rng.randrange(300)}" for _ in range(24)] + ["the", "very", "common", "words"] * (f % 2)
        rows += [(len(rows) + i, " ".join(base[:-i] if i else base)) for i in range(2)]
    assert found(spark, rows) == expected(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE  two"), (8, "a b c"),
            (9, "a b c"), (9, "a b c"), (None, "a b c"), (None, "x y z"), (10, "é É ß"), (11, "É É ß"),
            (12, "word " * 50_000), (13, "word " * 49_000), (14, "a\x1cb c d"), (15, "x" * 100_000)]
    assert found(spark, rows) == expected(rows)


def test_empty_table_and_clashing_names(spark):
    assert found(spark, []) == []
    d = spark.createDataFrame([(1, "a b c", 5, 6), (2, "a b c", 7, 8)],
                              "doc_id long, text string, class_id int, key int")
    assert {(r.doc_id, r.component_id, r.keeper) for r in J.jaccard_join(d).collect()} == {(1, 1, True), (2, 1, False)}


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (5, 5)]
    rows = spark.createDataFrame(chain, "a long, b long").orderBy(F.rand(3))
    want = {i: 0 for i in range(61)} | {100: 100, 101: 100, 103: 100}
    assert {r.node: r.root for r in components(rows).collect()} == want
    assert components(rows.limit(0)).count() == 0


def test_prefixes_are_written_with_sets_and_classes_only(spark, monkeypatch):
    real, seen = J.written, {}
    monkeypatch.setattr(J, "written", lambda df, name, *more: seen.setdefault(name, df.columns) and real(df, name, *more))
    words = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(words)), (2, " ".join(words + ["x"])), (3, "a b c d"), (4, None)]
    found = {r.doc_id: r.component_id for r in J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4}
    assert sorted(n for n, columns in seen.items() if "prefix" in columns) == ["classes", "sets"]


def test_stars_need_one_step_and_no_links_none(spark, monkeypatch):
    real, steps = C.written, []
    monkeypatch.setattr(C, "written", lambda df, name, *more: steps.append(name) or real(df, name, *more))
    star = spark.createDataFrame([(1, i) for i in range(2, 9)] + [(20, 21)], "a long, b long")
    assert {r.node: r.root for r in C.components(star).collect()} == {i: 1 for i in range(1, 9)} | {20: 20, 21: 20}
    assert len(steps) == 2  # the links, and one step
    assert C.components(star.limit(0)).count() == 0
    assert len(steps) == 4


def test_second_links_alone_make_the_last_components(spark, monkeypatch):
    given, real = [], J.components
    monkeypatch.setattr(J, "components", lambda links, *more: given.append(links) or real(links, *more))
    monkeypatch.setattr(J, "BLOCK_SHINGLES", 200)
    rows = corpus(4, 6, 5, (20, 60), 2)
    assert found(spark, rows) == expected(rows)
    first, second = [{(r.a, r.b) for r in links.collect()} for links in given]
    assert first and not first & second


def test_the_sketch_is_two_bytes_a_cell(spark):
    texts = spark.createDataFrame([("a b c d",), ("a b c e",), (None,)], "text string")
    sketch = J._sketch(texts, 3)
    assert sketch.dtype == np.uint16 and len(sketch) == 1 << J.CELL_BITS
    assert sorted(sketch[sketch > 0].tolist()) == [int(np.float32(n).view(np.uint32) >> 15) for n in (1, 1, 2)]
