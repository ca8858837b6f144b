"""Operators in DataFrame functions: decontamination, shards, mixture, tool calls."""

import hashlib
import json
import re
import zlib

import pytest
from pyspark.sql import functions as F

from urlsieve.llm import curriculum as C
from urlsieve.llm import queries as Q
from urlsieve.llm import sharding as S
from urlsieve.llm import tool_calls as H
from urlsieve.llm import winnowing as N

DOCS = "doc_id long, text string"


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contamination(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[s:s + 10]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, seen = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for s in range(len(w) - size + 1):
                if tuple(w[s:s + size]) in windows:
                    hit |= set(range(s, s + size))
                    seen |= {str(x) for x in windows[tuple(w[s:s + size])] if x is not None}
        out.append((repr(i), len(w), len(hit), len(seen), hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_decontamination(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    long = items[0][1]
    items += [(900, "THE that, of"), (901, "erea"), (902, ""), (903, None), (904, "?!"), (900, "THE that, of"), (905, long),
              (None, "only here without id")]
    docs += [(None, "x " + long), (-1, None), (-2, ""), (-3, "the " * 40), (-4, f"{long} {long}"), (-4, f"{long} {long}"),
             (-5, " ".join(words(long)[:9])), (-6, "y " * 100_000 + long), (-4, "other text"), (-7, "only here without id")]
    d = N.decontaminate(spark.createDataFrame(docs, DOCS).withColumn("words", F.lit(1)),
                        spark.createDataFrame(items, "item_id long, text string"))
    got = sorted((repr(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in d.collect())
    assert got == contamination(docs, items)


def test_decontamination_of_empty_tables(spark):
    none, some = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c")], DOCS)
    assert [r.n_hit for r in N.decontaminate(docs, none).collect()] == [0]
    assert [r.n_hit for r in N.decontaminate(docs, some).collect()] == [2]
    assert N.decontaminate(docs.limit(0), some).count() == 0


def check_shards(rows, docs, shards):
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows) == sorted(
        (i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    total, per = sum(r["size"] for r in rows), {}
    for r in rows:
        per.setdefault(r["shard"], []).append(r)
    for x in per.values():
        assert sorted(r["slot"] for r in x) == list(range(len(x)))
    return [sum(r["size"] for r in per.get(s, [])) * shards / max(total, 1) for s in range(shards)], per


@pytest.mark.parametrize("range_rows", [S.RANGE_ROWS, 40])
def test_shards(spark, monkeypatch, range_rows):
    monkeypatch.setattr(S, "RANGE_ROWS", range_rows)
    docs = [(i, f"text {i * 7919 % 1000} " * (i % 17)) for i in range(1500)] + [(5000 + i, "hot text") for i in range(900)]
    docs += [(1, "again"), (1, "again"), (None, "no key"), (9, None)]
    d = S.shard(spark.createDataFrame(docs, DOCS))
    loads, per = check_shards(d.collect(), docs, 8)
    assert max(loads) < 1.1 and min(loads) > 0.9
    if range_rows == S.RANGE_ROWS:  # small groups of equal texts stay together
        text_of = dict(docs)
        where = {}
        for s, rows in per.items():
            for r in rows:
                where.setdefault(text_of[r["doc_id"]], set()).add(s)
        assert sum(len(v) > 1 for k, v in where.items() if k != "hot text") <= 12


def test_shards_of_few_rows_and_kept_columns(spark):
    assert S.shard(spark.createDataFrame([], DOCS)).count() == 0
    d = spark.createDataFrame([(1, "a", 7, "s")], "doc_id long, text string, shard int, source string")
    r = S.shard(d, keep=("text", "shard", "source")).first()
    assert (r.text, r.source, r.slot, r.law) == ("a", "s", 0, "bytes") and "grown_shard" in r


def water(sizes, weights=(5.0, 2.0, 1.0), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(most * sizes[s] for s in full)
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = {s for s in rest if share[s] > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in full else share[s] for s in names}
        full |= over


def test_mixture(spark):
    docs = [(i, "w " * (i % 23), f"s{i % 7}") for i in range(700)] + [(1000 + i, "w " * 40, "big") for i in range(300)]
    docs += [(2000, "one two", None), (2001, None, None), (2002, "tiny", "z"), (7, "w w", "s0"), (7, "w w", "s0"), (None, "a b c", "s1"),
             (2003, "w\tw\x0bw\x1cw", "only"), (2004, None, "empty")]
    d = C.curriculum(spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("order", F.lit(1)))
    rows = d.collect()
    assert len(rows) == len(docs)
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, taken = water(sizes), {}
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r["size"] and len(r.positions) == (-(-r.taken // r["size"]) if r.taken else 0)
        assert all(0 <= p <= 1 for p in r.positions)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sorted(map(str, d.collect())) == sorted(map(str, rows))
    passes = C.training_order(d, 4).collect()
    assert len(passes) == sum(len(r.positions) for r in rows)
    # a schedule that falls puts most of its words early, one that rises late
    early = lambda s: sum(p < 0.5 for r in rows if r.source == s for p in r.positions) / sum(
        len(r.positions) for r in rows if r.source == s)
    kinds = {s: i % 3 for i, s in enumerate(sorted(s for s in sizes if s is not None))}
    falls, rises = (next(s for s in kinds if kinds[s] == k and sizes[s] > 300) for k in (0, 2))
    assert early(falls) > 0.55 and early(rises) < 0.45
    assert C.curriculum(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_training_steps_come_from_the_order(spark):
    """Steps count the written passes of all range partitions; rows that are not taken have none."""
    docs = [(i, "w " * (i % 7), f"s{i % 4}") for i in range(200)] + [(5, "w", "s0"), (5, "w", "s0"), (None, None, None)]
    d = C.curriculum(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    got = C.training_steps(d, 5, ("source", "doc_id", "text_hash")).collect()
    assert len(got) == len(docs) and "first_step" in got[0].asDict()
    every = sorted((p, r.source, r.doc_id, r.text_hash) for r in d.collect() for p in r.positions)
    first = {}
    for i, (_, *row) in enumerate(every):
        first.setdefault(tuple(row), i)
    for r in got:
        assert r.passes == len(r.positions)
        if r.doc_id == 5 and r["size"] == 1 and r.source == "s0":
            continue  # equal rows
        assert r.first_step == first.get((r.source, r.doc_id, r.text_hash))
        assert r.first_position == (min(r.positions) if r.positions else None)
    assert C.training_steps(d.limit(0), 5).count() == 0


CHATS = "conv_id long, turn long, role string, text string"


def test_tool_calls(spark):
    call = lambda i, name, arguments, needs=(): {"id": i, "name": name, "arguments": arguments, "needs": list(needs)}
    turns = [
        (1, 0, "assistant", json.dumps({"tool_calls": [
            call("b", "search", {"query": "x", "limit": 5}, ["a"]), call("a", "lookup", {"fields": [1], "key": "k"}),
            call("c", "translate", {"text": "é", "target": "xx"}, ["b", "a"]), call("d", "calculate", {"expression": 3, "unit": 1}),
            call("e", "nothing", {}), call("f", "search", {"query": "x"}, ["zz"])]})),
        (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": "first"})),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "second"})),
        (1, 3, "tool", json.dumps({"tool_call_id": "q", "content": "whose?"})),
        (2, 0, "assistant", json.dumps({"tool_calls": [call("x", "calculate", {"expression": "1", "precision": 99}, ["y"]),
                                                       call("y", "calculate", {"expression": "2"}, ["x"]),
                                                       call("z", "calculate", "[1]")]})),
        (3, 0, "assistant", "{not json"), (3, 1, "assistant", None), (3, 2, "user", "plain"), (None, 0, None, None),
    ]
    chats = spark.createDataFrame(turns, CHATS)
    rows = {(r.conv_id, r.call_id): r for r in H.link(H.written_calls(chats), H.written_results(chats)).collect()}
    assert set(rows) == {(1, c) for c in "abcdefq"} | {(2, c) for c in "xyz"}
    assert {c: rows[1, c].level for c in "abcdefq"} == {"a": 0, "b": 1, "c": 2, "d": 0, "e": 0, "f": 0, "q": None}
    assert {c: rows[2, c].level for c in "xyz"} == {"x": None, "y": None, "z": 0}
    assert rows[1, "a"].valid and rows[1, "a"].n_results == 2
    assert rows[1, "a"].json == '{"arguments":{"fields":[1],"key":"k"},"id":"a","name":"lookup","needs":[],"result":"first"}'
    assert rows[1, "b"].errors == "no result"
    assert rows[1, "c"].errors == "target not a choice; no result"
    assert rows[1, "d"].errors == "type of expression; unknown unit; no result"
    assert rows[1, "e"].errors == "unknown tool; no result"
    assert rows[1, "f"].errors == "missing limit; unknown need zz; no result"
    assert rows[1, "q"].errors == "no call" and rows[1, "q"].json is None
    assert rows[2, "x"].errors == "precision too large; cycle; no result"
    assert rows[2, "z"].errors == "arguments are not an object; no result"
    assert H.link(H.written_calls(chats.limit(0)), H.written_results(chats.limit(0))).count() == 0


def test_tool_calls_of_all_chats(spark, sf):
    chats = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    name = lambda c, t: "call_" + hashlib.md5(f"{c}/{t}".encode()).hexdigest()[:16]
    calls = {(c, name(c, t)): (t, text or "") for c, t, role, text in chats if role == "user"}
    results = {(c, name(c, t - 1)): text for c, t, role, text in chats if role == "assistant"}
    needs = {}
    for (c, i), (t, text) in calls.items():
        digit = int(hashlib.md5(f"{c}:{t}:{text}".encode()).hexdigest()[5], 16)
        needs[c, i] = [name(c, t - k) for k, most in ((2, 8), (4, 4)) if digit < most and t >= k]

    def level(key):
        return 1 + max((level((key[0], n)) for n in needs[key] if (key[0], n) in calls), default=-1)

    rows = Q.op7_tool_calls(spark, sf).collect()
    assert {(r.conv_id, r.call_id) for r in rows} == set(calls) | set(results)
    for r in rows:
        key = (r.conv_id, r.call_id)
        assert r.linked == (key in calls and key in results)
        if key in calls:
            assert r.level == level(key)
            whole = json.loads(r.json)
            assert r.json == json.dumps(whole, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            assert whole.get("result") == results.get(key) and whole["needs"] == sorted(needs[key])


def test_levels_of_a_long_chain_are_one_table(spark):
    rows = [(1, f"c{i}", [f"c{i - 1}"] if i else []) for i in range(6)] + [(1, "x", ["y"]), (1, "y", ["x"]), (None, "c0", ["gone"])]
    levels, _ = H._levels(spark.createDataFrame(rows, "conv_id long, call_id string, needs array<string>"))
    assert sorted(((r.conv_id or 0, r.call_id, r.level) for r in levels.collect())) == \
        [(0, "c0", 0)] + [(1, f"c{i}", i) for i in range(6)]
    assert "Union" not in levels._jdf.queryExecution().analyzed().toString()
