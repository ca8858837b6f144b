"""Copies of images, the pipeline, and the entry points."""

import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from urlsieve.llm import images as I

REPO = Path(__file__).resolve().parents[2]


def pages(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet")


def test_crops_turns_and_strangers(spark, sf):
    images = [I.draw_page(r.html) for r in pages(spark, sf).orderBy("page_id").collect()]
    images = [i for i in images if i.shape[0] >= 45]
    whole = I.features(images)
    assert all((a == I.features([i])[0]).all() for i, a in zip(images[:5], whole))
    links = lambda a, b: I.consensus(a, b)[0] >= max(I.LEAST_INLIERS, I.LEAST_SHARE * min(len(a), len(b)))
    crops = I.features([i[12:, 6:58] for i in images])
    turned = I.features([np.rot90(i).copy() for i in images])
    rng = random.Random(0)
    strangers = [rng.sample(range(len(images)), 2) for _ in range(100)]
    assert np.mean([links(a, b) for a, b in zip(whole, crops)]) >= 0.9
    assert np.mean([links(a, b) for a, b in zip(whole, turned)]) >= 0.9
    assert np.mean([links(whole[a], whole[b]) for a, b in strangers]) <= 0.05


def test_recall_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    noise = [rng.integers(100, 250, (60, 64)) for _ in range(25)]
    rows = []
    for k, base in enumerate(noise):
        for version in range(6):
            image = base[rng.integers(0, 8):, rng.integers(0, 6):].copy()
            y, x = rng.integers(0, 40, 2)
            image[y:y + 6, x:x + 6] = rng.integers(100, 250)
            rows.append((len(rows), k, "\n".join(",".join(map(str, r)) for r in image)))

    def read(text):
        return np.array([r.split(",") for r in text.split("\n")], np.uint8) if text else np.zeros((0, 1), np.uint8)

    read_ = lambda t: (__import__("numpy").array([r.split(",") for r in t.split("\n")], "u1")
                       if t else __import__("numpy").zeros((0, 1), "u1"))
    data = spark.createDataFrame([(i, t) for i, _, t in rows], "page_id long, html string")
    got = {r.page_id: r.copy_class for r in I.find_copies(data, draw=read_).collect()}
    f = I.features([read(t) for _, _, t in rows])
    pairs = [(i, j) for i in range(len(rows)) for j in range(i)
             if I.consensus(f[i], f[j])[0] >= max(I.LEAST_INLIERS, I.LEAST_SHARE * min(len(f[i]), len(f[j])))]
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.9 * len(pairs) > 100
    kind = {i: k for i, k, _ in rows}
    assert all(kind[i] == kind[c] for i, c in got.items())


def test_copies_that_share_one_or_two_entries(spark):
    def halves(f):
        return {(t, x) for bits in np.ascontiguousarray(f["bits"]).view("<u4").reshape(-1, 2).tolist() for t, x in enumerate(bits)}

    rows = []
    for seed in range(80):
        rng = np.random.default_rng(seed)
        base = rng.integers(100, 250, (12, 64))
        other = np.clip(base + rng.integers(-50, 51, base.shape), 100, 249)
        f = I.features([base, other])
        ids = [I.image_id(i.astype(np.uint8), g) for i, g in zip((base, other), f)]
        a, b = f if ids[0] < ids[1] else f[::-1]
        if 1 <= len(halves(a) & halves(b)) <= 2 and I.consensus(a, b)[0] >= max(I.LEAST_INLIERS, I.LEAST_SHARE * min(len(a), len(b))):
            rows = [(i, "\n".join(",".join(map(str, r)) for r in x)) for i, x in enumerate((base, other))]
            break
    read = lambda t: __import__("numpy").array([r.split(",") for r in t.split("\n")], "u1")
    assert len(rows) == 2
    got = I.find_copies(spark.createDataFrame(rows, "page_id long, html string"), draw=read).collect()
    assert {(r.copy_class, r.n_links) for r in got} == {(0, 1)}


def boilerplate_pages(n):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    parts = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) for _ in range(12)]
    return [f"<p>home shop about</p><p>{rng.choice(parts)}</p><div>{rng.choice(parts)} {i}</div><p>all rights reserved</p>"
            for i in range(n)]


def brute_links(f):
    inliers = {(i, j): I.consensus(f[i], f[j])[0] for i in range(len(f)) for j in range(len(f)) if i != j}
    return {p: n for p, n in inliers.items() if n >= max(I.LEAST_INLIERS, I.LEAST_SHARE * min(len(f[p[0]]), len(f[p[1]])))}


def test_no_link_of_pages_with_common_parts_is_left_out(spark):
    pages_ = {I.draw_page(h).tobytes(): h for h in boilerplate_pages(90)}  # characters may share a shade
    html = list(pages_.values())
    images = [I.draw_page(h) for h in html]
    f = I.features(images)
    ids = [I.image_id(i, g) for i, g in zip(images, f)]
    links = {p: n for p, n in brute_links(f).items() if ids[p[0]] < ids[p[1]]}
    best, least = {}, list(range(len(f)))
    for (i, j), n in links.items():
        best[i], best[j] = max(best.get(i, 0), n), max(best.get(j, 0), n)
    for _ in f:
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    want = [(i, least[i], sum(i in p for p in links), best.get(i, 0)) for i in range(len(f))]
    got = I.find_copies(spark.createDataFrame(list(enumerate(html)), "page_id long, html string"))
    assert len(links) > 40
    assert sorted((r.page_id, r.copy_class, r.n_links, r.inliers) for r in got.collect()) == want


def test_pack_links_agree_with_consensus(monkeypatch):
    images = [I.draw_page(h) for h in boilerplate_pages(24)]
    images += [np.rot90(images[0]).copy(), images[1].repeat(2, 0).repeat(2, 1), images[2][10:], np.tile(images[3], (9, 1))]
    f = I.features(images)
    order = np.random.default_rng(3).permutation(len(f))

    def pack(at):
        return I.Pack(order[at], np.array([len(f[i]) for i in at]), np.concatenate([f[i] for i in at]))

    brute = brute_links(f)
    for cells, pairs, sums in ((1 << 25, 1 << 16, 1 << 18), (3000, 7, 50)):
        monkeypatch.setattr(I, "CELLS", cells), monkeypatch.setattr(I, "PAIRS", pairs), monkeypatch.setattr(I, "SUMS", sums)
        found = []
        for x, y in (([*range(15)], [*range(15, 28)]), ([*range(15, 28)], [*range(15)]), ([*range(28)], [*range(28)])):
            found.append({(x[i], y[j], n) for i, j, n in zip(*(c.tolist() for c in I.pack_links(pack(x), pack(y))))})
        want = {(i, j, n) for (i, j), n in brute.items() if order[i] < order[j]}
        assert found[0] | found[1] == {p for p in want if (p[0] < 15) != (p[1] < 15)}
        assert found[2] == want and len(want) > 5


def test_odd_images(spark):
    html = "<p>" + " ".join(f"word{i * i % 97}" for i in range(900)) + "</p>"
    rows = [(1, None), (2, ""), (3, "<p>x"), (4, html), (5, html), (5, html), (None, html), (6, html + "<p>more text below it</p>"),
            (7, "<script>" * 1000), (8, "a" * 300_000)]
    d = spark.createDataFrame(rows, "page_id long, html string").withColumn("image", F.lit(1))
    got = sorted(((r.page_id, r.image_class, r.copy_class) for r in I.find_copies(d).collect()), key=repr)
    assert got == sorted([(1, 1, 1), (2, 1, 1), (3, 3, 3), (4, 4, 4), (5, 4, 4), (5, 4, 4), (None, 4, 4), (6, 6, 4), (7, 1, 1),
                          (8, 8, 8)], key=repr)
    assert I.find_copies(d.limit(0)).count() == 0


def near_copy(text, rng):
    w = text.split(" ")
    for _ in range(max(1, len(w) // 100)):
        w[rng.randrange(len(w))] = "changed"
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus(spark, sf):
    """Documents with a planted copy, near copy, benchmark passage, junk, nulls, repeated rows and clashing columns."""
    rng = random.Random(4)
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy(F.length("text").desc()).first().text
    vocabulary = [f"palabra{i}" for i in range(500)]
    text = " ".join(rng.choice(vocabulary) for _ in range(400))
    planted = [(9001, text), (9002, text), (9003, near_copy(text, rng)), (9004, "alpha beta " + item), (9005, None), (9006, "12 345 !"),
               (9007, " ".join(rng.choice(vocabulary) for _ in range(300))), (9008, "repeated row of seven words in all"),
               (9008, "repeated row of seven words in all"), (None, "no key but quite some words to read here")]
    rows = spark.createDataFrame([(i, t, None, "srcX" if i != 9007 else None, None) for i, t in planted],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(rows).withColumns(
        {"size": F.lit("s"), "shard": F.lit("mine"), "key": F.lit(1), "position": F.lit("p")})


def test_pipeline(spark, sf, corpus, tmp_path):
    import corpus_pipeline as P

    docs, ids = corpus, {}
    for name, stage in P.STAGES:
        columns = docs.columns
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        if name != "shards":
            assert docs.columns == columns
    assert {9005, 9006}.isdisjoint(ids["language_id"]) and {9001, 9008, None} <= set(ids["language_id"])
    assert ids["near_copies"].count(9001) == ids["near_copies"].count(9008) == ids["near_copies"].count(9007) == 1
    assert {9002, 9003}.isdisjoint(ids["near_copies"]) and None in ids["near_copies"]
    assert 9004 in ids["near_copies"] and 9004 not in ids["decontamination"]
    assert set(ids["near_copies"]) - set(ids["decontamination"]) <= {9004} | {i for i in ids["near_copies"] if i and i < 9000}
    assert sorted(map(repr, ids["shards"])) == sorted(map(repr, ids["mixture"]))
    assert docs.select("size").distinct().collect()[0][0] == "s" and dict(docs.dtypes)["shard"] == "int"
    assert docs.select("shard", "slot").distinct().count() == docs.count()


def test_stages_are_written_tightly(spark, sf, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    import corpus_pipeline as P

    monkeypatch.setattr(P, "STAGES", [("first", lambda s, d, _: d), ("last", lambda s, d, _: d)])
    monkeypatch.setattr("urlsieve.session.shared_dir", lambda _: str(tmp_path))
    assert P.run(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    files = list(tmp_path.glob("first-*/*.parquet"))
    assert files and {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files} == {"ZSTD"}


def test_pipeline_of_no_documents(spark, sf, corpus):
    import corpus_pipeline as P

    docs = corpus.limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_pipeline_without_any_language(spark, sf, corpus):
    import corpus_pipeline as P

    docs = corpus.withColumn("lang", F.lit(None).cast("string"))
    rows = P.language_id(spark, docs, sf).select("doc_id", "lang").collect()
    letters = [r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")]
    assert sorted(map(repr, (r.doc_id for r in rows))) == sorted(map(repr, letters))
    assert {r.lang for r in rows} == {None} and {9005, 9006}.isdisjoint(letters) and 9001 in letters


def test_entry_points_without_the_operators(tmp_path):
    code = ("import sys; sys.modules['urlsieve.llm'] = None; sys.path.insert(0, %r); import __spark_entry__ as e; "
            "assert 'pipeline' not in e.queries() and 'decide_fused' in e.queries() and e.oracle_sql()" % str(REPO))
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
