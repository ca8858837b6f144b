"""Operators with their own algorithms against plain Python, with hot keys."""

import math
import random
from collections import Counter, defaultdict

from conftest import url_frame
from pyspark.sql import functions as F

from urlsieve import constants as K
from urlsieve.functions.tokens import with_tokens
from urlsieve.operators import explain as X
from urlsieve.operators import features as FE
from urlsieve.operators import lexicon as L
from urlsieve.operators import model as M
from urlsieve.operators import pages as P
from urlsieve.operators import ratelimit as R
from urlsieve.operators import similar as S
from urlsieve.plans import progressive as PR
from urlsieve.plans.scoring import explain_urls
from urlsieve.registry import explain_queries as EQ
from urlsieve.registry import views


def requests(seed=3):
    """One client sends over a third of all requests, some at equal times."""
    rng = random.Random(seed)
    rows = [("hot", rng.randint(0, 400_000_000) // 500_000 * 500_000) for _ in range(300)]
    rows += [(f"c{rng.randint(0, 9)}", rng.randint(0, 900_000_000)) for _ in range(400)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "client string, t long").select("client", F.timestamp_micros("t").alias("ts"))


def by_client(rows):
    out = defaultdict(list)
    for c, t in sorted(rows, key=lambda x: x[1]):
        out[c].append(t)
    return out


def test_admission(spark):
    rows, limit, window = requests(), 5, 20
    want = defaultdict(lambda: [0, 0, 0])
    for c, times in by_client(rows).items():
        bucket = []
        for t in times:
            while bucket and bucket[0] < t - window * R.MICROS:
                bucket.pop(0)
            if len(bucket) >= limit:
                want[c, t][1] += 1
                want[c, t][2] = max(1, int(window - (t - bucket[0]) / R.MICROS))
            else:
                bucket.append(t)
                want[c, t][0] += 1
    d = R.admission(frame(spark, rows), limit=limit, window_seconds=window)
    got = {(r.client, r.t): [r.accepted, r.rejected, r.retry_after]
           for r in d.withColumn("t", F.unix_micros("ts")).collect()}
    assert got == dict(want)


def test_rolling_rate(spark):
    rows, window = requests(), 20
    want = {(c, t): sum(t - window * R.MICROS <= x <= t for x in times) for c, times in by_client(rows).items() for t in times}
    d = R.rolling_rate(frame(spark, rows), window_seconds=window)
    got = {(r.client, r.t): r.in_window for r in d.withColumn("t", F.unix_micros("ts")).collect()}
    assert got == want


def test_runs_split_a_hot_client(spark):
    rows = [("hot", i * 3_600_000_000 + j) for i in range(50) for j in range(20)]
    counted = R._counted(frame(spark, rows), "client", "ts")
    assert R.runs(counted, "client", 60).select("run").distinct().count() == 50


def urls(n=80, seed=5):
    rng = random.Random(seed)
    words = ["login", "shop", "news", "verify", "alpha", "beta"]
    return [f"http://{rng.choice(words)}.{rng.choice(words)}.example/{rng.choice(words)}/{rng.randint(0, 5)}"
            for _ in range(n)] + ["http://same.example/copy"] * 40


def test_similar_cases(spark):
    d = with_tokens(url_frame(spark, urls())).cache()
    labelled = d.select("row_id", "url", F.lit("benign").alias("type"))
    cases = S.case_index(labelled, "row_id", 60)
    found = S.similar_cases(d, cases, floor=0.25)
    got = {r.row_id: [(c.case_id, round(c.similarity, 9), c.shared) for c in r.cases] for r in found.collect()}
    sets = {r.row_id: set(r.tokens) for r in d.collect()}
    for i, a in sets.items():
        scored = [(-len(a & sets[j]) / len(a | sets[j]), j) for j in range(60) if len(a & sets[j]) >= 0.25 * len(a | sets[j])]
        want = [(j, round(-s, 9), sorted(a & sets[j])) for s, j in sorted(scored)[:3]]
        assert got[i] == want


def test_similar_cases_with_hot_tokens_at_every_step(spark):
    rng = random.Random(11)
    rows = []
    for i in range(240):  # a token in all rows, one in a third, families at different similarities, repeated sets
        own = [f"f{i % 12}_{x}" for x in range(rng.choice([4, 9, 14]))]
        tokens = ["everywhere", *(["third"] if i % 3 == 0 else []), *own, *[f"r{rng.randint(0, 40)}" for _ in range(i % 7)]]
        rows.append((i, tokens, "benign"))
    d = spark.createDataFrame(rows, "row_id long, tokens array<string>, label string").cache()
    cases = d.select(F.col("row_id").alias("case_id"), "label", "tokens")
    got = {r.row_id: [(c.case_id, round(c.similarity, 9)) for c in r.cases] for r in S.similar_cases(d, cases).collect()}
    sets = {i: set(t) for i, t, _ in rows}
    for i, a in sets.items():
        of_set = {}
        for j in sorted(sets):  # of equal sets only the first three are listed
            of_set.setdefault(frozenset(sets[j]), []).append(j)
        scored = [(-len(a & b) / len(a | b), j) for b, js in of_set.items() for j in js[:3] if 2 * len(a & b) >= len(a | b)]
        assert got[i] == [(j, round(-s, 9)) for s, j in sorted(scored)[:3]]


def test_similar_cases_look_at_few_pairs(spark):
    """Ten times the rows, where each has near copies, make far fewer than a hundred times the pairs."""
    def pairs(n):
        rng = random.Random(3)
        sets = [[1, 2, 3, *[1000 * (i // 4) + x for x in range(4, 16)], 10**7 + rng.randint(0, 10**6)] for i in range(n)]
        d = spark.createDataFrame([(i, t) for i, t in enumerate(sets)], "_set long, t array<long>") \
            .select("_set", F.reverse("t").alias("t"))  # common tokens last
        return S._alike(d, d.withColumnRenamed("_set", "_case"), S.STEPS[1]).count()

    assert pairs(2000) < 12 * pairs(200)


def test_similar_cases_of_one_kind_are_met_once(spark):
    """Sets that differ in a token of their own only make no pair of each two, and null and repeated case ids count."""
    n = 300
    sets = spark.createDataFrame([(i, [10**6 + i, *range(1, 21)]) for i in range(n)], "_set long, t array<long>")
    assert S._alike(sets, sets.withColumnRenamed("_set", "_case"), S.STEPS[1]).count() <= 4 * n
    words = [f"w{i}" for i in range(20)]
    d = spark.createDataFrame([(i, [*words, f"own{i}"]) for i in range(n)], "row_id long, tokens array<string>")
    cases = d.select(F.when(F.col("row_id") >= 2, F.col("row_id") - F.col("row_id") % 2).alias("case_id"), F.lit("benign").alias("label"), "tokens")
    got = {r.row_id: [(c.case_id, round(c.similarity, 4)) for c in r.cases] for r in S.similar_cases(d, cases).collect()}
    assert got == {i: [(None, 1.0), (None, 0.9091), (2, 0.9091)] if i < 2 else
                   [(i - i % 2, 1.0), (None, 0.9091), (None, 0.9091)] for i in range(n)}


def any_similar(sets):
    """The three best of all cases that share a token, by row; the rows are the cases."""
    out = {}
    for i, a in sets.items():
        scored = [(-len(a & b) / len(a | b), j) for j, b in sets.items() if a & b]
        out[i] = [(j, round(-s, 6)) for s, j in sorted(scored)[:3]]
    return out


def test_similar_cases_without_a_floor(spark):
    rng = random.Random(4)
    rows = [(i, sorted({"everywhere", *[f"w{int(rng.expovariate(0.02))}" for _ in range(rng.choice([0, 1, 3, 8, 20]))]})) for i in range(150)]
    rows += [(150, ["alone"]), (151, ["pair", *[f"x{i}" for i in range(20)]]), (152, ["pair", "y", "z"]), (153, [])]
    d = spark.createDataFrame([(i, t, "benign") for i, t in rows], "row_id long, tokens array<string>, label string").cache()
    found = S.similar_cases(d, d.select(F.col("row_id").alias("case_id"), "label", "tokens"), floor=0.0)
    got = {r.row_id: [(c.case_id, round(c.similarity, 6)) for c in r.cases] for r in found.collect()}
    assert got == any_similar({i: set(t) for i, t in rows})
    assert min(s for cases in got.values() for _, s in cases) < 0.1


def test_query_of_similar_cases_lists_cases_of_any_similarity(spark, tmp_path):
    urls = ["http://www.alpha.com/login", "https://other.org/a/b/c?x=1", "http://lonely-place.net/some/very/long/path/of/words", "ftp.net"]
    spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string") \
        .write.parquet(str(tmp_path / "pages.parquet"))
    got = defaultdict(list)
    for r in EQ.similar_cases(spark, str(tmp_path)).orderBy("row_id", "rank").collect():
        got[r.row_id].append((r.case_id, r.similarity))
    sets = {r.row_id: set(r.tokens) for r in with_tokens(views.urls(spark, str(tmp_path))).collect()}
    assert got == any_similar(sets)
    assert min(s for cases in got.values() for _, s in cases) < 0.5


def test_explanations_compute_saliency_once(spark):
    urls = url_frame(spark, ["http://login.shop.example/verify", "http://news.example/a?b=1", None, "http://login.shop.example/verify"])
    urls = urls.unionByName(urls.filter("row_id = 1"))  # keys may repeat
    weights = spark.createDataFrame([("char:log", 0.5), ("char:ogin", -0.25), ("char:new", 1.0)], "gram string, weight double")
    words = spark.createDataFrame([("common", "tok:login", 2.0), ("phishing", "tok:verify", 3.0)], "scope string, token string, score double")
    base = with_tokens(urls).join(X.char_saliency(urls, weights), "row_id").withColumn("prediction", F.lit("phishing"))
    once = base.withColumn("token_items", X.token_items(base.columns)).drop("text", "char_scores")
    rows = lambda d: sorted(map(str, X.token_rows(d, words).collect()))
    assert rows(once) == rows(base) and len(rows(base)) > 40
    found = explain_urls(urls, words, weights, S.case_index(urls.withColumn("type", F.lit("benign")), "row_id"))
    assert found.count() >= 5
    assert "gram#" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_global_rank_with_copies(spark):
    d = PR.ordered(url_frame(spark, urls()))
    rows = d.orderBy("order_key", "row_id").collect()
    assert [r.rn for r in rows] == list(range(1, len(rows) + 1))
    assert sum(r.warmup for r in rows) == int(len(rows) * 0.2)


def test_dictionary_counts_never_drop_with_more_rows(spark):
    d = with_tokens(url_frame(spark, urls()).withColumn("type", F.lit("benign")))
    few, many = L.token_df(d.filter("row_id < 60"), K.CLASSES), L.token_df(d, K.CLASSES)
    both = few.select("token", F.col("total_df").alias("few")).join(many, "token", "left")
    assert both.filter("total_df IS NULL OR total_df < few").count() == 0


def test_a_thousand_dictionary_versions(spark):
    rng = random.Random(9)
    labels = K.CLASSES
    rows = []
    for i in range(3300):  # 300 rows of warm-up, then batches of one row, so a version every three rows
        label = rng.choice(labels)
        tokens = [f"t{int(rng.expovariate(0.08))}" for _ in range(6)] + [f"{label}{rng.randint(0, 15)}"]
        rows.append((i, label, tokens, max(0, i - 299), 3000))
    d = spark.createDataFrame(rows, "row_id long, type string, tokens array<string>, batch_idx long, n_batches long")
    top_common, top_class, min_df = 12, 7, 3
    got = {}
    for r in PR.dictionary_versions(d, top_common, top_class, min_df).collect():
        got.setdefault((r.version, r.scope), []).append((r.rank, r.token, round(r.score, 9)))
    assert {v for v, _ in got} == set(range(1001))

    def odds(a, n, b, m):
        return math.log((a + K.SMOOTHING) / (n + 2 * K.SMOOTHING) / ((b + K.SMOOTHING) / (m + 2 * K.SMOOTHING)))

    for v in (0, 1, 2, 7, 500, 999, 1000):
        taught = [(t, set(x)) for _, t, x, b, _ in rows if b == 0 or 3 * v - 5 <= b <= 3 * v]
        n = Counter(t for t, _ in taught)
        df = Counter((x, t) for t, xs in taught for x in xs)
        total = Counter(x for _, xs in taught for x in xs)
        bad = [c for c in labels if c != K.BENIGN]
        for scope in [L.COMMON, *bad]:
            scored = []
            for x in (x for x, c in total.items() if c >= min_df):
                if scope == L.COMMON:
                    if sum(df[x, c] > 0 for c in bad) < K.MIN_MALICIOUS_CLASSES:
                        continue
                    s = odds(sum(df[x, c] for c in bad), len(taught) - n[K.BENIGN], df[x, K.BENIGN], n[K.BENIGN])
                else:
                    s = odds(df[x, scope], n[scope], total[x] - df[x, scope], len(taught) - n[scope])
                if s > 0:
                    scored.append((-round(s, 9), x))
            want = [(i + 1, x, -s) for i, (s, x) in enumerate(sorted(scored)[:top_common if scope == L.COMMON else top_class])]
            assert sorted(got.get((v, scope), [])) == want


def test_top_k_is_the_same_beyond_the_group_limit(spark):
    d = spark.range(3000).select((F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(500)).alias("v"), "id")
    order = [F.desc("v"), F.asc("id")]
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    plain = L.top_k(d, ["g"], order, 40).select("g", "id", "rank").collect()
    old = spark.conf.get(key)
    spark.conf.set(key, 10)
    try:
        salted = L.top_k(d, ["g"], order, 40).select("g", "id", "rank").collect()
    finally:
        spark.conf.set(key, old)
    assert sorted(plain) == sorted(salted)


def test_tfidf_rows_have_norm_one(spark):
    d = with_tokens(url_frame(spark, urls()))
    t = FE.tfidf(d, FE.tfidf_vocabulary(d))
    norms = t.groupBy("row_id").agg(F.sum(F.col("value") * F.col("value")).alias("s"))
    assert norms.filter(F.abs(F.col("s") - 1) > 1e-9).count() == 0


def test_learned_keywords_with_punctuation_and_blanks(spark):
    text = "we were hacked  by-me at wp-content/x, seeindex_old and xhacked bye"
    d = spark.createDataFrame([(1, text)], "page_id long, text_surface string")
    terms = spark.createDataFrame([("a", t) for t in [
        "wp-content", "index_old", "hacked", "hacked by", "by-me", "content", "conten", "missing", "html"]], "class string, term string")
    got = {r.term for r in P.learned_keyword_hits(d, terms, "page_id").collect()}
    assert got == {"wp-content", "hacked", "hacked by", "by-me"}  # "content" is a low-information word


def test_unseen_label_is_an_error(spark):
    index = FE.label_index(spark.createDataFrame([("a",), ("b",)], "type string"))
    import pytest
    with pytest.raises(Exception, match="unseen label"):
        FE.encode_labels(spark.createDataFrame([("z",)], "type string"), index).collect()


def test_specialist_vocabulary_is_an_argument(spark):
    d = M.with_grams(url_frame(spark, urls())).withColumn("binary_label", (F.col("row_id") % 2).cast("double"))
    sizes = [len(M.specialist_pipeline(1, vocabulary=v).fit(d).stages[0].vocabulary) for v in (20, 30)]
    assert sizes == [20, 30]
