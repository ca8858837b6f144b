"""Page parsing: hostile pages, character references, and agreement with the standard library's parser."""

import html
import random
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from urlsieve.functions.entities import unescape
from urlsieve.operators import metrics as MT
from urlsieve.operators import pages as P
from urlsieve.operators import quality as Q
from urlsieve.registry.page_queries import ODD_HOSTS


def frame(spark, pages):
    return spark.createDataFrame([(i, "http://h.example/", t) for i, t in enumerate(pages)], "page_id int, url string, html string")


def test_references(spark):
    texts = ["a&lt;b", "&amp;lt;", "&#104;acked &#x62;y", "&notit; &not &notin;", "&#128; &#0; &#xD800; &#1; &#11;", "&unknown; &",
             "&&amp", "&eacute;&Eacute", "&#99999999999;", "&nbsp;x", "no", "&NotEqualTilde;", "&#x1F600;", "&copy &copyx"]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", unescape(F.col("t")).alias("u"))
    assert {r.t: r.u for r in d.collect()} == {t: html.unescape(t) for t in texts}


def test_hostile_pages_take_linear_time(spark):
    pages = ["<a " * 300_000, "<!--" * 250_000, "<p " + " x='1'" * 50_000 + ">hello</p>", "<script " * 100_000, "<style " * 100_000,
             '<a title="' * 100_000, "<" * 300_000, "<input type=password>" * 3_000]
    start = time.time()
    rows = {r.page_id: r for r in P.page_signals(frame(spark, pages)).collect()}
    assert time.time() - start < 120
    assert rows[2].text_surface.strip() == "hello" and rows[7].password_input_count == 3_000
    assert rows[0].link_count == rows[5].link_count == 0


class Counter(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.forms = self.passwords = self.links = self.scripts = self.external = 0
        self.held, self.title, self.text = None, [], []

    def handle_starttag(self, tag, attributes):
        a = {k: v or "" for k, v in attributes}
        self.forms += tag == "form"
        self.passwords += tag == "input" and a.get("type", "").lower() == "password"
        self.links += tag == "a" and bool(a.get("href"))
        self.scripts += tag == "script"
        self.external += tag == "form" and a.get("action", "").startswith("http://evil.example")
        if tag in ("title", "script"):
            self.held = tag

    def handle_endtag(self, tag):
        if tag in ("title", "script"):
            self.held = None

    def handle_data(self, data):
        if data.strip():
            {"title": self.title, "script": []}.get(self.held, self.text).append(data.strip())


def test_agrees_with_the_standard_parser(spark):
    rng = random.Random(7)
    parts = ["<form action='http&#58;//evil.example/x'>", "</form>", '<form action="/own">', "<input type=\"pass&#119;ord\">", "<input type=text>",
             "<a href='/x?a=1&amp;b=2'>", "</a>", "<a>", "&#104;acked &#x62;y", "plain", "&lt;form&gt;", "<!-- <form> -->",
             "<style>a{b:c} /* <form> */</style>", "<script>if (a < b) { '<form>' }</script>", "<p title='a > b'>", "<br/>", "</p>",
             "<INPUT TYPE=PASSWORD>", "&eacute;t&eacute;", "<div data-x=\"<a href='/y'>\">", "</div>", "<!doctype html>"]
    pages = ["<title>T &amp; U</title>" + " ".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(150)]
    for r in P.page_signals(frame(spark, pages)).collect():
        c = Counter()
        c.feed(pages[r.page_id])
        c.close()
        got = (r.form_count, r.password_input_count, r.link_count, r.script_count, r.external_form_action_count)
        assert got == (c.forms, c.passwords, c.links, c.scripts, c.external), pages[r.page_id]
        assert r.title == "T & U" and r.text_surface.split() == (" ".join(c.text) + " t & u").lower().split()


def test_odd_hosts(spark):
    d = spark.createDataFrame([(h, f"http://u@{h}:80/x" if "[" not in h else f"http://{h}/x") for h, _ in ODD_HOSTS], "h string, url string")
    assert {r.h: r.block_reason is None for r in Q.public_http_error(d).collect()} == dict(ODD_HOSTS)


def test_cells_keep_unlisted_labels(spark):
    d = spark.createDataFrame([("benign", "spam"), ("spam", "spam"), ("phishing", "phishing")], "type string, prediction string")
    assert MT.cells(d).agg(F.sum("n")).first()[0] == 3


@pytest.mark.parametrize("name", ["rate_admission", "similar_cases"])
def test_workers_without_the_package_on_their_path(tmp_path, sf, name):
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(__file__).resolve().parents[1])
    code = (f"import sys; sys.path.insert(0, {root!r}); import __spark_entry__ as e; from urlsieve.session import local_session; "
            f"s = local_session('away', '2', 2); print(e.queries()[{name!r}](s, {sf!r}).count())")
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=300)


def test_learned_keyword_hits_read_the_pages_once(spark):
    texts = ["verify your account now", "a log-in page, log-ins too", "pre-verify x.y", "", None]
    pages = spark.range(5).select(F.col("id").alias("page_id"), F.element_at(F.array(*map(F.lit, texts)), (F.col("id") + 1).cast("int")).alias("text_surface"))
    terms = spark.createDataFrame([("phishing", "verify"), ("phishing", "your account"), ("malware", "log-in"), ("malware", "x.y"),
                                   ("malware", "verify"), ("malware", "count")], "class string, term string")
    hits = P.learned_keyword_hits(pages, terms, "page_id")
    assert sorted(map(tuple, hits.collect())) == [
        (0, "malware", "verify"), (0, "phishing", "verify"), (0, "phishing", "your account"), (1, "malware", "log-in"),
        (2, "malware", "verify"), (2, "malware", "x.y"), (2, "phishing", "verify")]
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 5") == 1
