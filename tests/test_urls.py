"""URL functions against Python's own urllib on odd and generated URLs."""

import random
import re
import urllib.parse as up

import pytest
from conftest import url_frame
from pyspark.sql import functions as F

from urlsieve.functions import url as U
from urlsieve.functions.tokens import with_tokens

ODD = [
    "", "   ", "no-scheme.example/p", "a%zz", "%2541", "x%ffy", "http://h/[a]b", "HTTP://User@Host:80/p;x=1?q=1#f",
    "http://h/a;b/c;d?e;f", "http://h?a=1&a=2&b=&=3&&c", "http://one", "http://1.2.3.4/x", "https://www.www.h.example./",
    "http://h/%20%41b c", "a\tb\nc", "http://h/\x01x", "mailto:x@y", "ftp://h/p;type=a", "git+ssh://h/p;x", "//h/p", "http:///p",
    "http://h/p#a?b", "http://h/p?a#b?c", "x" * 2049, "http://h/%E2%82%AC%E2%82", "http://h/a+b?c+d=e+f%2Bg", " http://h ",
]


def generated(n=300):
    rng = random.Random(7)
    alphabet = list("ab/?#&=;:@%.+-_~ 01") + ["%41", "%25", "%2f", "http://", "www.", "é", "\t"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def clean(u):
    u = up.unquote((u or "").strip().lower(), errors="ignore")
    return re.sub(r"[\x00-\x1f\x7f]", "", u.replace("[", "").replace("]", ""))


def parse(u):
    u = clean(u)
    return up.urlparse(u if re.match(r"^[a-zA-Z][a-zA-Z0-9+\-.]*://", u) else "http://" + u)


def test_clean(spark):
    urls = ODD + generated()
    got = url_frame(spark, urls).select("row_id", U.clean_url(F.col("url")).alias("c")).collect()
    assert {r.row_id: r.c for r in got} == {i: clean(u) for i, u in enumerate(urls)}


def test_parts(spark):
    urls = [u for u in ODD + generated() if "\x01" not in u]
    got = {r.row_id: (r.scheme, r.netloc, r.path, r.query) for r in U.with_url_parts(url_frame(spark, urls)).collect()}
    want = {}
    for i, u in enumerate(urls):
        p = parse(u)
        want[i] = (p.scheme, p.netloc.lower(), p.path.lower(), p.query.lower())
    assert got == want


def test_query_pairs(spark):
    queries = ["", "a", "a=1&a=2&b=&=3&&c", "x+y=%41+%zz", "a%26b=c%3Dd", "%ff=1", "a==b"]
    got = url_frame(spark, queries).select("row_id", U.query_pairs(F.col("url")).alias("p")).collect()
    assert {r.row_id: [(x.key, x.value) for x in r.p] for r in got} == {
        i: up.parse_qsl(q, keep_blank_values=True) for i, q in enumerate(queries)}


def test_evidence_host(spark):
    urls = ["HTTP://a@B.example:80/x", "b.example", "http://[::1]:80/", "https://x%41y/", "http://h/[x]"]
    got = U.with_evidence_parts(url_frame(spark, urls)).orderBy("row_id").collect()
    assert [r.host for r in got] == ["b.example", "b.example", "::1", "xay", "h"]
    assert [r.scheme for r in got] == ["http", "https", "http", "https", "http"]


@pytest.mark.parametrize("url,tokens", [
    ("", ["empty_or_invalid_url"]),
    ("http://u@www.a.b-c.example/x.Y/f.tar.gz?k1=v&k1=", [
        "has_userinfo", "tld:example", "subdomain:a", "domain:a", "sld:b-c", "domain:b-c", "tldpart:example",
        "domain:example", "dpart:example", "path:x.y", "path:f.tar.gz", "pseg:tar", "pseg:gz", "ext:gz", "has_query",
        "qkey:k1", "qk:k1", "qkey:k1", "qk:k1", "tok:http", "tok:www", "tok:example", "tok:tar", "tok:gz", "tok:k1",
        "tok:k1", "char:exa", "char:xam", "char:amp", "char:mpl", "char:ple", "char:exam", "char:xamp", "char:ampl",
        "char:mple", "has_hyphen", "many_dots"]),
    ("http://1.2.3.4/", ["host_is_ip", "tld:4", "subdomain:1", "domain:1", "subdomain:2", "domain:2", "sld:3", "domain:3",
                         "tldpart:4", "domain:4", "tok:http"]),
])
def test_tokens(spark, url, tokens):
    assert with_tokens(url_frame(spark, [url])).first().tokens == tokens


def test_clean_is_idempotent_without_percent(spark):
    urls = [u for u in generated() if "%" not in u]
    c = U.clean_url(F.col("url"))
    assert url_frame(spark, urls).filter(c != U.clean_url(c)).count() == 0


def test_char_ids_over_all_planes(spark):
    """Ids of characters of one to four bytes, unknown ones, cut and padded; an empty vocabulary knows none."""
    from urlsieve.operators import features as FE

    urls = ["http://a.example/é漢😀b", "zz😁", "", "x" * 300]
    d = spark.createDataFrame(list(enumerate(urls)), "row_id long, url string")
    vocab = FE.char_vocabulary(d.filter("row_id <> 1"))
    ids = {r.ch: r.id for r in vocab.collect()}
    for r in FE.char_ids(d, vocab).collect():
        assert r.ids == ([2] + [ids.get(c, 1) for c in r.url] + [0] * 256)[:256]
    assert [r.ids[:4] for r in FE.char_ids(d.filter("row_id = 1"), vocab.limit(0)).collect()] == [[2, 1, 1, 1]]
