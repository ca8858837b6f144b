"""Sources, sinks and bundles."""

import pytest
from conftest import url_frame
from pyspark.sql import functions as F

from urlsieve import constants as K
from urlsieve.functions.tokens import with_tokens
from urlsieve.operators import features as FE
from urlsieve.operators import lexicon as L
from urlsieve.operators import model as M
from urlsieve.operators import pages as P
from urlsieve.operators import quality as Q
from urlsieve.registry import views
from urlsieve.sources import bundle as B
from urlsieve.sources import readers as IO


def test_labelled_urls_rename_codes(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [("http://a.example/,x\"y", "1"), (None, "0"), ("b", None), ("c", "0")]
    d = spark.createDataFrame(rows, "url string, label string")
    d.write.option("header", True).option("escape", '"').csv(path)
    got = IO.read_labelled_urls(spark, path, label="label", labels={"1": "benign", "0": "phishing"})
    assert sorted(map(tuple, got.collect())) == [("c", "phishing"), ("http://a.example/,x\"y", "benign")]


def test_dictionary_versions_replace_only_themselves(spark, tmp_path):
    path = str(tmp_path / "dict")
    d = lambda token: spark.createDataFrame([("common", token, 1.0, 1)], "scope string, token string, score double, rank int")
    for version, token in [(0, "a"), (1, "b"), (1, "c")]:
        IO.write_dictionary(d(token), path, version)
    assert IO.read_dictionary(spark, path, 0).first().token == "a"
    assert [r.token for r in IO.read_dictionary(spark, path, 1).collect()] == ["c"]
    plan = IO.read_dictionary(spark, path, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(version" in plan


def test_replayed_batch_overwrites_itself(spark, tmp_path):
    path = str(tmp_path / "out")
    for _ in range(2):
        IO.write_batch(spark.range(3), path, 1, "csv")
    IO.write_batch(spark.range(2), path, 2, "csv")
    assert spark.read.option("header", True).csv(path).count() == 5


def test_truncated_bodies_end_on_a_character(spark):
    d = spark.createDataFrame([("aé€x",), ("plain",)], "html string")
    got = lambda n: [r.html for r in IO.page_snapshots(d, max_bytes=n).collect()]
    assert got(2) == ["a", "pl"] and got(3) == ["aé", "pla"] and got(5) == ["aé", "plain"] and got(7) == ["aé€x", "plain"]
    assert [r.html for r in IO.page_snapshots(d).collect()] == ["aé€x", "plain"]


def test_decode_body(spark):
    """As Python reads them with errors ignored; unknown and null charsets are UTF-8."""
    rows = [("é€".encode(), "UTF-8"), (b"a\xffb\xc3", "utf-8"), (b"\xe9", "ISO-8859-1"), ("é😀".encode("utf-16-le"), "utf-16LE"),
            ("x€".encode(), "klingon"), (b"a\xe9b", "ascii"), (None, "utf-8"), (b"ok", None), ("a\ufffdb".encode() + b"\xff", "utf8"),
            (b"\x00\xd8a\x00", "utf-16le"), (b"\x80", "windows-1252"), (b"", "hex")]
    want = ["é€", "ab", "é", "é😀", "x€", "ab", None, "ok", "a\ufffdb", "a", "€", ""]
    d = spark.createDataFrame(list(enumerate(rows)), "i int, r struct<b:binary,c:string>")
    got = d.select("i", P.decode_body(F.col("r.b"), F.col("r.c")).alias("t"), P.decode_body(F.col("r.b"), "latin1", 1).alias("l"))
    got = got.orderBy("i").collect()
    assert [r.t for r in got] == want and got[0].l == "Ã" and got[6].l is None


def test_validation_splits_rows(spark):
    d = Q.validated(url_frame(spark, ["http://a", " ", "a\x01b", "x" * 2049]))
    assert [r.error_code for r in d.orderBy("row_id").collect()] == [None, "missing_url", "invalid_url", "url_too_long"]
    assert Q.accepted(d).count() == 1 and Q.quarantined(d).count() == 3


def test_bundle_round_trip(spark, sf, tmp_path):
    path = str(tmp_path / "bundle")
    urls = views.urls(spark, sf)
    rows = with_tokens(urls)
    train = M.base_training(rows, L.risk_dictionary(rows))
    models = {"base": M.base_pipeline(FE.tfidf_vocabulary(rows), FE.scaler(train), 2).fit(train),
              "specialist": M.specialist_pipeline(2).fit(M.with_grams(M.specialist_sample(urls)))}
    tables = {"dictionary": L.risk_dictionary(with_tokens(urls)), "char_vocab": FE.char_vocabulary(urls),
              "lexicon": L.lexicon_rows(spark, K.STATIC_LEXICON)}
    B.save_bundle(path, models, tables, {"threshold": 0.35})
    loaded, stored, config = B.load_bundle(spark, path)
    assert config == {"threshold": 0.35} and set(stored) == set(tables)
    same = M.specialist_scores(models["specialist"], urls).join(
        M.specialist_scores(loaded["specialist"], urls).select("row_id", F.col("t_prob").alias("again")), "row_id")
    assert same.filter("abs(t_prob - again) > 1e-12").count() == 0
    both = M.scored(models["base"], train).join(M.scored(loaded["base"], train).select("row_id", F.col("p_benign").alias("again")), "row_id")
    assert both.filter("abs(p_benign - again) > 1e-12").count() == 0
    with pytest.raises(FileNotFoundError, match="models/base"):
        B.load_bundle(spark, str(tmp_path / "none"))
