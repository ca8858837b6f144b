"""Sources, sinks and request rates. Files are written to the shared folder first and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import lexicon as L
from ..operators import ratelimit as R
from ..operators import similar as S
from ..session import shared_dir
from ..sources import readers as IO
from . import register, views
from .lexicon_queries import tokens
from .sqltext import add, query


def _folder(spark, name):
    return f"{shared_dir(spark)}/urlsieve/{name}-{uuid.uuid4().hex}"


@register("src_labelled_urls", query(
    """SELECT url, type, count(*) AS n FROM urls WHERE row_id % 41 <> 0 AND row_id % 43 <> 0 GROUP BY ALL""", "urls"))
def src_labelled_urls(spark, sf):
    path = _folder(spark, "labelled")
    d = views.urls(spark, sf).select("row_id", F.when(F.col("row_id") % 41 != 0, F.col("url")).alias("url"),
                                     F.when(F.col("row_id") % 43 != 0, F.col("type")).alias("type"))
    d.write.option("header", True).option("escape", '"').csv(path)
    return IO.read_labelled_urls(spark, path).groupBy("url", "type").agg(F.count("*").alias("n"))


@register("src_case_index", query(
    """SELECT row_id AS case_id, trim(url) AS url, type AS label, len(list_distinct(tokens))::BIGINT AS tokens
       FROM url_tok WHERE trim(url) <> ''""", "url_tok"))
def src_case_index(spark, sf):
    d = S.case_index(views.urls(spark, sf).withColumnsRenamed({"url": "URL", "type": "label"}), "row_id")
    return d.select("case_id", "url", "label", F.size(F.array_distinct("tokens")).cast("long").alias("tokens"))


@register("src_lexicon_terms", query("SELECT category, term FROM lex_r", "lex_r"))
def src_lexicon_terms(spark, sf):
    path = _folder(spark, "lexicon")
    IO.write_lexicon(L.lexicon_from_dictionary(L.rebuilt_dictionary(tokens(spark, sf)), metadata=True), path)
    return IO.read_lexicon(spark, path)


_PAYLOAD = """CASE row_id % 3 WHEN 0 THEN concat('{{"urls": ["  ', url, ' ", "", null, "', url, '"]}}')
  WHEN 1 THEN concat('{{"url": "', url, '"}}') ELSE concat('{{"urls": "', url, ' "}}') END"""
_REQUESTS = "SELECT row_id, " + _PAYLOAD.replace("{{", "{").replace("}}", "}") + " AS payload FROM urls"
add("req", _REQUESTS, "urls")


@register("src_request_urls", query(
    """SELECT row_id, 0::INTEGER AS pos, url FROM urls UNION ALL SELECT row_id, 3::INTEGER, url FROM urls WHERE row_id % 3 = 0""",
    "urls"))
def src_request_urls(spark, sf):
    payloads = views.urls(spark, sf).select("row_id", F.expr(_PAYLOAD.replace("{{", "{").replace("}}", "}")).alias("payload"))
    return IO.request_urls(payloads, "payload", "row_id")


# Sparse events: six-hour windows and three accepted requests.
WINDOW, LIMIT = 21600, 3


@register("rate_rolling", f"""SELECT user_id, ts, requests, sum(requests) OVER (PARTITION BY user_id ORDER BY ts
  RANGE BETWEEN INTERVAL '{WINDOW} seconds' PRECEDING AND CURRENT ROW)::BIGINT AS in_window
  FROM (SELECT user_id, ts, count(*) AS requests FROM events GROUP BY ALL)""")
def rate_rolling(spark, sf):
    return R.rolling_rate(views.table(spark, sf, "events").select("user_id", "ts"), "user_id", "ts", WINDOW)


@register("rate_admission", f"""WITH RECURSIVE e AS (
    SELECT user_id, ts, epoch_us(ts) AS t, count(*) AS k,
           row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events GROUP BY user_id, ts),
  r AS (
    SELECT user_id, ts, k, rn, least(k, {LIMIT}) AS accepted, list_resize([t], least(k, {LIMIT}), t) AS live,
           CASE WHEN k > {LIMIT} THEN {WINDOW} ELSE 0 END AS retry FROM e WHERE rn = 1
    UNION ALL
    SELECT user_id, ts, k, rn, acc, old || list_resize([]::BIGINT[], acc, t),
           CASE WHEN acc = k THEN 0 ELSE greatest(1, trunc(({WINDOW}000000 - (t - (old || [t])[1])) / 1e6)) END
    FROM (SELECT *, greatest(0, least(k, {LIMIT} - len(old))) AS acc FROM (
      SELECT e.user_id, e.ts, e.k, e.rn, e.t, list_filter(r.live, lambda x: x >= e.t - {WINDOW}000000) AS old
      FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)))
  SELECT user_id, ts, k AS requests, accepted::BIGINT AS accepted, (k - accepted)::BIGINT AS rejected,
         retry::BIGINT AS retry_after FROM r""")
def rate_admission(spark, sf):
    return R.admission(views.table(spark, sf, "events").select("user_id", "ts"), "user_id", "ts", LIMIT, WINDOW)
