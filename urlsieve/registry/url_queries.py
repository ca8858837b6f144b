"""URL cleaning, parsing and tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as T
from ..functions import url as U
from ..operators import features as FE
from . import register, views
from .sqltext import add, clean, ngrams, prefixed, query, split

SEP = " | "


def _joined(c):
    return F.array_join(c, SEP)


@register("url_clean", query("SELECT row_id, dec AS clean, c2 AS clean_twice FROM url_c", "url_c"))
def url_clean(spark, sf):
    d = views.urls(spark, sf).select("row_id", U.clean_url(F.col("url")).alias("clean"))
    return d.withColumn("clean_twice", U.clean_url(F.col("clean")))


@register("url_split_parts", query(
    f"SELECT row_id, p AS part, count(*) AS n FROM (SELECT row_id, unnest({split('dec', 2)}) AS p FROM url_c) "
    "GROUP BY ALL", "url_c"))
def url_split_parts(spark, sf):
    d = U.exploded(views.urls(spark, sf), U.split_parts(F.col("url")), "part", "row_id")
    return d.groupBy("row_id", "part").agg(F.count("*").alias("n"))


@register("url_char_ngrams", query(
    f"""SELECT gram, count(*) AS n, count(DISTINCT row_id) AS urls FROM (
    SELECT row_id, unnest(flatten(list_transform(list_filter({split('c2', 2)}, lambda x: length(x) >= 6),
           lambda p: {ngrams('p')}))) AS gram FROM url_c) GROUP BY gram""", "url_c"))
def url_char_ngrams(spark, sf):
    parts = U.split_parts(U.clean_url(F.col("url")))
    grams = F.flatten(F.transform(F.filter(parts, lambda x: F.length(x) >= 6), U.char_ngrams))
    d = U.exploded(views.urls(spark, sf), grams, "gram", "row_id")
    # Count per URL first: the distinct count then needs no second expansion of hot n-grams.
    d = d.groupBy("gram", "row_id").agg(F.count("*").alias("n"))
    return d.groupBy("gram").agg(F.sum("n").alias("n"), F.count("*").alias("urls"))


_PARTS_SQL = f"""SELECT row_id, scheme, netloc, path, query, fragment FROM (
  SELECT row_id, CASE WHEN regexp_matches(dec, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN dec ELSE 'http://' || dec END AS t,
         lower(split_part(t, '://', 1)) AS scheme, substr(t, strpos(t, '://') + 3) AS rest,
         split_part(rest, '#', 1) AS nofrag, substr(rest, length(nofrag) + 2) AS fragment,
         split_part(nofrag, '?', 1) AS noq, lower(split_part(noq, '/', 1)) AS netloc,
         lower(regexp_replace(substr(noq, length(netloc) + 1), ';[^/]*$', '')) AS path,
         lower(substr(nofrag, length(noq) + 2)) AS query FROM url_c)"""


@register("url_parts", query(_PARTS_SQL, "url_c"))
def url_parts(spark, sf):
    return U.with_url_parts(views.urls(spark, sf)).select("row_id", "scheme", "netloc", "path", "query", "fragment")


@register("url_norm_host", query(
    """SELECT row_id, trim(regexp_replace(split_part(split_part(lnetloc, '@', -1), ':', 1), '^www[.]', ''), '.')
       AS host FROM url_p""", "url_p"))
def url_norm_host(spark, sf):
    d = views.urls(spark, sf).select("row_id", U.clean_url(F.col("url")).alias("url"))
    return U.with_url_parts(d).select("row_id", U.normalized_host(F.col("netloc")).alias("host"))


@register("url_parts_evidence", query(
    f"""SELECT row_id, clean, scheme, host, path, query, array_to_string(path_parts, '{SEP}') AS path_parts,
       array_to_string(query_parts, '{SEP}') AS query_parts, false AS parse_error FROM ev_p""", "ev_p"))
def url_parts_evidence(spark, sf):
    return U.with_evidence_parts(views.urls(spark, sf)).select(
        "row_id", "clean", "scheme", "host", "path", "query", _joined("path_parts").alias("path_parts"),
        _joined("query_parts").alias("query_parts"), "parse_error")


@register("url_host_anatomy", query(
    f"""SELECT row_id, host, array_to_string(labels, '{SEP}') AS labels, tld, sld,
       array_to_string(sub_labels, '{SEP}') AS sub_labels, array_to_string(label_parts, '{SEP}') AS label_parts,
       is_ipv4, regexp_matches(dec, '\\d{{1,3}}(\\.\\d{{1,3}}){{3}}') AS has_ip
       FROM ev_p JOIN (SELECT row_id, dec FROM url_c) USING (row_id)""", "ev_p", "url_c"))
def url_host_anatomy(spark, sf):
    d = views.urls(spark, sf).withColumn("dec", U.clean_url(F.col("url")))
    return U.with_evidence_parts(d).select(
        "row_id", "host", _joined("labels").alias("labels"), "tld", "sld", _joined("sub_labels").alias("sub_labels"),
        _joined("label_parts").alias("label_parts"), "is_ipv4",
        F.col("dec").rlike(r"\d{1,3}(\.\d{1,3}){3}").alias("has_ip"))


@register("url_query_pairs", query(
    """SELECT row_id, pos, p.key AS key, p.value AS value FROM (
       SELECT row_id, unnest(pairs) AS p, generate_subscripts(pairs, 1) - 1 AS pos FROM ev_p)""", "ev_p"))
def url_query_pairs(spark, sf):
    d = U.with_evidence_parts(views.urls(spark, sf))
    numbered = F.transform(U.query_pairs(F.col("query")), lambda p, i: F.struct(
        i.cast("long").alias("pos"), p["key"].alias("key"), p["value"].alias("value")))
    return U.exploded(d, numbered, "p", "row_id").select("row_id", "p.pos", "p.key", "p.value")


@register("url_tokens", query(
    f"SELECT row_id, len(tokens) AS n, array_to_string(tokens, '{SEP}') AS tokens FROM url_tok", "url_tok"))
def url_tokens(spark, sf):
    d = T.with_tokens(views.urls(spark, sf)).select("row_id", "tokens")
    return d.select("row_id", F.size("tokens").cast("long").alias("n"), _joined("tokens").alias("tokens"))


_CATEGORY_SQL = """CASE WHEN strpos(token, ':') = 0 THEN 'url_rule'
 WHEN split_part(token, ':', 1) IN ('tld', 'tldpart', 'sld', 'subdomain', 'domain', 'dpart') THEN 'domain'
 WHEN split_part(token, ':', 1) IN ('path', 'pseg') THEN 'path'
 WHEN split_part(token, ':', 1) = 'ext' THEN 'file_extension'
 WHEN split_part(token, ':', 1) IN ('qkey', 'qk', 'qv') THEN 'query'
 WHEN split_part(token, ':', 1) = 'char' THEN 'character_ngram' ELSE 'lexical' END"""
VALUE_SQL = "CASE WHEN strpos(token, ':') = 0 THEN token ELSE substr(token, strpos(token, ':') + 1) END"


@register("url_feature_catalog", query(
    f"""SELECT token, split_part(token, ':', 1) AS prefix, {VALUE_SQL} AS value, {_CATEGORY_SQL} AS category,
       count(*) AS urls FROM tok GROUP BY ALL""", "tok"))
def url_feature_catalog(spark, sf):
    d = U.exploded(T.with_tokens(views.urls(spark, sf)), F.array_distinct("tokens"), "token")
    d = d.groupBy("token").agg(F.count("*").alias("urls"))
    c = F.col("token")
    return d.select("token", T.feature_prefix(c).alias("prefix"), T.feature_value(c).alias("value"),
                    T.feature_category(c).alias("category"), "urls")


add("ev_f", f"""SELECT *, list_distinct(
  CASE WHEN is_ipv4 THEN ['host_is_ip', 'domain:' || host]
       WHEN len(labels) > 0 THEN ['tld:' || tld, 'domain:' || host]
            || CASE WHEN len(labels) >= 2 THEN ['sld:' || sld] ELSE []::VARCHAR[] END
            || CASE WHEN len(labels) >= 3 THEN ['subdomain:' || array_to_string(sub_labels, '.')] ELSE []::VARCHAR[] END
            || {prefixed('dpart', 'labels')} || {prefixed('domain', 'labels')} || {prefixed('tok', 'labels')}
       ELSE []::VARCHAR[] END
  || {prefixed('path', 'path_parts')} || {prefixed('pseg', 'path_parts')} || {prefixed('tok', 'path_parts')}
  || CASE WHEN extension IS NOT NULL THEN ['ext:' || extension] ELSE []::VARCHAR[] END
  || flatten(list_transform(pairs, lambda p: list_transform({split('p.key', 1)}, lambda y: 'qkey:' || y)
       || list_transform({split('p.key', 1)}, lambda y: 'qk:' || y)
       || list_transform({split('p.key', 1)}, lambda y: 'tok:' || y)
       || list_transform({split('p.value', 1)}, lambda y: 'qv:' || y)
       || list_transform({split('p.value', 1)}, lambda y: 'tok:' || y)))
  || CASE WHEN scheme = 'http' THEN ['scheme:http'] ELSE []::VARCHAR[] END) AS features FROM ev_p""", "ev_p")


@register("url_scoring_features", query(
    f"SELECT row_id, array_to_string(list_sort(features), '{SEP}') AS features FROM ev_f", "ev_f"))
def url_scoring_features(spark, sf):
    d = T.url_features(views.urls(spark, sf))
    return d.select("row_id", _joined(F.sort_array("features")).alias("features"))


add("char_vocab", """SELECT ch, n, row_number() OVER (ORDER BY n DESC, ch) + 2 AS id
FROM (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(dec, '')) AS ch FROM url_c) WHERE ch <> '' GROUP BY ch)""",
    "url_c")


@register("char_vocab", query("SELECT ch, n, id FROM char_vocab", "char_vocab"))
def char_vocab(spark, sf):
    return FE.char_vocabulary(views.urls(spark, sf)).select("ch", "n", "id")


@register("url_char_ids", query(
    """SELECT row_id, array_to_string(list_resize(['2'] || coalesce(ids, []::VARCHAR[]), 256, '0'), ' ') AS ids
       FROM url_c LEFT JOIN (
         SELECT row_id, list(coalesce(id, 1)::VARCHAR ORDER BY pos) AS ids
         FROM (SELECT row_id, unnest(string_split(dec, '')) AS ch, generate_subscripts(string_split(dec, ''), 1) AS pos
               FROM url_c WHERE dec <> '') LEFT JOIN char_vocab USING (ch) GROUP BY row_id) USING (row_id)""",
    "url_c", "char_vocab"))
def url_char_ids(spark, sf):
    urls = views.urls(spark, sf)
    d = FE.char_ids(urls, FE.char_vocabulary(urls))
    return d.select("row_id", F.array_join("ids", " ").alias("ids"))
