"""Page evidence and row quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import decide as D
from ..operators import evidence as E
from ..operators import lexicon as L
from ..operators import pages as P
from ..operators import quality as Q
from . import register, views
from .evidence_queries import decide_sql, dictionary
from .sqltext import add, inlist, lit, query

_re = lambda s: "'" + s.replace("'", "''") + "'"
# Patterns and references of the SQL's own, in the syntax of its engine.
_TAG = r"""<[a-zA-Z](?:[^>"']|"[^"]*"|'[^']*')*>"""
_MARKUP = (r"(?is)<!--.*?-->|<script\b[^>]*>.*?(?:</script\s*>|\z)|<title\b[^>]*>.*?(?:</title\s*>|\z)|" + _TAG
           + r"|</[a-zA-Z][^>]*>|<![^>]*>")
_ATTRIBUTE = r"""[^\s"'<>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]*))?"""
_ENT = "{x}"
for _name, _char in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"),
                     ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&amp;", "&")]:
    _ENT = f"replace({_ENT}, {_re(_name)}, {_re(_char)})"
unesc = lambda x: _ENT.replace("{x}", x)
_WS = r"'^[\s\x{00a0}]+|[\s\x{00a0}]+$'"
_strip = lambda x: f"regexp_replace({x}, {_WS}, '', 'g')"


def _tags(name):
    return f"list_filter(items, lambda x: regexp_matches(x, '^<(?i:{name})([^a-zA-Z0-9:-]|$)'))"


def _open(x):
    return f"regexp_extract({x}, {_re('^' + _TAG)}, 0)"


def _attr(x, name):
    tag = f"regexp_replace({_open(x)}, '^<[a-zA-Z][^\\s/>]*', '')"
    found = (f"list_filter(regexp_extract_all({tag}, {_re(_ATTRIBUTE)}, 0), "
             f"lambda a: regexp_matches(a, '^(?i:{name})\\s*(=|$)'))[-1]")
    raw = f"regexp_replace({found}, '(?s)^[^=]*=?\\s*', '')"
    return f"regexp_replace({raw}, {_re('''^[\"']|[\"']$''')}, '', 'g')"


_SCHEME = "lower(regexp_extract({r}, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1))"
_NETLOC = "(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//"


def _target(ref):
    s = _SCHEME.replace("{r}", ref)
    has = f"regexp_matches({ref}, '^{_NETLOC}')"
    host = f"lower(split_part(split_part(regexp_extract({ref}, '^{_NETLOC}([^/?#]*)', 1), '@', -1), ':', 1))"
    return (f"{{'scheme': CASE WHEN {s} = '' THEN bscheme ELSE {s} END, 'host': CASE WHEN {has} THEN {host} "
            f"WHEN {s} = '' OR {s} = bscheme THEN bhost ELSE '' END}}")


def _external(items):
    return f"len(list_filter({items}, lambda t: t.host <> '' AND t.host <> bhost))"


add("sig", f"""SELECT page_id, url, title, len(forms) AS form_count, {_external('forms')} AS external_form_action_count,
  len(list_filter(forms, lambda t: t.scheme = 'http')) AS insecure_form_action_count,
  len(list_filter(inputs, lambda t: t = 'password')) AS password_input_count, len(inputs) AS input_count,
  len({_tags('iframe')}) AS iframe_count, len(scripts) AS script_count,
  {_external("list_transform(list_filter(scripts, lambda s: s.src <> ''), lambda s: " + _target('s.src') + ")")}
    AS external_script_count,
  len(inline) AS inline_script_count, len(links) AS link_count,
  {_external("list_transform(links, lambda h: " + _target('h') + ")")} AS external_link_count,
  {', '.join(f"len(regexp_extract_all(js, {_re(p)})) AS {n}" for n, (p, _) in P.JS_PATTERNS.items())},
  round(least(1e0, {' + '.join(f'{w}::DOUBLE * {n}' for n, (_, w) in P.JS_PATTERNS.items())}), 4)
    AS js_obfuscation_score, surface
FROM (SELECT *, list_transform({_tags('form')}, lambda x: {_target("coalesce(" + _attr('x', 'action') + ", '')")}) AS forms,
        list_transform({_tags('input')}, lambda x: lower(coalesce({_attr('x', 'type')}, ''))) AS inputs,
        list_transform({_tags('script')}, lambda x: {{'src': coalesce({_attr('x', 'src')}, ''),
          'body': {_strip("regexp_replace(substr(x, length(" + _open('x') + ") + 1), '(?is)</script\\s*>$', '')")}}}) AS scripts,
        list_filter(scripts, lambda s: s.src = '') AS inline,
        list_filter(list_transform({_tags('a')}, lambda x: {_attr('x', 'href')}), lambda h: h IS NOT NULL AND h <> '') AS links,
        array_to_string(list_filter(list_transform(inline, lambda s: s.body), lambda b: b <> ''), chr(10)) AS js,
        {_strip(unesc(unesc("array_to_string(list_filter(list_transform(" + _tags('title') + ", lambda x: " +
         _strip("regexp_replace(x, '(?is)^<title\\b[^>]*>|</title\\s*>$', '', 'g')") + "), lambda t: t <> ''), ' ')")))} AS title,
        lower(array_to_string(list_filter(list_transform(pieces, lambda p: {_strip(unesc('p'))}), lambda p: p <> ''), ' '))
          || ' ' || lower(title) AS surface
      FROM (SELECT page_id, url, regexp_extract_all(html, {_re(_MARKUP)}, 0) AS items,
              string_split(regexp_replace(html, {_re(_MARKUP)}, chr(1), 'g'), chr(1)) AS pieces,
              lower(split_part(url, '://', 1)) AS bscheme,
              lower(split_part(split_part(split_part(split_part(split_part(split_part(url, '://', 2), '#', 1), '?', 1), '/', 1),
                '@', -1), ':', 1)) AS bhost
            FROM html_pages))""", "html_pages")


def signals(spark, sf):
    return P.page_signals(views.html_pages(spark, sf)).drop("html")


@register("page_signals", query(
    f"SELECT page_id, title, {', '.join(f'{c}::INTEGER AS {c}' for c in P.COUNTS)}, js_obfuscation_score, "
    "length(surface)::INTEGER AS text_length, md5(surface) AS text_md5 FROM sig", "sig"))
def page_signals(spark, sf):
    return signals(spark, sf).select(
        "page_id", "title", *P.COUNTS, "js_obfuscation_score", F.length("text_surface").alias("text_length"),
        F.md5("text_surface").alias("text_md5"))


@register("page_js_score", query(
    f"SELECT page_id, {', '.join(f'{c}::INTEGER AS {c}' for c in P.JS_PATTERNS)}, js_obfuscation_score FROM sig", "sig"))
def page_js_score(spark, sf):
    return signals(spark, sf).select("page_id", *P.JS_PATTERNS, "js_obfuscation_score")


@register("page_link_targets", query(
    f"""SELECT scheme, host, count(*) AS links, count(DISTINCT page_id) AS pages FROM (
      SELECT page_id, t.scheme AS scheme, t.host AS host FROM (SELECT page_id, unnest(list_transform(links,
        lambda h: {_target('h')})) AS t FROM (
        SELECT page_id, lower(split_part(url, '://', 1)) AS bscheme,
          lower(split_part(split_part(split_part(split_part(split_part(split_part(url, '://', 2), '#', 1), '?', 1), '/', 1),
            '@', -1), ':', 1)) AS bhost,
          list_filter(list_transform(list_filter(regexp_extract_all(html, {_re(_MARKUP)}, 0),
            lambda x: regexp_matches(x, '^<(?i:a)([^a-zA-Z0-9:-]|$)')), lambda x: {_attr('x', 'href')}),
            lambda h: h IS NOT NULL AND h <> '') AS links FROM html_pages)))
    GROUP BY scheme, host""", "html_pages"))
def page_link_targets(spark, sf):
    d = P.markup(views.html_pages(spark, sf))
    links = F.filter("_tags", lambda t: (t["name"] == "a") & t["ref"].isNotNull() & (t["ref"] != ""))
    targets = F.transform(links, lambda t: t["target"])
    d = P.exploded(d, targets, "t", "page_id").select("page_id", "t.scheme", "t.host")
    d = d.groupBy("scheme", "host", "page_id").agg(F.count("*").alias("links"))
    return d.groupBy("scheme", "host").agg(F.sum("links").alias("links"), F.count("*").alias("pages"))


def _kw_sql(cls):
    terms = [t for t in P.STATIC_TERMS[cls]]
    single = [t for t in terms if t.isalnum()]
    other = [t for t in terms if t not in single]
    tests = [f"CASE WHEN strpos(surface, '{t}') > 0 THEN '{t}' END" if " " in t else
             f"CASE WHEN regexp_matches(surface, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') THEN '{t}' END" for t in other]
    extra = f" || list_filter([{', '.join(tests)}], lambda x: x IS NOT NULL)" if tests else ""
    return f"list_sort(list_intersect(words, {lit(single)}){extra})"


P.STATIC_TERMS = {c: [t for t in ts if t not in K.LOW_INFORMATION_PAGE_TERMS] for c, ts in L.STATIC_PAGE_TERMS.items()}
add("kw", f"""SELECT *, {', '.join(f'{_kw_sql(c)} AS {n}' for c, n in P.KEYWORD_COLUMNS.items())}
  FROM (SELECT *, list_distinct(string_split_regex(surface, '[^a-z0-9]+')) AS words FROM sig)""", "sig")


def keywords(spark, sf):
    return P.with_keywords(signals(spark, sf), L.STATIC_PAGE_TERMS)


@register("text_keyword_hits", query(
    "SELECT page_id, " + ", ".join(f"array_to_string({n}, ',') AS {n}" for n in P.KEYWORD_COLUMNS.values())
    + " FROM kw", "kw"))
def text_keyword_hits(spark, sf):
    return keywords(spark, sf).select("page_id", *[F.array_join(n, ",").alias(n) for n in P.KEYWORD_COLUMNS.values()])


@register("text_keyword_hits_learned", query(
    f"""SELECT page_id, class, term FROM (SELECT page_id, surface, words, class, term FROM kw, page_terms)
        WHERE term NOT IN {inlist(K.LOW_INFORMATION_PAGE_TERMS)}
          AND CASE WHEN regexp_matches(term, '^[a-z0-9]+$') THEN list_contains(words, term)
              ELSE regexp_matches(surface, '(^|[^a-z0-9])' || regexp_escape(term) || '([^a-z0-9]|$)') END""",
    "kw", "page_terms"))
def text_keyword_hits_learned(spark, sf):
    terms = L.page_terms_from_dictionary(dictionary(spark, sf))
    return P.learned_keyword_hits(signals(spark, sf), terms, "page_id")


@register("page_status", query(
    """SELECT page_id, fetched, fetched AND coalesce(strpos(lower(content_type), 'html') > 0, false) AS html_analyzed,
       CASE WHEN fetched THEN final_url <> url END AS redirected,
       CASE WHEN fetched AND strpos(lower(content_type), 'html') > 0 THEN
         CASE WHEN regexp_extract(content_type, '(?i)charset=([\\w-]+)', 1) <> ''
              THEN regexp_extract(content_type, '(?i)charset=([\\w-]+)', 1) ELSE 'utf-8' END END AS charset,
       error FROM crawl""", "crawl"))
def page_status(spark, sf):
    return P.page_status(views.crawl(spark, sf)).select(
        "page_id", "fetched", "html_analyzed", "redirected", "charset", "error")


@register("page_bodies", """SELECT page_id, charset, length(html)::INTEGER AS chars, md5(html) AS digest FROM (
  SELECT page_id, CASE WHEN fetched THEN CASE page_id % 4 WHEN 1 THEN 'ISO-8859-1' WHEN 2 THEN 'utf-16le' WHEN 3 THEN 'no-such'
                       ELSE 'utf-8' END END AS charset,
    CASE WHEN fetched THEN CASE page_id % 4 WHEN 1 THEN '<p>éè</p>' || bytes || 'ÿ' || chr(128)
      WHEN 2 THEN '<p>é😀' || html || 'a'
      ELSE '<p>é' || html || CASE page_id % 3 WHEN 0 THEN 'A' ELSE '😀' END END END AS html
  FROM (SELECT page_id, html, page_id % 11 <> 3 AS fetched, array_to_string(list_transform(range(0, strlen(html)),
          lambda i: chr(('0x' || substr(h, 2 * i + 1, 2))::INTEGER)), '') AS bytes
        FROM (SELECT *, hex(encode(html)) AS h FROM pages)))""")
def page_bodies(spark, sf):
    """Binary bodies in three charsets, one of them unknown, with broken bytes at the end."""
    d = P.decoded_pages(views.bodies(spark, sf))
    return d.select("page_id", "charset", F.length("html").alias("chars"), F.md5("html").alias("digest"))


AS_OF = "2025-01-01 00:00:00"
_HOST = "regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)"
_SAN = (f"CASE page_id % 5 WHEN 0 THEN {{a}}('other.example', '*.invalid') "
        f"WHEN 1 THEN {{a}}(concat('*.', regexp_replace({_HOST}, '^[^.]*[.]', ''))) ELSE {{a}}({_HOST}) END")
add("cert", f"""SELECT page_id, {_HOST} AS host, {_SAN.format(a='list_value')} AS san,
    CASE WHEN not_after_offset IS NOT NULL THEN TIMESTAMP '{AS_OF}' + to_days(not_after_offset::INT)
         + to_seconds(page_id % 86400) END AS not_after FROM crawl""", "crawl")
add("cert_f", f"""SELECT page_id, len(list_filter(san, lambda s: lower(s) = host
      OR (starts_with(s, '*.') AND ends_with(host, substr(lower(s), 2))))) > 0 AS ssl_host_matches_cert,
    floor(date_diff('second', TIMESTAMP '{AS_OF}', not_after) / 86400)::BIGINT AS ssl_days_until_expiry FROM cert""", "cert")


def certificates(spark, sf):
    d = views.crawl(spark, sf).selectExpr(
        "page_id", f"{_HOST} AS host", f"{_SAN.format(a='array')} AS san",
        f"timestampadd(SECOND, not_after_offset * 86400 + page_id % 86400, TIMESTAMP '{AS_OF}') AS not_after")
    return P.certificate_flags(d, F.lit(AS_OF).cast("timestamp"))


@register("page_cert_flags", query("SELECT * FROM cert_f", "cert_f"))
def page_cert_flags(spark, sf):
    return certificates(spark, sf).select("page_id", "ssl_host_matches_cert", "ssl_days_until_expiry")


_n = {c: f"len({n})" for c, n in P.KEYWORD_COLUMNS.items()}
_sens = "(password_input_count > 0 OR external_form_action_count > 0 OR insecure_form_action_count > 0)"
add("page_facts", """SELECT k.*, c.fetched, c.status_code, c.error, c.ssl_checked, c.ssl_error,
  c.fetched AND coalesce(strpos(lower(c.content_type), 'html') > 0, false) AS html_analyzed,
  f.ssl_host_matches_cert, f.ssl_days_until_expiry
  FROM kw k JOIN crawl c USING (page_id) JOIN cert_f f USING (page_id)""", "kw", "crawl", "cert_f")
add("page_sc", f"""SELECT *, CASE WHEN NOT fetched THEN 0e0 WHEN NOT html_analyzed THEN 5e-2
  ELSE greatest(0e0, least(1e0, raw)) END AS page_score FROM (SELECT *,
  CASE WHEN password_input_count > 0 THEN 35e-2 ELSE 0e0 END
  + CASE WHEN external_form_action_count > 0 THEN 3e-1 ELSE 0e0 END
  + CASE WHEN insecure_form_action_count > 0 THEN 2e-1 ELSE 0e0 END
  + CASE WHEN iframe_count > 0 AND (password_input_count > 0 OR form_count > 0) THEN 12e-2 ELSE 0e0 END
  + CASE WHEN {_n['phishing']} > 0 AND {_sens} THEN least(18e-2, 4e-2 * {_n['phishing']}) ELSE 0e0 END
  + CASE WHEN {_n['defacement']} > 0 THEN least(42e-2, 24e-2 + 6e-2 * {_n['defacement']}) ELSE 0e0 END
  + CASE WHEN {_n['malware']} > 0 AND NOT {_sens} AND {_n['defacement']} = 0 THEN least(2e-1, 6e-2 * {_n['malware']}) ELSE 0e0 END
  + CASE WHEN js_obfuscation_score >= 25e-2 THEN least(24e-2, 18e-2 * js_obfuscation_score) ELSE 0e0 END
  + CASE WHEN ssl_checked AND NOT ssl_host_matches_cert THEN 3e-1 ELSE 0e0 END
  + CASE WHEN ssl_checked AND ssl_days_until_expiry < 7 THEN 8e-2 ELSE 0e0 END
  + CASE WHEN NOT ssl_checked AND ssl_error <> 'not_https' THEN 8e-2 ELSE 0e0 END
  - CASE WHEN form_count = 0 AND password_input_count = 0 AND external_form_action_count = 0 THEN 18e-2 ELSE 0e0 END
  - CASE WHEN status_code = 200 AND title <> '' THEN 5e-2 ELSE 0e0 END AS raw FROM page_facts)""", "page_facts")


def scored_pages(spark, sf):
    facts = P.page_status(views.crawl(spark, sf)).drop("url")
    d = keywords(spark, sf).join(facts, "page_id").join(
        certificates(spark, sf).select("page_id", "ssl_host_matches_cert", "ssl_days_until_expiry"), "page_id")
    return P.page_score(d)


@register("page_score", query("SELECT page_id, fetched, html_analyzed, round(page_score, 6) AS page_score FROM page_sc",
                              "page_sc"))
def page_score(spark, sf):
    return scored_pages(spark, sf).select("page_id", "fetched", "html_analyzed",
                                          F.round("page_score", 6).alias("page_score"))


# Only the page's own URL (even row_id) has a page row.
add("fused_in", """SELECT s.row_id, s.url, greatest(0e0, least(1e0, s.raw_score)) AS url_score, s.type_defacement,
  s.type_malware, s.type_phishing, coalesce(p.page_score, 0e0) AS page_score, coalesce(p.fetched, false) AS fetched,
  coalesce(p.html_analyzed, false) AS html_analyzed
  FROM score_s s LEFT JOIN page_sc p ON s.row_id = p.page_id * 2""", "score_s", "page_sc")
_DECISION = ("row_id, round(url_score, 6) AS url_score, round(page_score, 6) AS page_score, "
             "round(weighted_score, 6) AS weighted_score, round(risk_score, 6) AS risk_score, prediction, "
             "round(confidence, 6) AS confidence")


def fused(spark, sf, dict_df=None):
    urls = E.url_evidence(views.urls(spark, sf), dict_df)
    pages = scored_pages(spark, sf).select(
        (F.col("page_id") * 2).alias("row_id"), "page_score", "page_reasons", "fetched", "html_analyzed")
    return urls.join(pages, "row_id", "left").withColumn("page_score", F.coalesce("page_score", F.lit(0.0)))


def decision_columns(d):
    r = lambda n: F.round(n, 6).alias(n)
    return d.select("row_id", r("url_score"), r("page_score"), r("weighted_score"), r("risk_score"), "prediction",
                    r("confidence"))


@register("decide_fused", query(
    f"SELECT {_DECISION} FROM ({decide_sql(page='page_score', fetched='fetched', html='html_analyzed', source='fused_in')})",
    "fused_in"))
def decide_fused(spark, sf):
    return decision_columns(D.decide(fused(spark, sf)))


@register("decision_records")
def decision_records(spark, sf):
    d = D.decide(fused(spark, sf, dictionary(spark, sf)))
    return d.select("row_id", "url", F.to_json(D.decision_record(d)).alias("record"))


_ODD = """SELECT row_id, CASE row_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '   ' WHEN 2 THEN concat(url, {tab}, 'x')
  WHEN 3 THEN concat(url, repeat('a', 2100)) ELSE concat('  ', url, ' ') END AS url FROM {urls}"""
add("odd", _ODD.format(tab="chr(9)", urls="urls"), "urls")


@register("dq_validate_urls", query(
    r"""SELECT row_id, CASE WHEN url IS NULL OR trim(url) = '' THEN 'missing_url'
       WHEN regexp_matches(trim(url), '[\x00-\x1f\x7f]') THEN 'invalid_url'
       WHEN length(trim(url)) > 2048 THEN 'url_too_long' END AS error_code FROM odd""", "odd"))
def dq_validate_urls(spark, sf):
    d = spark.sql(_ODD.replace("{tab}", "char(9)"), urls=views.urls(spark, sf))
    return Q.validated(d).select("row_id", "error_code")


_BLOCK = " OR ".join(f"num BETWEEN {Q._number(a)} AND {Q._number(b)}" for a, b in Q.BLOCKED_RANGES)
# Odd spellings of hosts and whether they may be fetched, worked out by hand.
ODD_HOSTS = [("[::1]", False), ("[fe80::1%25eth0]", False), ("2130706433", False), ("127.1", False), ("0x7f000001", False),
             ("localhost", False), ("a.localhost.", False), ("0177.0.0.1", False), ("134744072", True), ("[2001:4860:4860::8888]", True),
             ("[fd00::2]", False), ("[2001:db8::1]", False), ("[::ffff:10.0.0.1]", False), ("10.1", False), ("8.8.2056", True),
             ("1.2.3.4.5", True), ("256.1.1.1", False), ("4294967296", False), ("[2001:20::1]", True), ("[2002::1]", False),
             ("localhost.example", True)]
_ADDR = """SELECT row_id, CASE WHEN row_id % 5 = 4 AND row_id % 2 = 0 THEN concat('http://', element_at_({odd}, row_id % {n} + 1), '/x')
  WHEN row_id % 5 = 0 THEN concat('http://', row_id * 7919 % 256, '.', row_id * 31 % 256, '.0.1/x')
  WHEN row_id % 5 = 1 THEN concat('ftp://', row_id, '.example/') WHEN row_id % 5 = 2 THEN 'https:///nohost' ELSE url END AS url
  FROM {urls}"""
_ODD_LIST = ", ".join(f"'{h}'" for h, _ in ODD_HOSTS)
_addr = lambda array, at: _ADDR.replace("{n}", str(len(ODD_HOSTS))).replace("element_at_", at).replace("{odd}", array)
add("addr", _addr(f"[{_ODD_LIST}]", "list_extract").replace("{urls}", "urls"), "urls")


@register("dq_public_http", query(
    f"""SELECT row_id, CASE WHEN scheme NOT IN ('http', 'https') THEN 'unsupported_scheme' WHEN host = '' THEN 'missing_host'
       WHEN odd IN ({', '.join(f"'{h}'" for h, ok in ODD_HOSTS if not ok)}) THEN 'blocked_private_or_local_address'
       WHEN odd IS NULL AND ({_BLOCK}) THEN 'blocked_private_or_local_address' END AS block_reason
       FROM (SELECT *, CASE WHEN regexp_matches(host, '^\\d{{1,3}}(\\.\\d{{1,3}}){{3}}$') THEN
             split_part(host, '.', 1)::BIGINT * 16777216 + split_part(host, '.', 2)::BIGINT * 65536
             + split_part(host, '.', 3)::BIGINT * 256 + split_part(host, '.', 4)::BIGINT END AS num
       FROM (SELECT row_id, CASE WHEN row_id % 5 = 4 AND row_id % 2 = 0 THEN url[8:-3] END AS odd, CASE WHEN regexp_matches(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN trim(url)
             ELSE 'https://' || trim(url) END AS t, lower(split_part(t, '://', 1)) AS scheme,
             lower(split_part(split_part(split_part(split_part(split_part(substr(t, strpos(t, '://') + 3), '#', 1), '?', 1), '/', 1),
               '@', -1), ':', 1)) AS host FROM addr))""", "addr"))
def dq_public_http(spark, sf):
    d = spark.sql(_addr(f"array({_ODD_LIST})", "element_at").replace("row_id % 21 + 1", "CAST(row_id % 21 + 1 AS INT)"),
                  urls=views.urls(spark, sf))
    return Q.public_http_error(d).select("row_id", "block_reason")
