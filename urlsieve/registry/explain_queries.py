"""Similar cases and explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from .. import texts as TX
from ..functions.numbers import fixed
from ..functions.tokens import with_tokens
from ..functions.url import exploded
from ..operators import decide as D
from ..operators import evidence as E
from ..operators import explain as X
from ..operators import lexicon as L
from ..operators import model as M
from ..operators import similar as S
from . import register, views
from .evidence_queries import decide_sql, dictionary
from .page_queries import scored_pages
from .sqltext import add, inlist, query
from .url_queries import VALUE_SQL, _CATEGORY_SQL

add("case_ids", "SELECT row_id AS case_id, type AS label FROM urls WHERE trim(url) <> ''", "urls")
add("sizes", "SELECT row_id, count(*) AS size FROM tok_ids GROUP BY row_id", "tok_ids")
add("sim", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY similarity DESC, case_id) AS rank
  FROM (SELECT i.row_id, i.case_id, c.label, n / (a.size + b.size - n) AS similarity
    FROM (SELECT x.row_id, y.row_id AS case_id, count(*) AS n FROM tok_ids x JOIN tok_ids y USING (token)
          WHERE y.row_id IN (SELECT case_id FROM case_ids) GROUP BY ALL) i
    JOIN sizes a ON a.row_id = i.row_id JOIN sizes b ON b.row_id = i.case_id
    JOIN case_ids c ON c.case_id = i.case_id) WHERE similarity >= 5e-1) WHERE rank <= 3""", "tok_ids", "sizes", "case_ids")
add("sim_any", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY similarity DESC, case_id) AS rank
  FROM (SELECT i.row_id, i.case_id, c.label, n / (a.size + b.size - n) AS similarity
    FROM (SELECT x.row_id, y.row_id AS case_id, count(*) AS n FROM tok_ids x JOIN tok_ids y USING (token)
          WHERE y.row_id IN (SELECT case_id FROM case_ids) GROUP BY ALL) i
    JOIN sizes a ON a.row_id = i.row_id JOIN sizes b ON b.row_id = i.case_id
    JOIN case_ids c ON c.case_id = i.case_id)) WHERE rank <= 3""", "tok_ids", "sizes", "case_ids")
add("xb", f"""SELECT row_id, prediction, confidence, risk_score, url_score FROM (
  {decide_sql(source='(SELECT *, greatest(0e0, least(1e0, raw_score)) AS url_score FROM score_s)')})""", "score_s")
add("casescore", """SELECT s.row_id, x.token, max(similarity * CASE WHEN s.label = prediction THEN 1e0 ELSE 72e-2 END) AS score
  FROM sim s JOIN xb USING (row_id) JOIN tok_ids x ON x.row_id = s.row_id
  JOIN tok_ids y ON y.row_id = s.case_id AND y.token = x.token GROUP BY ALL""", "sim", "xb", "tok_ids")

# Character weights of the rule, from the number of occurrences of each n-gram.
_GW = "CAST((c * 7 + 3) % 23 - 11 AS DOUBLE) / 10"
add("occ", """SELECT row_id, i AS start_at, k AS size, 'char:' || lower(substr(dec, i, k)) AS gram FROM (
  SELECT row_id, dec, k, unnest(range(1, length(dec) - k + 2)) AS i FROM url_c, (SELECT unnest([3, 4]) AS k)
  WHERE length(dec) >= 4)""", "url_c")
add("gw", f"SELECT gram, {_GW} AS weight FROM (SELECT gram, count(*) AS c FROM occ GROUP BY gram)", "occ")
add("salpos", """SELECT row_id, pos, s / max(s) OVER (PARTITION BY row_id) AS s FROM (
  SELECT row_id, pos, sum(abs(weight)) AS s FROM (
    SELECT row_id, unnest(range(start_at, start_at + size)) AS pos, weight FROM occ JOIN gw USING (gram)) GROUP BY ALL)""", "occ", "gw")
add("sal", "SELECT row_id, list(s ORDER BY pos) AS scores FROM salpos GROUP BY row_id", "salpos")
add("xt0", f"""SELECT row_id, token, count(*) AS cnt, {VALUE_SQL} AS display, lower({VALUE_SQL}) AS low,
  {_CATEGORY_SQL} AS category FROM (SELECT row_id, unnest(tokens) AS token FROM url_tok) GROUP BY ALL""", "url_tok")
add("xsal", """SELECT t.*, coalesce(list_max(list_transform(list_filter(range(1, length(dec) - length(low) + 2),
    lambda i: substr(dec, i, length(low)) = low), lambda i: list_sum(scores[i:i + length(low) - 1]) / length(low))), 0e0) AS sal
  FROM xt0 t JOIN url_c USING (row_id) JOIN sal USING (row_id)""", "xt0", "url_c", "sal")
add("wide", "SELECT token, " + ", ".join(f"max(score) FILTER (scope = '{s}') AS d_{s}" for s in ["common", *K.MALICIOUS])
    + " FROM dict_r GROUP BY token", "dict_r")
_top = lambda s: f"coalesce((SELECT max(abs(score)) FROM dict_r WHERE scope = {s}), 0e0)"
add("scopemax", "SELECT scope, max(abs(score)) AS m FROM dict_r GROUP BY scope", "dict_r")
_cls = "CASE prediction " + " ".join(f"WHEN '{c}' THEN d_{c}" for c in K.MALICIOUS) + " ELSE 0e0 END"
_factor = f"""greatest(45e-2, least(145e-2, 1e0 + CASE WHEN token IN {inlist(K.HIGH_RISK_FEATURES)} THEN 25e-2 ELSE 0e0 END
  + CASE WHEN low IN {inlist(K.RISK_AMPLIFIER_WORDS)} THEN 2e-1 ELSE 0e0 END
  + CASE WHEN starts_with(token, 'qkey:') OR starts_with(token, 'qv:') THEN 8e-2 ELSE 0e0 END
  - CASE WHEN token IN ('tok:https', 'tld:https') THEN 5e-2 ELSE 0e0 END))"""
add("xd", f"""SELECT *, greatest(d_common, cls) AS raw,
  CASE WHEN raw > 0 THEN least(1e0, raw / greatest(1e0, coalesce(mc, 0e0), coalesce(mp, 0e0))) ELSE 0e0 END AS dscore,
  CASE WHEN raw > 0 THEN CASE WHEN cls >= d_common AND cls > 0 THEN 'class_specific' ELSE 'common_malicious' END END AS dsource
  FROM (SELECT x.*, b.prediction, coalesce(d_common, 0e0) AS d_common,
    {', '.join(f'coalesce(d_{c}, 0e0) AS d_{c}' for c in K.MALICIOUS)}, coalesce({_cls}, 0e0) AS cls, {_factor} AS factor,
    (SELECT m FROM scopemax WHERE scope = 'common') AS mc, p.m AS mp, coalesce(c.score, 0e0) AS cscore
    FROM xsal x JOIN xb b USING (row_id) LEFT JOIN wide USING (token) LEFT JOIN scopemax p ON p.scope = b.prediction
    LEFT JOIN casescore c ON c.row_id = x.row_id AND c.token = x.token)""", "xsal", "xb", "wide", "scopemax", "casescore")
_low = f"low IN {inlist(K.LOW_INFORMATION_DISPLAYS)}"
add("xs", f"""SELECT row_id, prediction, token, display, low, category, cnt, round((sal)::DECIMAL(18, 9), 4)::DOUBLE AS sal, round((dscore)::DECIMAL(18, 9), 4)::DOUBLE AS dscore,
  dsource, round((cscore)::DECIMAL(18, 9), 4)::DOUBLE AS cscore, round((factor)::DECIMAL(18, 9), 4)::DOUBLE AS factor, round((score)::DECIMAL(18, 9), 4)::DOUBLE AS score,
  CASE WHEN round((dscore)::DECIMAL(18, 9), 4)::DOUBLE > 0 OR round((cscore)::DECIMAL(18, 9), 4)::DOUBLE > 0 THEN 'strong'
       WHEN factor > 1 AND NOT {_low} AND (token IN {inlist(K.HIGH_RISK_FEATURES)} OR low IN {inlist(K.RISK_AMPLIFIER_WORDS)}
            OR token IN ('tok:https', 'tld:https')) THEN 'medium' ELSE 'weak' END AS strength,
  trim(display) <> '' AND category <> 'character_ngram' AND NOT {_low} AND length(trim(display)) > 1 AS meaningful
  FROM (SELECT *, greatest(0e0, least(1e0, (45e-2 * sal + 3e-1 * dscore + 25e-2 * cscore) * factor)) AS score FROM xd)
  WHERE NOT ({_low} AND dscore <= 0 AND cscore <= 0)
    AND NOT (length(display) <= 1 AND dscore <= 0 AND cscore <= 0 AND factor <= 1)
    AND NOT (category = 'character_ngram' AND dscore <= 0 AND cscore <= 0 AND factor <= 1)
    AND (score > 0 OR dscore > 0)""", "xd")
add("xtop", """SELECT *, row_number() OVER (PARTITION BY row_id, kind ORDER BY score DESC, token) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY row_id, kind, CASE WHEN kind = 'top' THEN low ELSE token END
                               ORDER BY score DESC, token) AS r
  FROM (SELECT *, CASE WHEN meaningful THEN 'top' WHEN category = 'character_ngram' THEN 'internal' END AS kind FROM xs)
  WHERE kind IS NOT NULL) WHERE r = 1""", "xs")
add("xtop10", """SELECT t.*, e.is_ipv4 AND regexp_matches(display, '^\\d{1,3}$')
    AND regexp_matches(token, '^(domain|dpart|tld|tldpart|sld|tok):') AND kind = 'top' AS octet
  FROM xtop t JOIN ev_p e USING (row_id) WHERE rank <= 10""", "xtop", "ev_p")



def gram_weights(spark, sf):
    grams = exploded(M.with_grams(views.urls(spark, sf)), F.col("grams"), "gram")
    return grams.groupBy("gram").agg(F.count("*").alias("c")).select("gram", F.expr(_GW).alias("weight"))


def saliency(spark, sf):
    return X.char_saliency(views.urls(spark, sf), gram_weights(spark, sf))


def decided(spark, sf):
    """URL decisions by the fixed lexicon, without page."""
    d = D.decide(E.url_evidence(views.urls(spark, sf)))
    return d.select("row_id", "url", "prediction", "confidence", "risk_score", "url_score", "url_reasons")


def cases(spark, sf):
    return S.case_index(views.urls(spark, sf), "row_id")


def explained_tokens(spark, sf, dict_df):
    """Token rows with saliency, dictionary values and case scores."""
    d = with_tokens(decided(spark, sf).select("row_id", "url", "prediction")).join(saliency(spark, sf), "row_id")
    return X.token_rows(S.similar_cases(d, cases(spark, sf)), dict_df)


@register("similar_cases", query(
    "SELECT row_id, rank::INTEGER AS rank, case_id, label, round((similarity)::DECIMAL(18, 9), 6)::DOUBLE AS similarity FROM sim_any", "sim_any"))
def similar_cases(spark, sf):
    d = S.similar_cases(with_tokens(views.urls(spark, sf)), cases(spark, sf), floor=0.0)
    ranked = F.transform("cases", lambda c, i: F.struct((i + 1).alias("rank"), c["case_id"].alias("case_id"),
                                                       c["label"].alias("label"), fixed(c["similarity"], 6).alias("similarity")))
    return exploded(d, ranked, "c", "row_id").select("row_id", "c.*")


@register("case_token_scores", query("SELECT row_id, token, round((score)::DECIMAL(18, 9), 6)::DOUBLE AS score FROM casescore", "casescore"))
def case_token_scores(spark, sf):
    d = with_tokens(decided(spark, sf).select("row_id", "url", "prediction"))
    d = S.similar_cases(d, cases(spark, sf))
    scored = F.transform(F.array_distinct("tokens"), lambda t: F.struct(
        t.alias("token"), fixed(S.case_score(t, F.col("cases"), F.col("prediction")), 6).alias("score")))
    return exploded(d, scored, "s", "row_id").select("row_id", "s.*").filter("score > 0")


@register("xai_char_saliency", query("SELECT row_id, pos::INTEGER AS pos, round((s)::DECIMAL(18, 9), 6)::DOUBLE AS score FROM salpos", "salpos"))
def xai_char_saliency(spark, sf):
    scores = F.transform("char_scores", lambda s, i: F.struct((i + 1).alias("pos"), fixed(s, 6).alias("score")))
    return exploded(saliency(spark, sf), scores, "c", "row_id").select("row_id", "c.*")


@register("xai_substring", query("SELECT row_id, token, round((sal)::DECIMAL(18, 9), 6)::DOUBLE AS saliency FROM xsal", "xsal"))
def xai_substring(spark, sf):
    d = with_tokens(views.urls(spark, sf)).join(saliency(spark, sf), "row_id")
    items = F.transform(F.array_distinct("tokens"), lambda t: F.struct(
        t.alias("token"), fixed(X.substring_score(F.col("text"), F.col("char_scores"), X.feature_value(t)), 6)
        .alias("saliency")))
    return exploded(d, items, "i", "row_id").select("row_id", "i.*")


@register("xai_dictionary", query(
    """SELECT row_id, token, prediction, round((raw)::DECIMAL(18, 9), 6)::DOUBLE AS raw_score, round((dscore)::DECIMAL(18, 9), 6)::DOUBLE AS score, dsource AS source
       FROM xd WHERE raw > 0""", "xd"))
def xai_dictionary(spark, sf):
    d = with_tokens(decided(spark, sf).select("row_id", "url", "prediction"))
    t = X.dictionary_scores(X.token_rows(d, dictionary(spark, sf)))
    return t.filter("dictionary_raw_score > 0").select(
        "row_id", F.col("feature").alias("token"), "prediction", fixed(F.col("dictionary_raw_score"), 6).alias("raw_score"),
        fixed(F.col("dictionary_score"), 6).alias("score"), F.col("dictionary_source").alias("source"))


@register("xai_rule_factor", query(f"SELECT token, round(({_factor})::DECIMAL(18, 9), 6)::DOUBLE AS factor, count(*) AS n FROM xt0 GROUP BY ALL", "xt0"))
def xai_rule_factor(spark, sf):
    t = exploded(with_tokens(views.urls(spark, sf)), F.array_distinct("tokens"), "token")
    t = t.groupBy("token").agg(F.count("*").alias("n"))
    factor, _ = X.rule_factor(F.col("token"), X.feature_value(F.col("token")))
    return t.select("token", fixed(factor, 6).alias("factor"), "n")


_best3 = "greatest(d_phishing, d_defacement, d_malware)"
_lab = "CASE " + " ".join(f"WHEN d_{c} = {_best3} THEN '{c}'" for c in K.DECISION_ORDER) + " END"
add("xal", f"""SELECT *, round((al)::DECIMAL(18, 9), 4)::DOUBLE AS ral, row_number() OVER (PARTITION BY row_id ORDER BY round((al)::DECIMAL(18, 9), 4)::DOUBLE DESC, token) AS r
  FROM (SELECT row_id, token, {_lab} AS lab, {_best3} AS best,
    least(1e0, sal * least(1e0, greatest(d_common, {_best3}) / greatest(1e0, (SELECT max(m) FROM scopemax)))) AS al
    FROM xd WHERE sal > 0 AND greatest(d_common, {_best3}) > 0)""", "xd", "scopemax")


@register("xai_alignment", query(
    "SELECT row_id, round((avg(ral) FILTER (r <= 5))::DECIMAL(18, 9), 4)::DOUBLE AS alignment_score, "
    + ", ".join(f"round((coalesce(max(al) FILTER (lab = '{c}' AND best > 0), 0e0))::DECIMAL(18, 9), 4)::DOUBLE AS align_{c}" for c in K.MALICIOUS)
    + " FROM xal GROUP BY row_id", "xal"))
def xai_alignment(spark, sf):
    d = with_tokens(decided(spark, sf).select("row_id", "url", "prediction")).join(saliency(spark, sf), "row_id")
    t = X.token_rows(d, dictionary(spark, sf))
    return X.alignment(t).drop("alignment_top_matches")


@register("xai_token_scores", query(
    """SELECT row_id, token, category, cnt::INTEGER AS count, sal AS saliency, dscore AS dictionary_score, cscore AS case_score,
       factor AS rule_factor, score AS explanation_score, strength, meaningful AS human_meaningful FROM xs""", "xs"))
def xai_token_scores(spark, sf):
    t = X.token_scores(explained_tokens(spark, sf, dictionary(spark, sf)))
    return t.select("row_id", F.col("feature").alias("token"), "category", "count", "saliency", "dictionary_score",
                    "case_score", "rule_factor", "explanation_score", "strength", "human_meaningful")


@register("xai_top_evidence", query(
    """SELECT row_id, kind, rank::INTEGER AS rank, token, score AS explanation_score, strength FROM xtop10 WHERE NOT octet""",
    "xtop10"))
def xai_top_evidence(spark, sf):
    ranked = X.ranked_evidence(X.token_scores(explained_tokens(spark, sf, dictionary(spark, sf))))
    ip = decided(spark, sf).select("row_id", X.mentions_ip(F.col("url_reasons")).alias("ip"))
    d = ranked.join(ip, "row_id")
    octet = X.is_ip_octet(F.col("feature"), F.col("display"), F.col("ip")) & (F.col("kind") == "top")
    return d.filter(~octet).select("row_id", "kind", "rank", F.col("feature").alias("token"), "explanation_score", "strength")


@register("xai_confidence", query(
    """SELECT row_id, round((coalesce(mean, 0e0))::DECIMAL(18, 9), 6)::DOUBLE AS mean_top_evidence_score,
       round((least(1e0, greatest(confidence * coalesce(mean, 0e0),
             CASE WHEN prediction = 'benign' THEN 1e0 - risk_score ELSE risk_score END)))::DECIMAL(18, 9), 6)::DOUBLE AS xai_confidence
       FROM xb LEFT JOIN (SELECT row_id, avg(score) FILTER (strength IN ('strong', 'medium')) AS mean FROM (
         SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY rank) AS k FROM xtop10 WHERE kind = 'top' AND NOT octet)
         WHERE k <= 5 GROUP BY row_id) USING (row_id)""", "xb", "xtop10"))
def xai_confidence(spark, sf):
    return explained(spark, sf).select("row_id", fixed(F.col("mean_top_evidence_score"), 6).alias("mean_top_evidence_score"),
                                       fixed(F.col("xai_confidence"), 6).alias("xai_confidence"))


def explained(spark, sf):
    """Explanations of the decisions by the fixed lexicon."""
    lists = X.evidence_lists(X.token_scores(explained_tokens(spark, sf, dictionary(spark, sf))))
    return X.explain(decided(spark, sf).join(lists, "row_id", "left"))


def _fill(template, *values):
    """SQL of a text template with its places filled."""
    pieces = ["'" + p.replace("'", "''") + "'" for p in template.split("{}")]
    out = pieces[0]
    for value, piece in zip(values, pieces[1:]):
        out += f" || {value} || {piece}"
    return out


_context = (f"prediction = 'malware' AND low IN {inlist(K.MALWARE_CONTEXT_TOKENS)} AND category <> 'file_extension'")
add("terms", f"""SELECT row_id, list(display ORDER BY rank) FILTER (strength = 'strong' AND NOT ({_context})) AS strong,
  list(display ORDER BY rank) AS shown FROM xtop10 WHERE kind = 'top' AND NOT octet GROUP BY row_id""", "xtop10")
_risk = "CASE prediction " + " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in TX.RISK_LABELS.items()) + " END"
_SUMMARY_SQL = f"""SELECT row_id, prediction, top_terms, CASE
  WHEN prediction = 'benign' AND main <> '' THEN {_fill(TX.SUMMARY['benign_reasons'], 'main')}
  WHEN prediction = 'benign' THEN {_fill(TX.SUMMARY['benign'])}
  WHEN main <> '' THEN {_fill(TX.SUMMARY['risk_reasons'], _risk, 'main', 'top_terms')}
  ELSE {_fill(TX.SUMMARY['risk'], _risk, 'top_terms')} END AS summary, {_fill(TX.ALIGNMENT['none'])} AS alignment_text
  FROM (SELECT row_id, prediction, array_to_string(reasons[1:2], ' ') AS main,
          CASE WHEN len(strong) > 0 THEN array_to_string(strong[1:3], ', ')
               WHEN len(shown) > 0 THEN array_to_string(shown[1:3], ', ') ELSE {_fill(TX.SUMMARY['no_token'])} END AS top_terms
        FROM xb JOIN reason_list USING (row_id) LEFT JOIN terms USING (row_id))"""


@register("xai_summary", query(_SUMMARY_SQL, "xb", "reason_list", "terms"))
def xai_summary(spark, sf):
    return explained(spark, sf).select("row_id", "prediction", "top_terms", "summary", "alignment_text")


_source = "CASE " + " ".join(f"WHEN regexp_matches(lower(reason), '{'|'.join(w)}') THEN '{s}'" for w, s in TX.REASON_SOURCES) \
    + f" ELSE '{TX.OTHER_SOURCE}' END"


# Evidence records without page and alignment: what a row says about its reasons, and about each of its best tokens.
_ctx, _odd_words = inlist(K.MALWARE_CONTEXT_TOKENS), inlist(K.COMMON_BENIGN_CONTEXT_TOKENS)
_says = lambda texts: f"len(list_filter(reasons, lambda r: contains(lower(r), '{texts}'))) > 0"
add("xsig", f"""SELECT l.row_id, reasons, b.prediction, round(url_score, 4) AS url_score, {_says('ip address')} AS ip,
  {_says('executable file extension')} OR coalesce(ext, false) AS executable, coalesce(delivery, false) AS delivery
  FROM reason_list l JOIN xb b USING (row_id) LEFT JOIN (
    SELECT row_id, bool_or(category = 'file_extension' AND starts_with(token, 'ext:')) AS ext, bool_or(low IN {_ctx}) AS delivery
    FROM xtop10 WHERE kind = 'top' AND NOT octet GROUP BY row_id) USING (row_id)""", "reason_list", "xb", "xtop10")
_about = {k: _fill(t, "display", "strength") for k, t in TX.TOKEN_REASONS.items()}
add("xrec", f"""SELECT row_id, rank, display AS token, score, {_context} AS contextual, strength IN ('strong', 'medium') AS sure,
  strength = 'strong' AND NOT ({_context}) AS strong,
  CASE WHEN token = 'host_is_ip' THEN {_about['ip_host']} WHEN category = 'file_extension' THEN {_about['extension']}
       WHEN prediction = 'malware' AND low IN {_ctx} AND executable THEN {_about['delivery']}
       WHEN low IN {_odd_words} THEN {_about['context']} ELSE {_about['match']} END AS reason,
  CASE WHEN {_context} AND executable THEN 'contextual' WHEN low IN {_odd_words} AND strength = 'strong' THEN 'supporting'
       ELSE strength END AS strength
  FROM xtop10 JOIN (SELECT row_id, executable FROM xsig) USING (row_id) WHERE kind = 'top' AND NOT octet""", "xtop10", "xsig")
_S, _R = TX.RECORD_SOURCES, TX.RECORD_REASONS
_none = "NULL::VARCHAR AS token, NULL::VARCHAR AS strength"
_token_record = f"CASE WHEN contextual THEN '{_S['contextual']}' ELSE '{_S['token']}' END AS source, reason, token, strength, score"
_fact = lambda kind, when: (f"SELECT row_id, 'main_evidence', '{_S[kind]}', {_fill(_R[kind])}, NULL, NULL, NULL FROM xsig "  # noqa: E731
                            f"WHERE {when}")
_malware = "prediction = 'malware' AND executable AND "
_RECORDS = f"""SELECT row_id, 'main_evidence' AS list, {_source} AS source, reason, {_none}, NULL::DOUBLE AS score
  FROM (SELECT row_id, unnest(reasons[1:2]) AS reason FROM xsig)
  UNION ALL {_fact('ip', 'ip')} UNION ALL {_fact('combination', _malware + 'delivery')}
  UNION ALL {_fact('delivery', _malware + 'NOT delivery')}
  UNION ALL SELECT row_id, 'strong_evidence', {_token_record} FROM (
    SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY rank) AS k FROM xrec WHERE strong) WHERE k <= 5
  UNION ALL SELECT row_id, 'supporting_evidence', {_token_record} FROM (
    SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY rank) AS k FROM xrec WHERE sure AND NOT strong) WHERE k <= 6
  UNION ALL SELECT row_id, 'supporting_evidence', '{_S['alignment']}', {_fill(TX.ALIGNMENT['none'])}, NULL, NULL, 0e0 FROM xsig
    WHERE (SELECT count(*) FROM xrec r WHERE r.row_id = xsig.row_id AND sure AND NOT strong) <= 5
  UNION ALL SELECT row_id, 'decision_evidence', {_source} AS source, reason, {_none}, url_score
    FROM (SELECT row_id, unnest(reasons[1:4]) AS reason, url_score FROM xsig)"""


@register("xai_evidence_records", query(_RECORDS, "xsig", "xrec"))
def xai_evidence_records(spark, sf):
    d = explained(spark, sf)
    record = lambda name: lambda r: F.struct(F.lit(name).alias("list"), *[
        r[c].alias(c) for c in ("source", "reason", "token", "strength", "score")])
    lists = [F.transform(name, record(name)) for name in
             ("main_evidence", "strong_evidence", "supporting_evidence", "decision_evidence")]
    return exploded(d, F.concat(*lists), "r", "row_id").select("row_id", "r.*")


@register("xai_reason_source", query(f"SELECT reason, {_source} AS source, count(*) AS urls FROM reasons GROUP BY reason",
                                     "reasons"))
def xai_reason_source(spark, sf):
    d = exploded(decided(spark, sf), F.col("url_reasons"), "reason").groupBy("reason").agg(F.count("*").alias("urls"))
    return d.select("reason", X.reason_source(F.col("reason")).alias("source"), "urls")


@register("xai_full")
def xai_full(spark, sf):
    """Whole chain: learned dictionary, page evidence, fitted specialist, alignment, decision, explanation."""
    urls = views.urls(spark, sf)
    dict_df = dictionary(spark, sf)
    fitted = M.specialist_pipeline().fit(M.with_grams(M.specialist_sample(urls)))
    weights = M.specialist_weights(spark, fitted)
    return explain_urls(spark, urls, dict_df, weights, cases(spark, sf), page_rows(spark, sf)).select(
        "row_id", "url", F.to_json(F.struct(*X.EXPLANATION)).alias("explanation"))


def page_rows(spark, sf):
    return scored_pages(spark, sf).select((F.col("page_id") * 2).alias("row_id"), "page_score", "page_reasons", "fetched",
                                          "html_analyzed")


def explain_urls(spark, urls, dict_df, weights, case_df, pages):
    from ..plans.scoring import explain_urls as plan

    return plan(urls, dict_df, weights, case_df, pages)
