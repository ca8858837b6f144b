"""Feature builders."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import features as FE
from ..operators import lexicon as L
from ..session import staged
from . import register, views
from .lexicon_queries import tokens
from .sqltext import add, query

_cnt = lambda ch: f"length(dec) - length(replace(dec, '{ch}', ''))"
_LEX = {
    "length": "length(dec)", "digit_count": r"length(regexp_replace(dec, '[^\p{Nd}]', '', 'g'))",
    "alpha_count": r"length(regexp_replace(dec, '[^\p{L}]', '', 'g'))",
    "special_count": r"length(regexp_replace(dec, '[\p{L}\p{N}]', '', 'g'))",
    "dot_count": _cnt("."), "slash_count": _cnt("/"), "hyphen_count": _cnt("-"), "underscore_count": _cnt("_"),
    "question_count": _cnt("?"), "equal_count": _cnt("="), "amp_count": _cnt("&"), "percent_count": _cnt("%"),
    "at_count": _cnt("@"), "digit_ratio": "digit_count / greatest(length(dec), 1)",
    "alpha_ratio": "alpha_count / greatest(length(dec), 1)", "special_ratio": "special_count / greatest(length(dec), 1)",
    "has_ip": r"regexp_matches(dec, '\d{1,3}(\.\d{1,3}){3}')::INT", "has_https": "starts_with(dec, 'https://')::INT",
    "has_http": "starts_with(dec, 'http://')::INT",
}
_RATIOS = ["digit_ratio", "alpha_ratio", "special_ratio"]
add("lexf", "SELECT row_id, " + ", ".join(f"({v}) AS {k}" for k, v in _LEX.items()) + " FROM url_c", "url_c")


@register("feat_lexical", query("SELECT row_id, " + ", ".join(
    f"round({c}, 6) AS {c}" if c in _RATIOS else f"{c}::INTEGER AS {c}" for c in FE.LEXICAL) + " FROM lexf", "lexf"))
def feat_lexical(spark, sf):
    d = FE.lexical_features(views.urls(spark, sf))
    return d.select("row_id", *[F.round(c, 6).alias(c) if c in _RATIOS else F.col(c) for c in FE.LEXICAL])


_scopes = ["common", *K.MALICIOUS]
add("riskf", "SELECT row_id, " + ", ".join(
    f"coalesce(sum(score) FILTER (scope = '{s}'), 0e0) AS {s}_score, count(score) FILTER (scope = '{s}') AS {s}_count"
    for s in _scopes) + " FROM tok_ids LEFT JOIN dict_a USING (token) GROUP BY row_id", "tok_ids", "dict_a")


def adaptive(spark, sf):
    return staged(L.risk_dictionary(tokens(spark, sf)))


@register("feat_risk", query("SELECT row_id, " + ", ".join(
    f"round({s}_score, 6) AS {s}_score, {s}_count" for s in _scopes) + " FROM riskf", "riskf"))
def feat_risk(spark, sf):
    t = tokens(spark, sf)
    d = FE.risk_features(t, L.risk_dictionary(t))
    return d.select("row_id", *[F.round(c, 6).alias(c) if c.endswith("score") else F.col(c) for c in FE.risk_columns()])


_POL = {
    "url_length": "length(dec)", "host_length": "length(host)", "path_length": "length(lpath)",
    "query_length": "length(query)", "dot_count": _cnt("."), "hyphen_count": _cnt("-"), "underscore_count": _cnt("_"),
    "at_count": _cnt("@"), "percent_count": _cnt("%"), "equal_count": _cnt("="), "amp_count": _cnt("&"),
    "domain_part_count": "len(list_filter(string_split(host, '.'), lambda x: x <> ''))", "has_query": "query <> ''",
    "has_path": "lpath NOT IN ('', '/')", "root_or_empty_path": "lpath IN ('', '/') AND query = ''",
    "short_url_le35": "length(dec) <= 35", "short_url_le50": "length(dec) <= 50", "known_safe_domain_flag": "0",
    "known_safe_risky_signal": "0", "education_tld_flag": "ends_with(host, '.ac.kr') OR ends_with(host, '.edu')",
    "government_tld_flag": "ends_with(host, '.go.kr') OR ends_with(host, '.gov')",
    "korea_company_tld_flag": "ends_with(host, '.co.kr')",
}
add("polf", "SELECT row_id, url, " + ", ".join(f"({v})::DOUBLE AS {k}" for k, v in _POL.items())
    + """ FROM (SELECT row_id, url, dec, lower(path) AS lpath, lower(query) AS query,
     trim(regexp_replace(split_part(split_part(lnetloc, '@', -1), ':', 1), '^www[.]', ''), '.') AS host FROM url_p)""",
    "url_p")


@register("feat_policy", query("SELECT row_id, " + ", ".join(FE.POLICY) + " FROM polf", "polf"))
def feat_policy(spark, sf):
    return FE.policy_features(views.urls(spark, sf)).select("row_id", *FE.POLICY)


_p = [f"p_{c}" for c in K.CLASSES]
_ps = f"list_reverse_sort([{', '.join(_p)}])"
_raw = "CASE " + " ".join(f"WHEN p_{c} = greatest({', '.join(_p)}) THEN '{c}'" for c in K.CLASSES) + " END"
_META = ["p_benign", "p_phishing", "p_phishing - p_benign", "abs(p_phishing - p_benign)", f"{_ps}[1]",
         f"{_ps}[1] - {_ps}[2]", f"(({_raw}) = 'benign')::INT::DOUBLE", f"(({_raw}) = 'phishing')::INT::DOUBLE", "t_prob",
         "t_prob - p_phishing", "abs(t_prob - p_phishing)"]
add("metaf", "SELECT row_id, " + ", ".join(f"{v} AS {k}" for k, v in zip(FE.META_PROBABILITY, _META)) + ", "
    + ", ".join(FE.POLICY) + " FROM probs JOIN (SELECT * EXCLUDE (url) FROM polf) USING (row_id)", "probs", "polf")


@register("feat_meta_gate", query("SELECT row_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in FE.META_FEATURES)
                                  + " FROM metaf", "metaf"))
def feat_meta_gate(spark, sf):
    from ..operators import model as M

    d = M.argmax_class(views.probabilities(spark, sf), "raw_pred")
    return FE.meta_gate_features(d).select("row_id", *[F.round(c, 6).alias(c) for c in FE.META_FEATURES])


add("tf", "SELECT row_id, token, count(*) AS tf FROM (SELECT row_id, unnest(tokens) AS token FROM url_tok) GROUP BY ALL",
    "url_tok")
add("vocab", """SELECT token, df, ctf, ln((n + 1e0) / (df + 1e0)) + 1e0 AS idf FROM (
  SELECT token, count(*) AS df, sum(tf)::BIGINT AS ctf FROM tf GROUP BY token), (SELECT count(*) AS n FROM urls)
  WHERE df >= 3 AND df <= 95e-2 * n ORDER BY ctf DESC, token LIMIT 50000""", "tf", "urls")
add("tfidf", """SELECT row_id, token, v / sqrt(sum(v * v) OVER (PARTITION BY row_id)) AS value
  FROM (SELECT row_id, token, tf * idf AS v FROM tf JOIN vocab USING (token))""", "tf", "vocab")


@register("feat_tfidf", query("SELECT row_id, token, round(value, 6) AS value FROM tfidf", "tfidf"))
def feat_tfidf(spark, sf):
    t = tokens(spark, sf)
    return FE.tfidf(t, FE.tfidf_vocabulary(t)).select("row_id", "token", F.round("value", 6).alias("value"))


# The frozen vocabulary comes from the benign URLs; all URLs are transformed with it.
add("vocab_b", """SELECT token, ln((n + 1e0) / (df + 1e0)) + 1e0 AS idf FROM (
  SELECT token, count(*) AS df, sum(tf) AS ctf FROM tf JOIN urls USING (row_id) WHERE type = 'benign' GROUP BY token),
  (SELECT count(*) AS n FROM urls WHERE type = 'benign')
  WHERE df >= 3 AND df <= 95e-2 * n ORDER BY ctf DESC, token LIMIT 50000""", "tf", "urls")


@register("feat_tfidf_apply", query(
    """SELECT row_id, token, round(v / sqrt(sum(v * v) OVER (PARTITION BY row_id)), 6) AS value
       FROM (SELECT row_id, token, tf * idf AS v FROM tf JOIN vocab_b USING (token))""", "tf", "vocab_b"))
def feat_tfidf_apply(spark, sf):
    t = tokens(spark, sf)
    vocab = FE.tfidf_vocabulary(t.filter("type = 'benign'"))
    return FE.tfidf(t, vocab).select("row_id", "token", F.round("value", 6).alias("value"))


add("dense", "SELECT row_id, " + ", ".join(f"{c}::DOUBLE AS {c}" for c in FE.DENSE) + " FROM lexf JOIN riskf USING (row_id)",
    "lexf", "riskf")
_unp = " UNION ALL ".join(
    f"SELECT row_id, '{c}' AS feature, ({c} - m) / coalesce(nullif(s, 0e0), 1e0) AS value FROM dense, "
    f"(SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM dense)" for c in FE.DENSE)
add("scaled", _unp, "dense")


@register("feat_scaled", query("SELECT row_id, feature, round(value, 6) + 0e0 AS value FROM scaled", "scaled"))
def feat_scaled(spark, sf):
    t = tokens(spark, sf)
    dense = FE.dense_features(t, adaptive(spark, sf))
    return FE.scaled(dense, FE.scaler(dense)).select("row_id", "feature", (F.round("value", 6) + 0.0).alias("value"))


@register("feat_long", query(
    """SELECT row_id, 'tfidf:' || token AS feature, round(value, 6) AS value FROM tfidf
       UNION ALL SELECT row_id, 'dense:' || feature, round(value, 6) + 0e0 FROM scaled""", "tfidf", "scaled"))
def feat_long(spark, sf):
    t = tokens(spark, sf)
    dense = FE.dense_features(t, adaptive(spark, sf))
    d = FE.feature_table(FE.tfidf(t, FE.tfidf_vocabulary(t)), FE.scaled(dense, FE.scaler(dense)))
    return d.select("row_id", "feature", (F.round("value", 6) + 0.0).alias("value"))


@register("label_index", query(
    "SELECT row_id, type, dense_rank() OVER (ORDER BY type)::INTEGER - 1 AS label_id FROM urls", "urls"))
def label_index(spark, sf):
    u = views.urls(spark, sf)
    return FE.encode_labels(u, FE.label_index(u)).select("row_id", "type", "label_id")


@register("class_weights", query(
    """SELECT type, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight
       FROM (SELECT type, count(*) AS n FROM urls GROUP BY type)""", "urls"))
def class_weights(spark, sf):
    return FE.class_weights(views.urls(spark, sf)).select("type", "n", F.round("weight", 6).alias("weight"))
