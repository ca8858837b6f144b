"""Token document frequencies, dictionaries and derived lexicons."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import terms as TM
from ..functions import tokens as T
from ..functions.url import exploded
from ..operators import lexicon as L
from . import register, views
from .sqltext import add, inlist, lit, query
from .url_queries import VALUE_SQL

MAL = K.MALICIOUS
_DF = ", ".join(f"count_if(type = '{c}') AS df_{c}" for c in K.CLASSES)
_N = ", ".join(f"count_if(type = '{c}') AS n_{c}" for c in K.CLASSES)
add("tdf", f"SELECT token, count(*) AS total_df, {_DF} FROM tok GROUP BY token", "tok")
add("totals", f"SELECT count(*) AS n, {_N} FROM urls", "urls")


def odds(inside, n_inside, outside, n_outside):
    return f"ln((({inside}) + 1e0) / (({n_inside}) + 2e0) / ((({outside}) + 1e0) / (({n_outside}) + 2e0)))"


_POS = " + ".join(f"df_{c}" for c in MAL)
_COMMON_SQL = odds(_POS, "n - n_benign", "df_benign", "n_benign")


def scored_sql(counts="tdf", totals="totals", min_df="5", keys=""):
    """Positive scores of all scopes."""
    members = [f"SELECT {keys} 'common' AS scope, token, {_COMMON_SQL} AS score FROM {counts}, {totals} "
               f"WHERE total_df >= {min_df} AND "
               + "(" + " + ".join(f"(df_{c} > 0)::INT" for c in MAL) + ") >= 2"]
    members += [f"SELECT {keys} '{c}' AS scope, token, {odds(f'df_{c}', f'n_{c}', f'total_df - df_{c}', f'n - n_{c}')}"
                f" AS score FROM {counts}, {totals} WHERE total_df >= {min_df}" for c in MAL]
    return "SELECT * FROM (" + " UNION ALL ".join(members) + ") WHERE score > 0"


def cut_sql(scored, common, per_class, keys=""):
    part = keys + "scope"
    return (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY round(score, 9) DESC, token) "
            f"AS rank FROM ({scored})) WHERE rank <= CASE WHEN scope = 'common' THEN {common} ELSE {per_class} END")


add("dict_a", cut_sql(scored_sql(), 1000, 800), "tdf", "totals")
_seeds = []
for label, terms in K.SEED_TERMS.items():
    _seeds.append(f"SELECT '{label}' AS scope, p || ':' || t AS token FROM "
                  f"(SELECT unnest({lit(K.SEED_TERM_PREFIXES)}) AS p), (SELECT unnest({lit(terms)}) AS t)")
_seeds.append("SELECT 'malware', p || ':' || t FROM "
              f"(SELECT unnest({lit(K.SEED_EXTENSION_PREFIXES)}) AS p), (SELECT unnest({lit(K.RISK_EXTENSIONS)}) AS t)")
add("seeds", " UNION ".join(_seeds))
add("dict_r", f"""SELECT *, row_number() OVER (PARTITION BY scope ORDER BY round(score, 9) DESC, token) AS rank
FROM (SELECT scope, token, max(score) AS score
      FROM (SELECT scope, token, score FROM ({cut_sql(scored_sql(min_df='3'), 1400, 1200)})
            UNION ALL SELECT scope, token, 6e0 FROM seeds) GROUP BY scope, token)""", "tdf", "totals", "seeds")

_DICT_COLS = "scope, token, round(score, 6) AS score, rank::INTEGER AS rank"


def tokens(spark, sf):
    return T.with_tokens(views.urls(spark, sf))


def _rounded(d):
    return d.select("scope", "token", F.round("score", 6).alias("score"), "rank")


@register("label_distribution", query("SELECT type, count(*) AS n FROM urls GROUP BY type", "urls"))
def label_distribution(spark, sf):
    return views.urls(spark, sf).groupBy("type").agg(F.count("*").alias("n"))


@register("token_df", query(
    "SELECT token, total_df, " + ", ".join(f"df_{c}::BIGINT AS df_{c}" for c in K.CLASSES) + " FROM tdf", "tdf"))
def token_df(spark, sf):
    return L.token_df(tokens(spark, sf), K.CLASSES)


def _scored(spark, sf):
    d = tokens(spark, sf)
    totals = L.class_totals(d, K.CLASSES)
    return L.log_odds(L.token_df(d, K.CLASSES), totals.select(F.struct(*totals.columns)).scalar(), K.CLASSES, K.BENIGN,
                      K.ADAPTIVE_PROFILE[2])


@register("risk_common", query(f"SELECT token, round(score, 6) AS score FROM ({scored_sql()}) WHERE scope = 'common'",
                               "tdf", "totals"))
def risk_common(spark, sf):
    return _scored(spark, sf).filter("scope = 'common'").select("token", F.round("score", 6).alias("score"))


@register("risk_class", query(
    f"SELECT scope, token, round(score, 6) AS score FROM ({scored_sql()}) WHERE scope <> 'common'", "tdf", "totals"))
def risk_class(spark, sf):
    return _scored(spark, sf).filter("scope <> 'common'").select("scope", "token", F.round("score", 6).alias("score"))


@register("risk_dict_adaptive", query(f"SELECT {_DICT_COLS} FROM dict_a", "dict_a"))
def risk_dict_adaptive(spark, sf):
    return _rounded(L.risk_dictionary(tokens(spark, sf)))


@register("risk_dict_rebuild", query(f"SELECT {_DICT_COLS} FROM dict_r", "dict_r"))
def risk_dict_rebuild(spark, sf):
    return _rounded(L.rebuilt_dictionary(tokens(spark, sf)))


@register("risk_seeded", query(
    """SELECT scope, token, round(r.score, 6) AS score, l.score IS NOT NULL AS learned
       FROM dict_r r JOIN seeds USING (scope, token)
       LEFT JOIN (SELECT scope, token, score FROM """ + f"({cut_sql(scored_sql(min_df='3'), 1400, 1200)})"
    + ") l USING (scope, token)", "dict_r"))
def risk_seeded(spark, sf):
    learned = L.risk_dictionary(tokens(spark, sf), K.REBUILD_PROFILE)
    seeds = L.seed_tokens(spark).withColumnRenamed("score", "seed")
    both = seeds.join(learned, ["scope", "token"], "left")
    best = F.greatest("seed", F.coalesce("score", F.lit(0.0)))
    return both.select("scope", "token", F.round(best, 6).alias("score"), F.col("score").isNotNull().alias("learned"))


@register("risk_preview", query(
    "SELECT scope, rank::INTEGER AS rank, token, round(score, 4) AS score FROM dict_a WHERE rank <= 10", "dict_a"))
def risk_preview(spark, sf):
    return L.preview(L.risk_dictionary(tokens(spark, sf)))


_VALID = f"""(length(lower(v)) BETWEEN 3 AND 32 AND regexp_matches(lower(v), '[a-z]')
 AND lower(v) NOT IN {inlist(K.NEUTRAL_URL_TERMS)})"""
_VALID_TEXT = f"""(length(lower(v)) BETWEEN 3 AND 32 AND regexp_matches(lower(v), '[a-z]')
 AND lower(v) NOT IN {inlist(K.LOW_INFORMATION_PAGE_TERMS)}
 AND NOT (regexp_matches(lower(v), '^[a-z]{{1,4}}$') AND lower(v) NOT IN {inlist(K.SUSPICIOUS_TEXT_KEYWORDS)}))"""
_WORDS = "SELECT v, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '\\s+')) AS v FROM documents) GROUP BY v"


@register("term_valid_learned", f"SELECT v AS term, n, {_VALID} AS valid FROM ({_WORDS})")
def term_valid_learned(spark, sf):
    return _words(spark, sf).withColumn("valid", TM.valid_learned_term(F.col("term")))


@register("term_valid_text", f"SELECT v AS term, n, {_VALID_TEXT} AS valid FROM ({_WORDS})")
def term_valid_text(spark, sf):
    return _words(spark, sf).withColumn("valid", TM.valid_text_term(F.col("term")))


def _words(spark, sf):
    d = exploded(views.table(spark, sf, "documents"), F.split("text", r"\s+"), "term")
    return d.groupBy("term").agg(F.count("*").alias("n"))


_THRESH = "score >= CASE WHEN scope = 'common' THEN 5e0 ELSE 4e0 END"
_TERM_PREFIX = f"split_part(token, ':', 1) IN {inlist(K.LEARNED_TERM_PREFIXES)}"
_CAT = "CASE scope " + " ".join(f"WHEN '{s}' THEN '{c}'" for s, c in L.CLASS_CATEGORY.items()) + " END"
add("lex_r", f"""SELECT DISTINCT category, term FROM (
  WITH d AS (SELECT *, {VALUE_SQL} AS v FROM dict_r WHERE {_THRESH})
  SELECT 'risk_extensions' AS category, v AS term FROM d WHERE split_part(token, ':', 1) = 'ext'
  UNION ALL SELECT 'risk_tlds', v FROM d WHERE split_part(token, ':', 1) = 'tld'
  UNION ALL SELECT {_CAT}, v FROM d WHERE {_TERM_PREFIX} AND {_VALID}
  UNION ALL SELECT 'risk_terms', v FROM d WHERE {_TERM_PREFIX} AND {_VALID}
  UNION ALL SELECT 'compressed_extensions', unnest({lit(K.COMPRESSED_EXTENSIONS)})
  UNION ALL SELECT 'impersonation_targets', unnest({lit(K.IMPERSONATION_TARGETS)})
  UNION ALL SELECT 'phishing_intent_terms', unnest({lit(K.SEED_TERMS['phishing'])})
  UNION ALL SELECT 'risk_extensions', unnest({lit(K.RISK_EXTENSIONS)}))""", "dict_r")


@register("lexicon_from_dict", query("SELECT category, term FROM lex_r", "lex_r"))
def lexicon_from_dict(spark, sf):
    return L.lexicon_from_dictionary(L.rebuilt_dictionary(tokens(spark, sf)), metadata=True)


add("page_terms", f"""SELECT DISTINCT class, term FROM (
  SELECT scope AS class, {VALUE_SQL} AS v, v AS term FROM dict_r
  WHERE scope <> 'common' AND score >= 4e0 AND {_TERM_PREFIX} AND {_VALID_TEXT}
  UNION ALL SELECT 'phishing', NULL, unnest({lit(K.SUSPICIOUS_TEXT_KEYWORDS)}))""", "dict_r")


@register("lexicon_page_terms", query("SELECT class, term FROM page_terms", "page_terms"))
def lexicon_page_terms(spark, sf):
    return L.page_terms_from_dictionary(L.rebuilt_dictionary(tokens(spark, sf)))


DOC_CLASSES = ["benign", "lowq", "toxic"]
_DOC = f"""WITH docs AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'lowq' ELSE 'benign' END
    AS type, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS words
    FROM documents JOIN labels USING (doc_id)),
  totals AS (SELECT count(*) AS n, {', '.join(f"count_if(type = '{c}') AS n_{c}" for c in DOC_CLASSES)} FROM docs),
  tdf AS (SELECT token, count(*) AS total_df, {', '.join(f"count_if(type = '{c}') AS df_{c}" for c in DOC_CLASSES)}
    FROM (SELECT type, unnest(words) AS token FROM docs) GROUP BY token),
  scored AS (SELECT * FROM (
    SELECT 'common' AS scope, token, {odds('df_lowq + df_toxic', 'n - n_benign', 'df_benign', 'n_benign')} AS score
    FROM tdf, totals WHERE total_df >= 5 AND df_lowq > 0 AND df_toxic > 0
    UNION ALL SELECT 'lowq', token, {odds('df_lowq', 'n_lowq', 'total_df - df_lowq', 'n - n_lowq')} FROM tdf, totals
    WHERE total_df >= 5
    UNION ALL SELECT 'toxic', token, {odds('df_toxic', 'n_toxic', 'total_df - df_toxic', 'n - n_toxic')}
    FROM tdf, totals WHERE total_df >= 5) WHERE score > 0)
SELECT scope, token, round(score, 6) AS score, rank::INTEGER AS rank FROM ({cut_sql('SELECT * FROM scored', 1000, 800)})"""


@register("doc_risk_lexicon", _DOC)
def doc_risk_lexicon(spark, sf):
    docs = views.table(spark, sf, "documents").select("doc_id", "text")
    labels = views.table(spark, sf, "labels").select(
        "doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "lowq").otherwise("benign")
        .alias("type"))
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: x != "")
    d = docs.join(labels, "doc_id").select("type", F.array_distinct(words).alias("tokens"))
    top_common, top_class, min_df = K.ADAPTIVE_PROFILE
    return _rounded(L.build_risk_lexicon(d, DOC_CLASSES, "benign", top_common, top_class, min_df))
