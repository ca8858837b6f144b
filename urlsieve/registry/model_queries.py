"""Gates, fusion, sparse scoring, fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import features as FE
from ..operators import model as M
from ..session import staged
from . import register, views
from .evidence_queries import dictionary
from .feature_queries import _raw, tokens
from .sqltext import add, query

_P = {i: f"p_{c}" for i, c in enumerate(K.CLASSES)}
_ranked = "list_reverse_sort([" + ", ".join(f"{{'p': p_{c}, 'i': {i}, 'c': '{c}'}}" for i, c in enumerate(K.CLASSES)) + "])"
add("gate", f"""SELECT *, r[1].p - r[2].p AS top_margin, {_raw} AS raw_pred,
  CASE WHEN {_raw} = 'phishing' AND (p_phishing < 55e-2 OR r[1].p - r[2].p < 8e-2) THEN r[2].c ELSE {_raw} END AS base_pred
  FROM (SELECT *, {_ranked} AS r FROM probs)""", "probs")
add("cand", """SELECT *, base_pred IN ('benign', 'phishing') AND (abs(p_benign - p_phishing) <= 2e-1
  OR p_phishing >= 25e-2 OR base_pred = 'phishing') AS is_candidate FROM gate""", "gate")
add("hybrid", """SELECT *, CASE WHEN is_candidate AND t_prob >= 6e-1 THEN 'phishing'
  WHEN is_candidate AND t_prob <= 35e-2 THEN 'benign' ELSE base_pred END AS final_pred,
  is_candidate AND t_prob >= 6e-1 AND base_pred <> 'phishing' AS promoted,
  is_candidate AND t_prob <= 35e-2 AND base_pred = 'phishing' AS demoted FROM cand""", "cand")


def gated(spark, sf):
    return M.candidates(M.phishing_gate(views.probabilities(spark, sf)))


@register("model_gate", query("SELECT row_id, raw_pred, base_pred, round(top_margin, 6) AS top_margin FROM gate", "gate"))
def model_gate(spark, sf):
    return gated(spark, sf).select("row_id", "raw_pred", "base_pred", F.round("top_margin", 6).alias("top_margin"))


@register("fusion_candidates", query("SELECT row_id, base_pred, is_candidate FROM cand", "cand"))
def fusion_candidates(spark, sf):
    return gated(spark, sf).select("row_id", "base_pred", "is_candidate")


def hybrid(spark, sf):
    """The specialist's probabilities are a stored table, joined where rows are candidates or need a meta score."""
    d = gated(spark, sf)
    stored = d.select("row_id", "t_prob")
    return M.hybrid_fusion(M.with_specialist(d.drop("t_prob"), stored))


@register("decide_hybrid", query("SELECT row_id, base_pred, final_pred, promoted, demoted FROM hybrid", "hybrid"))
def decide_hybrid(spark, sf):
    return hybrid(spark, sf).select("row_id", "base_pred", "final_pred", "promoted", "demoted")


# Meta-gate coefficients: means and deviations of the features themselves, weights by rule of position.
_W = {c: ((7 * i) % 11 - 5) / 10 for i, c in enumerate(FE.META_FEATURES)}
_BIAS = 0.25


def coefficients(d):
    """(feature, mean, sd, weight): the scaler fitted on the rows, with the weights of the rule."""
    fit = FE.scaler(FE.meta_gate_features(d), FE.META_FEATURES)
    items = [F.struct(F.lit(c).alias("feature"), F.col("mean_" + c).alias("mean"), F.col("sd_" + c).alias("sd"),
                      F.lit(_W[c]).alias("weight")) for c in FE.META_FEATURES]
    bias = F.struct(F.lit("(intercept)").alias("feature"), F.lit(0.0).alias("mean"), F.lit(1.0).alias("sd"),
                    F.lit(_BIAS).alias("weight"))
    return fit.select(F.inline(F.array(*items, bias)))


_margin = " + ".join([f"{_BIAS}::DOUBLE"] + [
    f"(m.{c} - f.mean_{c}) / coalesce(nullif(f.sd_{c}, 0e0), 1e0) * ({_W[c]})::DOUBLE" for c in FE.META_FEATURES])
add("metas", f"""SELECT h.*, raw_pred IN ('benign', 'phishing') OR final_pred IN ('benign', 'phishing') AS meta_used,
  CASE WHEN raw_pred IN ('benign', 'phishing') OR final_pred IN ('benign', 'phishing') THEN 1e0 / (1e0 + exp(-({_margin}))) END
    AS meta_score,
  coalesce(meta_used AND final_pred = 'phishing' AND meta_score < 7e-1, false) AS meta_demoted,
  CASE WHEN meta_demoted THEN 'benign' ELSE final_pred END AS meta_pred
  FROM hybrid h JOIN metaf m USING (row_id),
  (SELECT {', '.join(f'avg({c}) AS mean_{c}, stddev_pop({c}) AS sd_{c}' for c in FE.META_FEATURES)} FROM metaf) f""",
    "hybrid", "metaf")


def meta(spark, sf):
    d = hybrid(spark, sf)
    return M.meta_gate(d, coefficients(d))


@register("meta_gate_apply", query(
    "SELECT row_id, meta_used, round(meta_score, 6) AS meta_score, meta_demoted, meta_pred FROM metas", "metas"))
def meta_gate_apply(spark, sf):
    return meta(spark, sf).select("row_id", "meta_used", F.round("meta_score", 6).alias("meta_score"), "meta_demoted",
                                  "meta_pred")


@register("fusion_stats", query(
    """SELECT count_if(is_candidate)::BIGINT AS transformer_used_count, count_if(promoted)::BIGINT AS transformer_promote_count,
       count_if(demoted)::BIGINT AS transformer_demote_count,
       round(coalesce(avg(t_prob) FILTER (is_candidate), 0e0), 6) AS mean_transformer_phish_prob,
       count_if(meta_used)::BIGINT AS meta_gate_used_count, count_if(meta_demoted)::BIGINT AS meta_gate_to_benign_count,
       0::BIGINT AS meta_gate_to_phishing_count FROM metas""", "metas"))
def fusion_stats(spark, sf):
    d = M.fusion_stats(meta(spark, sf))
    return d.withColumn("mean_transformer_phish_prob", F.round("mean_transformer_phish_prob", 6))


# Sparse linear scoring: TF-IDF features, weights by rule from the vocabulary's document frequencies.
_WEIGHT = "CAST((df * {a} + {b}) % 17 AS DOUBLE) / 8 - 1"
_AB = {"benign": (3, 1), "defacement": (5, 2), "malware": (7, 3), "phishing": (11, 4)}
add("weights", " UNION ALL ".join(
    f"SELECT token AS feature, '{c}' AS class, {_WEIGHT.format(a=a, b=b)} AS weight FROM vocab"
    for c, (a, b) in _AB.items()), "vocab")
add("margin", """SELECT row_id, class, sum(value * weight) AS margin FROM tfidf JOIN weights ON feature = token
  GROUP BY row_id, class""", "tfidf", "weights")


def linear_model(spark, sf):
    """TF-IDF features in long form and the weights of the rule."""
    t = tokens(spark, sf)
    vocab = FE.tfidf_vocabulary(t)
    features = FE.tfidf(t, vocab).withColumnRenamed("token", "feature")
    items = [F.struct(F.lit(c).alias("class"), F.expr(_WEIGHT.format(a=a, b=b)).alias("weight"))
             for c, (a, b) in _AB.items()]
    return t, features, vocab.select(F.col("token").alias("feature"), F.inline(F.array(*items)))


@register("model_margin", query(
    """SELECT row_id, class, round(margin, 6) AS margin,
       round(1e0 / (1e0 + exp(-margin)) / sum(1e0 / (1e0 + exp(-margin))) OVER (PARTITION BY row_id), 6) AS p FROM margin""",
    "margin"))
def model_margin(spark, sf):
    _, features, weights = linear_model(spark, sf)
    d = M.one_vs_rest(M.margins(features, weights))
    return d.select("row_id", "class", F.round("margin", 6).alias("margin"), F.round("p", 6).alias("p"))


add("balance", """SELECT type, (SELECT count(*) FROM urls) / (count(*) OVER () * n) AS sample_weight
  FROM (SELECT type, count(*) AS n FROM urls GROUP BY type)""", "urls")


@register("model_grad_step", query(
    """SELECT feature, class, round(weight * (1 - 5e-1 * 1e-5) - 5e-1 * coalesce(g, 0e0) / (SELECT count(*) FROM urls), 6) + 0e0
         AS weight
       FROM weights LEFT JOIN (
         SELECT token AS feature, class, sum(e * value) AS g FROM tfidf JOIN (
           SELECT row_id, class, (1e0 / (1e0 + exp(-margin)) - (type = class)::INT::DOUBLE) * sample_weight AS e
           FROM margin JOIN urls USING (row_id) JOIN balance USING (type)) USING (row_id)
         GROUP BY ALL) USING (feature, class)""", "weights", "margin", "balance", "tfidf", "urls"))
def model_grad_step(spark, sf):
    t, features, weights = linear_model(spark, sf)
    balance = FE.class_weights(t).select("type", F.col("weight").alias("sample_weight"))
    labels = t.join(balance, "type").select("row_id", F.col("type").alias("label"), "sample_weight")
    d = M.gradient_step(features, weights, labels, rate=0.5)
    return d.select("feature", "class", (F.round("weight", 6) + 0.0).alias("weight"))


@register("specialist_sample", query(
    """SELECT row_id, type, (type = 'phishing')::INTEGER AS binary_label FROM (
       SELECT *, row_number() OVER (PARTITION BY type ORDER BY md5(row_id || '|' || url || '#42'), row_id) AS r,
              least((SELECT count(*) FROM urls WHERE type = 'phishing'), (SELECT count(*) FROM urls WHERE type = 'benign'),
                    30000) AS n FROM urls WHERE type IN ('benign', 'phishing')) WHERE r <= n""", "urls"))
def specialist_sample(spark, sf):
    return M.specialist_sample(views.urls(spark, sf)).select("row_id", "type", "binary_label")


@register("model_scores")
def model_scores(spark, sf):
    t = tokens(spark, sf)
    train = staged(M.base_training(t, dictionary(spark, sf)))
    d = M.scored(M.base_pipeline(FE.tfidf_vocabulary(t), FE.scaler(train)).fit(train), train)
    return M.argmax_class(d, "prediction").select(
        "row_id", "type", "prediction", *[F.round("p_" + c, 6).alias("p_" + c) for c in K.CLASSES])


@register("specialist_scores")
def specialist_scores(spark, sf):
    urls = views.urls(spark, sf)
    model = M.specialist_pipeline().fit(M.with_grams(M.specialist_sample(urls)))
    return M.specialist_scores(model, urls).select("row_id", F.round("t_prob", 6).alias("t_prob"))
