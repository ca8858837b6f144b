"""Class probabilities, gates, specialist fusion, sparse scoring and gradient steps."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import (
    CountVectorizer,
    CountVectorizerModel,
    ElementwiseProduct,
    Normalizer,
    SQLTransformer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.url import char_ngrams, clean_url
from . import features as FE


def argmax_class(d: DataFrame, out: str, classes: list[str] = K.CLASSES) -> DataFrame:
    """Class of the largest p_<class>; the first class wins a tie."""
    best = F.greatest(*["p_" + c for c in classes])
    label = F.lit(None).cast("string")
    for c in reversed(classes):
        label = F.when(F.col("p_" + c) == best, c).otherwise(label)
    return d.withColumn(out, label)


def phishing_gate(d: DataFrame, min_prob: float = K.GATE_MIN_PROB, min_margin: float = K.GATE_MIN_MARGIN) -> DataFrame:
    """Add raw_pred and base_pred: a weak phishing arg-max falls to the runner-up."""
    d = argmax_class(d, "raw_pred")
    # Among equal probabilities the later class ranks first, as in a reversed ascending sort.
    ranked = F.sort_array(F.array(*[F.struct(F.col("p_" + c).alias("p"), F.lit(i).alias("i"), F.lit(c).alias("c"))
                                    for i, c in enumerate(K.CLASSES)]), False)
    d = d.withColumn("_r", ranked)
    margin = F.col("_r")[0]["p"] - F.col("_r")[1]["p"]
    weak = (F.col("p_phishing") < min_prob) | (margin < min_margin)
    return (d.withColumn("top_margin", margin)
            .withColumn("base_pred", F.when((F.col("raw_pred") == K.PHISHING) & weak, F.col("_r")[1]["c"])
                        .otherwise(F.col("raw_pred"))).drop("_r"))


def candidates(d: DataFrame) -> DataFrame:
    """Add is_candidate: rows the specialist must score."""
    near = F.abs(F.col("p_benign") - F.col("p_phishing")) <= K.GRAY_ZONE
    return d.withColumn("is_candidate", F.col("base_pred").isin(K.BENIGN, K.PHISHING) & (
        near | (F.col("p_phishing") >= K.SPECIALIST_MIN_PROB) | (F.col("base_pred") == K.PHISHING)))


def hybrid_fusion(d: DataFrame, t_prob: str = "t_prob") -> DataFrame:
    """Add final_pred, promoted and demoted; only candidates listen to the specialist."""
    t, base = F.col(t_prob), F.col("base_pred")
    active = F.col("is_candidate") & t.isNotNull()
    up, down = active & (t >= K.SPECIALIST_PHISHING), active & (t <= K.SPECIALIST_BENIGN)
    return (d.withColumn("final_pred", F.when(up, K.PHISHING).when(down, K.BENIGN).otherwise(base))
            .withColumn("promoted", F.coalesce(up & (base != K.PHISHING), F.lit(False)))
            .withColumn("demoted", F.coalesce(down & (base == K.PHISHING), F.lit(False))))


def with_specialist(d: DataFrame, scores: DataFrame, key: str = "row_id", out: str = "t_prob") -> DataFrame:
    """Attach stored specialist probabilities; a value already present is kept."""
    stored = scores.select(key, F.col("t_prob").alias("_stored"))
    d = d.join(stored, key, "left")
    present = F.col(out) if out in d.columns else F.lit(None).cast("double")
    return d.withColumn(out, F.coalesce(present, "_stored")).drop("_stored")


def meta_gate(d: DataFrame, coefficients: DataFrame, key: str = "row_id",
              threshold: float = K.META_GATE_THRESHOLD) -> DataFrame:
    """Add meta_used, meta_score and meta_pred: phishing with a low meta score becomes benign.

    `coefficients` is (feature, mean, sd, weight) with one row "(intercept)"; it holds 34 rows.
    """
    used = (F.col("raw_pred").isin(K.BENIGN, K.PHISHING) | F.col("final_pred").isin(K.BENIGN, K.PHISHING))
    rows = coefficients.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "sd", "weight"))))
                            .alias("m")).scalar()
    d = FE.meta_gate_features(d).withColumn("_m", rows)
    term = lambda c: (F.col(c) - F.col("_m")[c]["mean"]) / F.coalesce(
        F.nullif(F.col("_m")[c]["sd"], F.lit(0.0)), F.lit(1.0)) * F.col("_m")[c]["weight"]
    margin = sum((term(c) for c in FE.META_FEATURES), F.col("_m")["(intercept)"]["weight"])
    d = d.withColumn("meta_used", used).withColumn("meta_score", F.when(used, 1.0 / (1.0 + F.exp(-margin))))
    demote = used & (F.col("final_pred") == K.PHISHING) & (F.col("meta_score") < threshold)
    return (d.withColumn("meta_demoted", F.coalesce(demote, F.lit(False)))
            .withColumn("meta_pred", F.when(F.col("meta_demoted"), K.BENIGN).otherwise(F.col("final_pred")))
            .drop("_m", *FE.META_FEATURES))


def fusion_stats(d: DataFrame) -> DataFrame:
    """One row of counters over fused rows; the mean is 0 when no specialist ran."""
    aggs = [F.count_if("is_candidate").alias("transformer_used_count"),
            F.count_if("promoted").alias("transformer_promote_count"),
            F.count_if("demoted").alias("transformer_demote_count"),
            F.coalesce(F.avg(F.when(F.col("is_candidate"), F.col("t_prob"))), F.lit(0.0))
            .alias("mean_transformer_phish_prob")]
    if "meta_used" in d.columns:
        aggs += [F.count_if("meta_used").alias("meta_gate_used_count"),
                 F.count_if("meta_demoted").alias("meta_gate_to_benign_count"),
                 F.lit(0).cast("long").alias("meta_gate_to_phishing_count")]
    return d.agg(*aggs)


# --- linear models as tables ---------------------------------------------------------------------


def margins(features: DataFrame, weights: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, class, margin): sparse dot products of (key, feature, value) with (feature, class, weight)."""
    table = weights.select("feature", "class", "weight")
    return features.join(table, "feature").groupBy(key, "class").agg(
        F.sum(F.col("value") * F.col("weight")).alias("margin"))


def one_vs_rest(margin_rows: DataFrame, key: str = "row_id") -> DataFrame:
    """Add p: sigmoids per class, normalised to sum 1 within a row."""
    s = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("margin")))
    return margin_rows.withColumn("p", s / F.sum(s).over(W.partitionBy(key)))


def gradient_step(features: DataFrame, weights: DataFrame, labels: DataFrame, rate: float,
                  l2: float = K.L2_PENALTY, key: str = "row_id", classes: list[str] = K.CLASSES) -> DataFrame:
    """New (feature, class, weight) after one class-balanced step of one-vs-rest log loss over the given rows.

    `labels` is (key, label, sample_weight). One pass over the features: a row's margins and errors come
    from its own features, then gradients are summed per feature with partial aggregation, so a feature
    of every row costs one record per task. Features without a weight start at 0.
    """
    of = lambda c: F.coalesce(F.max(F.when(F.col("class") == c, F.col("weight"))), F.lit(0.0)).alias("w_" + c)
    wide = weights.groupBy("feature").agg(*[of(c) for c in classes])
    known = features.join(wide, "feature", "left")
    margin = lambda c: F.sum(F.col("value") * F.coalesce("w_" + c, F.lit(0.0))).alias("m_" + c)
    rows = known.groupBy(key).agg(F.collect_list(F.struct("feature", "value")).alias("f"), *[margin(c) for c in classes])
    rows = rows.join(labels.select(key, "label", "sample_weight"), key)
    error = lambda c: ((F.lit(1.0) / (1.0 + F.exp(-F.col("m_" + c))) - (F.col("label") == c).cast("double"))
                       * F.col("sample_weight")).alias("e_" + c)
    long = rows.select(*[error(c) for c in classes], F.explode("f").alias("f"))
    grad = long.groupBy(F.col("f.feature").alias("feature")).agg(
        *[F.sum(F.col("e_" + c) * F.col("f.value")).alias("g_" + c) for c in classes])
    n = labels.agg(F.count("*").alias("n")).scalar()
    both = grad.join(wide, "feature", "full").withColumn("n", n)
    zero = lambda name: F.coalesce(name, F.lit(0.0))
    new = F.array(*[F.struct(F.lit(c).alias("class"), (
        zero("w_" + c) * (1.0 - rate * l2) - rate * zero("g_" + c) / F.col("n")).alias("weight")) for c in classes])
    return both.select("feature", F.inline(new))


# --- fitted models -------------------------------------------------------------------------------


def base_pipeline(vocabulary: DataFrame, fitted: DataFrame, max_iter: int = 10) -> Pipeline:
    """Four-class linear model over TF-IDF, dictionary and lexical features, class-weighted.

    `vocabulary` is that of features.tfidf_vocabulary (TFIDF_MAX_FEATURES rows at most, which bounds what the driver
    holds), `fitted` the one row of features.scaler. Both are frozen into the pipeline, so its first stages give the
    values of features.tfidf and features.scaled, as one sparse vector per row and without a shuffle.
    """
    terms = vocabulary.orderBy(F.desc("tf"), "token").select("token", "idf").collect()
    fit = fitted.first()
    scaled = ", ".join(f"({c} - ({fit['mean_' + c]!r}D)) / {fit['sd_' + c] or 1.0!r}D AS scaled_{c}" for c in FE.DENSE)
    parts = [f"scaled_{c}" for c in FE.DENSE]
    stages = [SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__")]
    if terms:  # a table of few rows may have no term within the document-frequency band
        parts.insert(0, "tfidf")
        stages += [
            CountVectorizerModel.from_vocabulary([t.token for t in terms], inputCol="tokens", outputCol="tf"),
            ElementwiseProduct(scalingVec=Vectors.dense([t.idf for t in terms]), inputCol="tf", outputCol="tf_idf"),
            Normalizer(p=2.0, inputCol="tf_idf", outputCol="tfidf"),
        ]
    return Pipeline(stages=[
        *stages, VectorAssembler(inputCols=parts, outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol="label_id", weightCol="weight", family="multinomial",
                           regParam=K.L2_PENALTY, maxIter=max_iter),
    ])


def base_rows(df: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Rows with tokens and the dense features under a dictionary: what a fitted base model reads."""
    return df.join(FE.dense_features(df, dictionary), "row_id")


def base_training(df: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Rows ready for base_pipeline: tokens, dense features, label_id and balanced weight."""
    index = FE.label_index(df)
    weights = FE.class_weights(df).select("type", "weight")
    return FE.encode_labels(base_rows(df, dictionary), index).join(weights, "type")


def base_weights(spark, model) -> DataFrame:
    """(feature, class_id, weight) of a fitted base model, named as in features.feature_table, with a row "(intercept)"."""
    terms = [f"tfidf:{t}" for s in model.stages if isinstance(s, CountVectorizerModel) for t in s.vocabulary]
    names = [*terms, *[f"dense:{c}" for c in FE.DENSE]]
    regression = model.stages[-1]
    rows = [(n, k, float(w)) for k, line in enumerate(regression.coefficientMatrix.toArray()) for n, w in zip(names, line)]
    rows += [("(intercept)", k, float(w)) for k, w in enumerate(regression.interceptVector.toArray())]
    return spark.createDataFrame(rows, "feature string, class_id int, weight double")


def scored(model, df: DataFrame, classes: list[str] = K.CLASSES) -> DataFrame:
    """Add p_<class> of a fitted base model."""
    d = model.transform(df).withColumn("_p", vector_to_array("probability"))
    return d.select(*df.columns, *[F.col("_p")[i].alias("p_" + c) for i, c in enumerate(classes)])


def specialist_sample(df: DataFrame, max_samples: int = K.SPECIALIST_MAX_SAMPLES) -> DataFrame:
    """Balanced benign/phishing rows with binary_label: the same number of each, in seeded order.

    The sample size is a parameter of the operator; Spark cuts each partition before the shuffle.
    """
    from . import lexicon as L

    d = df.filter(F.col("type").isin(K.BENIGN, K.PHISHING)).withColumn(
        "binary_label", (F.col("type") == K.PHISHING).cast("int"))
    counts = d.agg(F.count_if(F.col("binary_label") == 1).alias("a"), F.count_if(F.col("binary_label") == 0).alias("b"))
    each = counts.select(F.least("a", "b", F.lit(max_samples // 2)).alias("n")).scalar()
    d = d.withColumn("sample_key", shuffle_key())
    top = L.top_k(d, ["binary_label"], [F.asc("sample_key"), F.asc("row_id")], max_samples // 2)
    return top.filter(F.col("rank") <= each)


def shuffle_key(key: str = "row_id", url: str = "url", seed: int = 42) -> Column:
    """Uniform seeded order key of a row; copies of a URL get different keys."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit("|"), F.col(url), F.lit(f"#{seed}")))


def specialist_pipeline(max_iter: int = 10, vocabulary: int = K.TFIDF_MAX_FEATURES) -> Pipeline:
    """Phishing probability from character n-gram counts; the `vocabulary` most frequent n-grams count."""
    return Pipeline(stages=[
        CountVectorizer(inputCol="grams", outputCol="features", vocabSize=vocabulary, minDF=K.TFIDF_MIN_DF),
        LogisticRegression(featuresCol="features", labelCol="binary_label", regParam=1e-3, maxIter=max_iter),
    ])


def with_grams(df: DataFrame, url: str = "url") -> DataFrame:
    """Add all character 3- and 4-grams of the cleaned URL (with at least four characters)."""
    u = clean_url(F.col(url))
    return df.withColumn("_u", u).withColumn("grams", F.when(F.length("_u") >= 4, char_ngrams(F.col("_u"))).otherwise(
        F.array().cast("array<string>"))).drop("_u")


def specialist_scores(model, df: DataFrame) -> DataFrame:
    """Add t_prob, the specialist's phishing probability."""
    d = model.transform(with_grams(df))
    return d.select(*df.columns, vector_to_array("probability")[1].alias("t_prob"))


def specialist_weights(spark, model) -> DataFrame:
    """(gram, weight) of a fitted specialist; the vocabulary limit bounds its rows."""
    vectorizer, regression = model.stages
    pairs = zip(vectorizer.vocabulary, regression.coefficients.toArray().tolist())
    return spark.createDataFrame(list(pairs), "gram string, weight double")
