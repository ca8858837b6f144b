"""Risk-token mining: document frequencies, smoothed log-odds, top-k dictionaries, derived term lexicons.

A dictionary is a long table (scope, token, score, rank); scope is "common" or a class name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.terms import valid_learned_term, valid_text_term
from ..functions.url import exploded
from ..functions.tokens import feature_prefix, feature_value

COMMON = "common"
# Scores are ranked on this many places, so that equal ratios tie whatever their counts.
RANK_PLACES = 9
SALTS = 64


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """Rows ranked at most k within a group, with column `rank`.

    Up to the session's limit Spark itself cuts every partition to k rows before the shuffle. Beyond it
    the cut is made here on salted groups first, so no group meets in one task uncut.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if k > limit:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
        w = W.partitionBy(*group, "_salt").orderBy(*order)
        df = salted.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_salt", "_r")
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= k)


def token_df(df: DataFrame, classes: list[str], tokens: str = "tokens", label: str = "type",
             by: list[str] | None = None) -> DataFrame:
    """Documents holding each token: total_df and one df_<class> column per class.

    Every document adds each token once; counts are combined before the shuffle, so a token of all
    documents costs one row per task.
    """
    keys = list(by or []) + ["token"]
    long = exploded(df, F.array_distinct(tokens), "token", *keys[:-1], F.col(label).alias("_label"))
    return long.groupBy(*keys).agg(
        F.count("*").alias("total_df"),
        *[F.count_if(F.col("_label") == c).alias("df_" + c) for c in classes])


def class_totals(df: DataFrame, classes: list[str], label: str = "type") -> DataFrame:
    """One row: number of documents, and per class."""
    return df.agg(F.count("*").alias("n"), *[F.count_if(F.col(label) == c).alias("n_" + c) for c in classes])


def _log_odds(inside: Column, n_inside: Column, outside: Column, n_outside: Column, alpha: float) -> Column:
    p_in = (inside + F.lit(alpha)) / (n_inside + F.lit(2 * alpha))
    p_out = (outside + F.lit(alpha)) / (n_outside + F.lit(2 * alpha))
    return F.log(p_in / p_out)


def log_odds(counts: DataFrame, totals: Column, classes: list[str], negative: str, min_df: int,
             min_classes: int = K.MIN_MALICIOUS_CLASSES, alpha: float = K.SMOOTHING) -> DataFrame:
    """Positive scores in long form: (scope, token, score), common and per class.

    `totals` is a struct column with the document counts n and n_<class>; it is read once.
    """
    counts, totals = counts.withColumn("_totals", totals), F.col("_totals")
    positives = [c for c in classes if c != negative]
    keys = [c for c in counts.columns if c not in ("total_df", "_totals") and not c.startswith("df_")]
    n = totals["n"]
    df_neg, n_neg = F.col("df_" + negative), totals["n_" + negative]
    df_pos = sum((F.col("df_" + c) for c in positives), F.lit(0))
    presence = sum(((F.col("df_" + c) > 0).cast("int") for c in positives), F.lit(0))
    scores = [F.struct(F.lit(COMMON).alias("scope"), F.when(
        presence >= min_classes, _log_odds(df_pos, n - n_neg, df_neg, n_neg, alpha)).alias("score"))]
    for c in positives:
        n_c, df_c = totals["n_" + c], F.col("df_" + c)
        scores.append(F.struct(F.lit(c).alias("scope"),
                               _log_odds(df_c, n_c, F.col("total_df") - df_c, n - n_c, alpha).alias("score")))
    frequent = counts.filter(F.col("total_df") >= min_df)
    return frequent.select(*keys, F.inline(F.array(*scores))).filter("score > 0")


def _order() -> list[Column]:
    return [F.desc(F.round("score", RANK_PLACES)), F.asc("token")]


def cut(scored: DataFrame, top_common: int, top_class: int, by: list[str] | None = None) -> DataFrame:
    """Top tokens per scope by score, then name."""
    ranked = top_k(scored, list(by or []) + ["scope"], _order(), max(top_common, top_class))
    return ranked.filter(F.col("rank") <= F.when(F.col("scope") == COMMON, top_common).otherwise(top_class))


def build_risk_lexicon(df: DataFrame, classes: list[str], negative: str, top_common: int, top_class: int, min_df: int,
                       tokens: str = "tokens", label: str = "type",
                       min_classes: int = K.MIN_MALICIOUS_CLASSES) -> DataFrame:
    """Dictionary of any labelled token column: (scope, token, score, rank)."""
    totals = class_totals(df, classes, label)
    counts = token_df(df, classes, tokens, label)
    scored = log_odds(counts, totals.select(F.struct(*totals.columns)).scalar(), classes, negative, min_df, min_classes)
    return cut(scored, top_common, top_class).select("scope", "token", "score", "rank")


def risk_dictionary(df: DataFrame, profile=K.ADAPTIVE_PROFILE) -> DataFrame:
    top_common, top_class, min_df = profile
    return build_risk_lexicon(df, K.CLASSES, K.BENIGN, top_common, top_class, min_df)


def seed_tokens(spark) -> DataFrame:
    """(scope, token, score) of the seed terms under each of their prefixes."""
    rows = [(label, "term", t) for label, terms in K.SEED_TERMS.items() for t in terms]
    rows += [(label, "ext", t) for label, terms in K.SEED_EXTENSIONS.items() for t in terms]
    seeds = spark.createDataFrame(rows, "scope string, kind string, term string")
    prefixes = F.when(F.col("kind") == "term", F.array(*map(F.lit, K.SEED_TERM_PREFIXES))).otherwise(
        F.array(*map(F.lit, K.SEED_EXTENSION_PREFIXES)))
    return seeds.select("scope", F.explode(prefixes).alias("prefix"), "term").select(
        "scope", F.concat_ws(":", "prefix", "term").alias("token"), F.lit(K.SEED_SCORE).alias("score")).distinct()


def with_seeds(dictionary: DataFrame) -> DataFrame:
    """Seed tokens join after the cut, at the seed score or the learned one if higher."""
    both = dictionary.select("scope", "token", "score").unionByName(seed_tokens(dictionary.sparkSession))
    best = both.groupBy("scope", "token").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("scope").orderBy(*_order())))


def rebuilt_dictionary(df: DataFrame) -> DataFrame:
    return with_seeds(risk_dictionary(df, K.REBUILD_PROFILE))


def max_rows(profile, seeds: bool = False) -> int:
    """Row bound of a dictionary of this profile."""
    return profile[0] + profile[1] * len(K.MALICIOUS) + (300 if seeds else 0)


def preview(dictionary: DataFrame, top: int = 10) -> DataFrame:
    return dictionary.filter(F.col("rank") <= top).select("scope", "rank", "token", F.round("score", 4).alias("score"))


def lexicon_rows(spark, lexicon: dict[str, list[str]]) -> DataFrame:
    return spark.createDataFrame([(c, t) for c, terms in lexicon.items() for t in terms], "category string, term string")


CLASS_CATEGORY = {
    COMMON: "risk_terms", "phishing": "phishing_intent_terms", "defacement": "defacement_terms",
    "malware": "malware_terms",
}


def lexicon_from_dictionary(dictionary: DataFrame, metadata: bool) -> DataFrame:
    """Evidence lexicon (category, term) a dictionary implies; `metadata` adds seeds and brand names.

    Scores that are no numbers are skipped; thresholds differ for the common scope and the classes.
    """
    spark = dictionary.sparkSession
    score = F.expr("try_cast(score AS double)")
    threshold = F.when(F.col("scope") == COMMON, K.LEARNED_COMMON_THRESHOLD).otherwise(K.LEARNED_CLASS_THRESHOLD)
    prefix, value = feature_prefix(F.col("token")), feature_value(F.col("token"))
    target = F.lit(None).cast("string")
    for scope, category in CLASS_CATEGORY.items():
        target = F.when(F.col("scope") == scope, category).otherwise(target)
    is_term = prefix.isin(K.LEARNED_TERM_PREFIXES) & valid_learned_term(value)
    categories = (F.when(prefix == "ext", F.array(F.lit("risk_extensions")))
                  .when(prefix == "tld", F.array(F.lit("risk_tlds")))
                  .when(is_term, F.array_distinct(F.array(target, F.lit("risk_terms")))))
    learned = exploded(dictionary.filter(score >= threshold), categories, "category", value.alias("term"))
    fixed = {"compressed_extensions": K.COMPRESSED_EXTENSIONS}
    if metadata:
        fixed["impersonation_targets"] = K.IMPERSONATION_TARGETS
        fixed["phishing_intent_terms"] = K.SEED_TERMS["phishing"]
        fixed["risk_extensions"] = K.SEED_EXTENSIONS["malware"]
    return learned.unionByName(lexicon_rows(spark, fixed)).filter("category IS NOT NULL").distinct()


def page_terms_from_dictionary(dictionary: DataFrame) -> DataFrame:
    """Page-text lexicon (class, term) of a dictionary, with the fixed suspicious words."""
    prefix, value = feature_prefix(F.col("token")), feature_value(F.col("token"))
    learned = dictionary.filter(
        (F.expr("try_cast(score AS double)") >= K.LEARNED_CLASS_THRESHOLD) & (F.col("scope") != COMMON)
        & prefix.isin(K.LEARNED_TERM_PREFIXES) & valid_text_term(value)
    ).select(F.col("scope").alias("class"), value.alias("term"))
    words = lexicon_rows(dictionary.sparkSession, {K.PHISHING: K.SUSPICIOUS_TEXT_KEYWORDS})
    return learned.unionByName(words.withColumnRenamed("category", "class")).distinct()


# Page-text lexicon where no dictionary has been learned.
STATIC_PAGE_TERMS = {
    "phishing": sorted(set(K.PHISHING_INTENT_TERMS) | set(K.SUSPICIOUS_TEXT_KEYWORDS)),
    "defacement": sorted(set(K.DEFACEMENT_TERMS) | set(K.DEFACEMENT_PHRASES)),
    "malware": sorted(K.MALWARE_TERMS),
}


def dictionary_diff(old: DataFrame, new: DataFrame, samples: int = 10) -> DataFrame:
    """Per scope: tokens added, removed and kept, with the first few names of each change."""
    tagged = lambda d, is_new: d.select("scope", "token", F.lit(is_new).alias("is_new"))
    return _changes(tagged(old, False).unionByName(tagged(new, True)), samples)


def version_diffs(versions: DataFrame, samples: int = 10) -> DataFrame:
    """dictionary_diff of every version with the one before it, in one pass: version, scope and the changes."""
    last = versions.agg(F.max("version").alias("last"))
    sides = F.array(F.struct(F.col("version"), F.lit(True).alias("is_new")),
                    F.struct((F.col("version") + 1).alias("version"), F.lit(False).alias("is_new")))
    both = versions.withColumn("last", last.scalar())
    both = both.select("scope", "token", "last", F.explode(sides).alias("s")).select("scope", "token", "s.*", "last")
    return _changes(both.filter(F.col("version").between(1, F.col("last"))).drop("last"), samples, ["version"])


def _changes(rows: DataFrame, samples: int, by: list[str] | None = None) -> DataFrame:
    by = [*(by or []), "scope"]
    both = rows.groupBy(*by, "token").agg(F.bool_or("is_new").alias("n"), F.bool_or(~F.col("is_new")).alias("o"))
    both = both.select(*by, "token", F.when(F.col("n") & F.col("o"), "kept").when(F.col("n"), "added")
                       .otherwise("removed").alias("change"))
    both = both.withColumn("r", F.row_number().over(W.partitionBy(*by, "change").orderBy("token")))

    def sample(change):
        kept = F.collect_list(F.when((F.col("change") == change) & (F.col("r") <= samples), F.col("token")))
        return F.array_join(F.sort_array(kept), ",").alias("sample_" + change)

    count = lambda change: F.count_if(F.col("change") == change).alias(change)
    return both.groupBy(*by).agg(count("added"), count("removed"), count("kept"), sample("added"),
                                     sample("removed"))
