"""Feature builders: lexical, dictionary, policy, TF-IDF, scaling, characters, class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.url import clean_url, exploded

# Every character set a URL can hold is far below this many code points.
UNICODE_CODE_POINTS = 1_114_112


def char_vocabulary(urls: DataFrame, url: str = "url") -> DataFrame:
    """(ch, n, id): characters of the cleaned URLs, most frequent first; ids start after PAD, UNK, CLS.

    Counts are pre-aggregated before the shuffle. The ranking window has no partition key, but its input
    is one row per distinct character, a number Unicode bounds.
    """
    chars = exploded(urls, F.split(clean_url(F.col(url)), ""), "ch").filter("ch <> ''")
    counts = chars.groupBy("ch").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.orderBy(F.desc("n"), "ch"))
    return counts.select("ch", "n", (rank + K.CHAR_CLS).cast("long").alias("id"))


def char_table(vocab: DataFrame) -> DataFrame:
    """One row `pages`: ids by code point. Page p holds those of code points 256 p to 256 p + 255 and is null where none is
    known, so that an id is two array accesses away."""
    code = F.ascii("ch")
    cells = vocab.select(F.shiftright(code, 8).alias("page"), code.bitwiseAND(255).alias("cell"), "id")
    entries = lambda value: F.map_from_entries(F.collect_list(F.struct(*value)))
    filled = lambda last: F.transform(F.sequence(F.lit(0), last), lambda i: F.try_element_at("m", i))
    pages = cells.groupBy("page").agg(entries(["cell", "id"]).alias("m")).select("page", filled(F.lit(255)).alias("ids"))
    whole = pages.agg(entries(["page", "ids"]).alias("m"), F.coalesce(F.max("page"), F.lit(0)).alias("last"))
    return whole.select(filled(F.col("last")).alias("pages"))


def char_ids(urls: DataFrame, vocab: DataFrame, url: str = "url", length: int = K.CHAR_LENGTH) -> DataFrame:
    """Fixed-length id array per URL: CLS, ids (UNK for unknown), then PAD; longer URLs are cut to `length`."""
    rows = urls.withColumns({"_clean": clean_url(F.col(url)), "_pages": char_table(vocab).scalar()})
    codes = F.transform(F.split("_clean", "", length), lambda ch: F.ascii(ch))
    ids = F.transform(codes, lambda c: F.coalesce(F.get(F.get("_pages", F.shiftright(c, 8)), c.bitwiseAND(255)),
                                                  F.lit(K.CHAR_UNK)))
    ids = F.when(F.col("_clean") == "", F.array().cast("array<bigint>")).otherwise(ids)
    padded = F.concat(F.array(F.lit(K.CHAR_CLS).cast("long")), ids,
                      F.array_repeat(F.lit(K.CHAR_PAD).cast("long"), length))
    return rows.withColumn("ids", F.slice(padded, 1, length)).drop("_clean", "_pages")


LEXICAL = [
    "length", "digit_count", "alpha_count", "special_count", "dot_count", "slash_count", "hyphen_count",
    "underscore_count", "question_count", "equal_count", "amp_count", "percent_count", "at_count", "digit_ratio",
    "alpha_ratio", "special_ratio", "has_ip", "has_https", "has_http",
]


def _matching(c: Column, other: str) -> Column:
    """Number of characters that are not in the class `other`."""
    return F.length(F.regexp_replace(c, f"[{other}]", ""))


def _count(c: Column, char: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def _flag(cond: Column) -> Column:
    return cond.cast("int")


def lexical_features(df: DataFrame, url: str = "url") -> DataFrame:
    """Add the 19 lexical features of the cleaned URL."""
    d = df.withColumn("_u", clean_url(F.col(url)))
    u = F.col("_u")
    d = (d.withColumn("length", F.length(u))
          .withColumn("digit_count", _matching(u, r"^\p{Nd}"))
          .withColumn("alpha_count", _matching(u, r"^\p{L}"))
          .withColumn("special_count", _matching(u, r"\p{L}\p{N}")))
    for name, char in [("dot", "."), ("slash", "/"), ("hyphen", "-"), ("underscore", "_"), ("question", "?"),
                       ("equal", "="), ("amp", "&"), ("percent", "%"), ("at", "@")]:
        d = d.withColumn(name + "_count", _count(u, char))
    size = F.greatest("length", F.lit(1))
    for name in ["digit", "alpha", "special"]:
        d = d.withColumn(name + "_ratio", F.col(name + "_count") / size)
    return (d.withColumn("has_ip", _flag(u.rlike(r"\d{1,3}(\.\d{1,3}){3}")))
             .withColumn("has_https", _flag(F.startswith(u, F.lit("https://"))))
             .withColumn("has_http", _flag(F.startswith(u, F.lit("http://")))).drop("_u"))


def risk_columns(classes=K.MALICIOUS) -> list[str]:
    return [f"{s}_{x}" for s in ["common", *classes] for x in ("score", "count")]


def risk_features(df: DataFrame, dictionary: DataFrame, key: str = "row_id",
                  tokens: str = "tokens", by: list[str] | None = None, classes=K.MALICIOUS) -> DataFrame:
    """(key, <scope>_score, <scope>_count): dictionary hits of each row's token set; 0 where nothing matches.

    Tokens of one row lie next to each other, so the partial aggregation already leaves one row per key
    before the shuffle. `by` names extra join columns, such as a dictionary version.
    """
    by = list(by or [])
    long = df.select(key, *by, F.explode_outer(F.array_distinct(tokens)).alias("token"))
    table = dictionary.select(*by, "token", "scope", "score")
    found = long.join(table, [*by, "token"], "left")
    scope = F.col("scope")
    aggs = []
    for s in ["common", *classes]:
        aggs.append(F.coalesce(F.sum(F.when(scope == s, F.col("score"))), F.lit(0.0)).alias(f"{s}_score"))
        aggs.append(F.count_if(scope == s).alias(f"{s}_count"))
    return found.groupBy(key).agg(*aggs)


POLICY = [
    "url_length", "host_length", "path_length", "query_length", "dot_count", "hyphen_count", "underscore_count",
    "at_count", "percent_count", "equal_count", "amp_count", "domain_part_count", "has_query", "has_path",
    "root_or_empty_path", "short_url_le35", "short_url_le50", "known_safe_domain_flag", "known_safe_risky_signal",
    "education_tld_flag", "government_tld_flag", "korea_company_tld_flag",
]
# Two flags that are always 0: their lists are empty.
POLICY_SUFFIXES = {"education_tld_flag": [".ac.kr", ".edu"], "government_tld_flag": [".go.kr", ".gov"],
                   "korea_company_tld_flag": [".co.kr"]}


def policy_features(df: DataFrame, url: str = "url") -> DataFrame:
    """Add the 22 URL policy features (doubles)."""
    from ..functions.url import normalized_host, with_url_parts

    names = {c: "_k_" + c for c in df.columns}
    d = df.withColumn("_u", clean_url(F.col(url))).withColumnsRenamed(names)
    d = with_url_parts(d, "_u").withColumn("_host", normalized_host(F.col("netloc")))
    u, host, path, query = F.col("_u"), F.col("_host"), F.col("path"), F.col("query")
    root = (path == "") | (path == "/")
    parts = F.size(F.filter(F.split(host, "[.]"), lambda x: x != ""))
    values = {
        "url_length": F.length(u), "host_length": F.length(host), "path_length": F.length(path),
        "query_length": F.length(query), "dot_count": _count(u, "."), "hyphen_count": _count(u, "-"),
        "underscore_count": _count(u, "_"), "at_count": _count(u, "@"), "percent_count": _count(u, "%"),
        "equal_count": _count(u, "="), "amp_count": _count(u, "&"), "domain_part_count": parts,
        "has_query": query != "", "has_path": ~root, "root_or_empty_path": root & (query == ""),
        "short_url_le35": F.length(u) <= 35, "short_url_le50": F.length(u) <= 50,
        "known_safe_domain_flag": F.lit(0), "known_safe_risky_signal": F.lit(0),
    }
    for name, suffixes in POLICY_SUFFIXES.items():
        test = F.lit(False)
        for s in suffixes:
            test = test | F.endswith(host, F.lit(s))
        values[name] = test
    return d.select(*[F.col(v).alias(c) for c, v in names.items()],
                    *[v.cast("double").alias(n) for n, v in values.items()])


META_PROBABILITY = [
    "base_benign_prob", "base_phishing_prob", "base_phishing_minus_benign", "base_benign_phishing_margin",
    "base_top_prob", "base_top_margin", "base_pred_is_benign", "base_pred_is_phishing", "transformer_phishing_prob",
    "transformer_minus_base_phishing", "transformer_base_abs_gap",
]
META_FEATURES = META_PROBABILITY + POLICY


def meta_gate_features(df: DataFrame, raw_pred: str = "raw_pred", t_prob: str = "t_prob",
                       url: str = "url") -> DataFrame:
    """Add the 33 meta-gate features to rows with p_<class>, the raw prediction and the specialist probability."""
    d = policy_features(df, url)
    b, p, t = F.col("p_benign"), F.col("p_phishing"), F.col(t_prob)
    ordered = F.sort_array(F.array(*["p_" + c for c in K.CLASSES]), False)
    values = [b, p, p - b, F.abs(p - b), ordered[0], ordered[0] - ordered[1],
              (F.col(raw_pred) == K.BENIGN).cast("double"), (F.col(raw_pred) == K.PHISHING).cast("double"),
              t, t - p, F.abs(t - p)]
    return d.select("*", *[v.alias(n) for n, v in zip(META_PROBABILITY, values)])


def term_frequencies(df: DataFrame, key: str = "row_id", tokens: str = "tokens") -> DataFrame:
    """(key, token, tf)."""
    return exploded(df, F.col(tokens), "token", key).groupBy(key, "token").agg(F.count("*").alias("tf"))


def tfidf_vocabulary(df: DataFrame, key: str = "row_id", tokens: str = "tokens",
                     max_features: int = K.TFIDF_MAX_FEATURES, min_df: int = K.TFIDF_MIN_DF,
                     max_df: float = K.TFIDF_MAX_DF) -> DataFrame:
    """(token, df, tf, idf): terms within the document-frequency band, the most frequent first.

    Smoothed inverse document frequency ln((1 + n) / (1 + df)) + 1. Every token adds to tf and every
    distinct token of a document to df, in one aggregation.
    """
    from . import lexicon as L

    entry = lambda df_part: lambda t: F.struct(t.alias("token"), F.lit(df_part).alias("df"))
    both = F.concat(F.transform(tokens, entry(0)), F.transform(F.array_distinct(tokens), entry(1)))
    counts = exploded(df, both, "t").groupBy("t.token").agg(
        F.sum("t.df").alias("df"), F.count_if(F.col("t.df") == 0).alias("tf"))
    n = df.agg(F.count("*").alias("n")).scalar()
    counts = counts.withColumn("n", n)
    band = counts.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))
    top = L.top_k(band.withColumn("g", F.lit(0)), ["g"], [F.desc("tf"), F.asc("token")], max_features)
    return top.select("token", "df", "tf", (F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))


def tfidf(df: DataFrame, vocab: DataFrame, key: str = "row_id",
          tokens: str = "tokens") -> DataFrame:
    """(key, token, value): L2-normalised tf * idf over a frozen vocabulary; unseen tokens drop out.

    The vocabulary filter runs before the only shuffle, which is by `key` and serves both the counts and the norm.
    """
    long = exploded(df, F.col(tokens), "token", key)
    known = long.join(vocab.select("token", "idf"), "token").repartition(key)
    counts = known.groupBy(key, "token").agg((F.count("*") * F.first("idf")).alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(W.partitionBy(key)))
    return counts.select(key, "token", (F.col("v") / norm).alias("value"))


DENSE = risk_columns() + LEXICAL


def dense_features(df: DataFrame, dictionary: DataFrame, key: str = "row_id",
                   url: str = "url", tokens: str = "tokens") -> DataFrame:
    """(key, 8 dictionary features, 19 lexical features) as doubles."""
    lexical = lexical_features(df.select(key, url), url)
    risk = risk_features(df, dictionary, key, tokens)
    both = lexical.join(risk, key)
    return both.select(key, *[F.col(c).cast("double").alias(c) for c in DENSE])


def scaler(dense: DataFrame, columns: list[str] = DENSE) -> DataFrame:
    """One row: mean and population deviation per column; a zero deviation counts as 1."""
    return dense.agg(*[F.avg(c).alias("mean_" + c) for c in columns],
                     *[F.stddev_pop(c).alias("sd_" + c) for c in columns])


def scaled(dense: DataFrame, fitted: DataFrame, key: str = "row_id", columns: list[str] = DENSE) -> DataFrame:
    """(key, feature, value) in long form, standardised with fitted means and deviations."""
    fit = fitted.select(F.struct(*fitted.columns).alias("s")).scalar()
    d = dense.withColumn("_fit", fit)
    sd = lambda c: F.coalesce(F.nullif(F.col(f"_fit.sd_{c}"), F.lit(0.0)), F.lit(1.0))
    items = F.array(*[F.struct(F.lit(c).alias("feature"), ((F.col(c) - F.col(f"_fit.mean_{c}")) / sd(c)).alias("value"))
                      for c in columns])
    return d.select(key, F.inline(items))


def feature_table(sparse: DataFrame, dense: DataFrame, key: str = "row_id") -> DataFrame:
    """One long table of sparse (key, token, value) and dense (key, feature, value) features."""
    return sparse.select(key, F.concat(F.lit("tfidf:"), "token").alias("feature"), "value").unionByName(
        dense.select(key, F.concat(F.lit("dense:"), "feature").alias("feature"), "value"))


def label_index(df: DataFrame, label: str = "type") -> DataFrame:
    """(label, label_id): ids in alphabetical order from 0. One row per class."""
    return df.select(F.col(label).alias("label")).distinct().withColumn(
        "label_id", F.row_number().over(W.orderBy("label")) - 1)


def encode_labels(df: DataFrame, index: DataFrame, label: str = "type") -> DataFrame:
    """Add label_id; a label outside the index stops the job."""
    d = df.join(index.withColumnRenamed("label", label), label, "left")
    return d.withColumn("label_id", F.when(F.col("label_id").isNull(), F.raise_error(F.concat(
        F.lit("unseen label: "), F.coalesce(label, F.lit("null"))))).otherwise(F.col("label_id")))


def class_weights(df: DataFrame, label: str = "type", by: list[str] | None = None) -> DataFrame:
    """(by, label, n, weight): n / (classes present * n of the class), from pre-aggregated counts."""
    by = list(by or [])
    counts = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    return counts.withColumn("weight", F.sum("n").over(w) / (F.count("*").over(w) * F.col("n")))
