"""URL tokens: the training-side tokeniser, the scoring-side feature set, and the feature catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import FEATURE_CATEGORIES
from .url import (
    IPV4_RE, char_ngrams, clean_url, empty_strings, host_of_netloc, if_array, labels_of, query_pairs, split_alnum,
    split_clean_parts, split_parts, strings, with_evidence_parts, with_url_parts,
)

TOKEN_FALLBACK = "empty_or_invalid_url"


def _prefixed(prefix: str, items: Column) -> Column:
    return F.transform(items, lambda x: F.concat(F.lit(prefix + ":"), x))


def with_tokens(df: DataFrame, url: str = "url", out: str = "tokens") -> DataFrame:
    """Add the token array of `url`; order and duplicates are kept, other columns stay."""
    keep = [c for c in df.columns if c != out]
    d = df.select(*keep, clean_url(F.col(url)).alias("_dec"))
    d = with_url_parts(d.withColumnsRenamed({c: "_k_" + c for c in keep}), "_dec")
    d = d.withColumn("_host", host_of_netloc(F.col("netloc")))
    d = d.withColumn("_labels", labels_of(F.col("_host"))).withColumn(
        "_segments", F.filter(F.split("path", "/"), lambda x: x != ""))
    d = d.withColumn("_last", F.coalesce(F.try_element_at("_segments", F.lit(-1)), F.lit("")))
    d = d.withColumn("_ext", F.substring_index("_last", ".", -1))
    d = d.withColumn("_pairs", query_pairs(F.col("query")))
    d = d.withColumn("_parts", split_alnum(F.col("clean"), 2))
    n = F.size("_labels")

    def host_tokens(x, i):
        kind = F.when(i == n - 1, "tldpart:").when(i == n - 2, "sld:").otherwise("subdomain:")
        return F.concat(F.array(F.concat(kind, x), F.concat(F.lit("domain:"), x)),
                        _prefixed("dpart", split_clean_parts(x)))

    def path_tokens(x):
        return F.concat(F.array(F.concat(F.lit("path:"), x)), _prefixed("pseg", split_clean_parts(x)))

    def pair_tokens(x):
        return F.concat(
            if_array(x["key"] != "", F.concat(F.array(F.concat(F.lit("qkey:"), x["key"])),
                                              _prefixed("qk", split_parts(x["key"])))),
            if_array(x["value"] != "", _prefixed("qv", split_parts(x["value"]))),
        )

    dec = F.col("_dec")
    flags = F.array_compact(F.array(
        F.when(F.contains(dec, F.lit("-")), "has_hyphen"),
        F.when(F.contains(dec, F.lit("_")), "has_underscore"),
        F.when(F.contains(dec, F.lit("%")), "has_percent_encoding"),
        F.when(F.length(dec) - F.length(F.replace(dec, F.lit("."), F.lit(""))) >= 4, "many_dots"),
        F.when(F.length(dec) >= 100, "very_long_url"),
    ))
    tokens = F.concat(
        if_array(F.contains("netloc", F.lit("@")), strings(["has_userinfo"])),
        if_array(F.col("_host").rlike(IPV4_RE), strings(["host_is_ip"])),
        if_array(n > 0, F.array(F.concat(F.lit("tld:"), F.try_element_at("_labels", F.lit(-1))))),
        F.flatten(F.transform("_labels", host_tokens)),
        F.flatten(F.transform("_segments", path_tokens)),
        if_array(F.contains("_last", F.lit(".")) & F.length("_ext").between(1, 8),
                 F.array(F.concat(F.lit("ext:"), "_ext"))),
        if_array(F.col("query") != "", strings(["has_query"])),
        F.flatten(F.transform("_pairs", pair_tokens)),
        _prefixed("tok", F.col("_parts")),
        F.flatten(F.transform(F.filter("_parts", lambda x: F.length(x) >= 6), char_ngrams)),
        flags,
    )
    d = d.withColumn("_tokens", tokens)
    final = F.when(F.size("_tokens") == 0, strings([TOKEN_FALLBACK])).otherwise(F.col("_tokens"))
    return d.select(*[F.col("_k_" + c).alias(c) for c in keep], final.alias(out))


def scoring_features(d: DataFrame, out: str = "features") -> DataFrame:
    """Add the feature set used at scoring time; `d` comes from with_evidence_parts."""
    labels, host = F.col("labels"), F.coalesce("host", F.lit(""))
    pairs = query_pairs(F.col("query"))
    n = F.size(labels)
    named = F.concat(
        F.array(F.concat(F.lit("tld:"), F.col("tld"))),
        if_array(n >= 2, F.array(F.concat(F.lit("sld:"), F.col("sld")))),
        if_array(n >= 3, F.array(F.concat(F.lit("subdomain:"), F.array_join("sub_labels", ".")))),
        F.array(F.concat(F.lit("domain:"), host)),
        F.flatten(F.transform(labels, lambda x: F.array(
            F.concat(F.lit("dpart:"), x), F.concat(F.lit("domain:"), x), F.concat(F.lit("tok:"), x)))),
    )
    address = F.array(F.lit("host_is_ip"), F.concat(F.lit("domain:"), host))
    host_part = F.when(F.col("is_ipv4"), address).when(n > 0, named).otherwise(empty_strings())
    path_part = F.flatten(F.transform("path_parts", lambda x: F.array(
        F.concat(F.lit("path:"), x), F.concat(F.lit("pseg:"), x), F.concat(F.lit("tok:"), x))))
    query_part = F.flatten(F.transform(pairs, lambda p: F.concat(
        F.flatten(F.transform(split_alnum(p["key"]), lambda x: F.array(
            F.concat(F.lit("qkey:"), x), F.concat(F.lit("qk:"), x), F.concat(F.lit("tok:"), x)))),
        F.flatten(F.transform(split_alnum(p["value"]), lambda x: F.array(
            F.concat(F.lit("qv:"), x), F.concat(F.lit("tok:"), x)))),
    )))
    features = F.concat(
        host_part, path_part,
        if_array(F.col("extension").isNotNull(), F.array(F.concat(F.lit("ext:"), "extension"))),
        query_part,
        if_array(F.col("scheme") == "http", strings(["scheme:http"])),
    )
    return d.withColumn(out, F.array_distinct(features))


def url_features(df: DataFrame, url: str = "url") -> DataFrame:
    return scoring_features(with_evidence_parts(df, url))


def feature_prefix(c: Column) -> Column:
    return F.substring_index(c, ":", 1)


def feature_value(c: Column) -> Column:
    """Text after the first colon; a bare flag is its own value."""
    return F.when(F.contains(c, F.lit(":")), F.substring(c, F.length(feature_prefix(c)) + 2, F.length(c))).otherwise(c)


def feature_category(c: Column) -> Column:
    prefix = feature_prefix(c)
    by_category: dict[str, list[str]] = {}
    for key, category in FEATURE_CATEGORIES.items():
        by_category.setdefault(category, []).append(key)
    chain = F.when(~F.contains(c, F.lit(":")), "url_rule")
    for category, keys in by_category.items():
        chain = chain.when(prefix.isin(keys), category)
    return chain.otherwise("lexical")
