"""URL evidence rules: one row-local projection over parsed URL parts and term hits.

Two sources of term hits share the rules:
* the fixed lexicon: its lists are literals, so no join and no shuffle happen;
* a learned dictionary: one broadcast lookup on (kind, key) and one aggregation by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .. import texts as TX
from ..functions.tokens import feature_prefix, feature_value, scoring_features
from ..functions.url import empty_strings, exploded, filled, query_pairs, split_alnum, strings, with_evidence_parts
from . import lexicon as L

TERM_CATEGORIES = ["risk_terms", "phishing_intent_terms", "defacement_terms", "malware_terms"]
HITS = ["risk_hits", "phishing_hits", "defacement_hits", "malware_hits", "brand_hits", "query_terms"]


def clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def parsed(df: DataFrame, url: str = "url") -> DataFrame:
    """Evidence parts plus query pairs and look-alike columns."""
    d = with_evidence_parts(df, url).withColumn("pairs", query_pairs(F.col("query")))
    d = d.withColumn("brand_zone", F.array_distinct(F.concat("sub_parts", "path_parts", "query_parts")))
    d = d.withColumn("sld_plain", F.translate("sld", K.LOOKALIKE_FROM, K.LOOKALIKE_TO))
    letters = F.length(F.regexp_replace("sld", r"[^\p{L}]", ""))
    digits = F.length(F.regexp_replace("sld", r"[^\p{Nd}]", ""))
    d = d.withColumn("sld_digits", digits).withColumn("mixes_digits", (letters >= 3) & (digits > 0))
    return d.withColumn("looks_alike", F.col("mixes_digits") & (F.col("sld_plain") != F.col("sld"))
                        & F.col("sld_plain").rlike(r"^\p{L}+$"))


def value_parts(pair: Column) -> Column:
    return F.array_distinct(split_alnum(F.lower(pair["value"])))


def static_hits(d: DataFrame) -> DataFrame:
    """Term hits against the fixed lexicon."""
    context = F.col("context_parts")
    every_term = sorted(set(K.RISK_TERMS + K.PHISHING_INTENT_TERMS + K.DEFACEMENT_TERMS + K.MALWARE_TERMS))
    hit = lambda parts, terms: F.sort_array(F.array_intersect(parts, strings(terms)))
    all_values = F.flatten(F.transform("pairs", value_parts))
    return (d.withColumn("risk_hits", hit(context, K.RISK_TERMS))
            .withColumn("phishing_hits", hit(context, K.PHISHING_INTENT_TERMS))
            .withColumn("defacement_hits", hit(context, K.DEFACEMENT_TERMS))
            .withColumn("malware_hits", hit(context, K.MALWARE_TERMS))
            .withColumn("brand_hits", hit(F.col("brand_zone"), K.IMPERSONATION_TARGETS))
            .withColumn("query_terms", hit(all_values, every_term))
            .withColumn("ext_risky", F.coalesce(F.col("extension").isin(K.RISK_EXTENSIONS), F.lit(False)))
            .withColumn("ext_compressed", F.coalesce(F.col("extension").isin(K.COMPRESSED_EXTENSIONS), F.lit(False)))
            .withColumn("tld_risky", F.col("tld").isin(K.RISK_TLDS))
            .withColumn("sld_brand", F.col("sld_plain").isin(K.IMPERSONATION_TARGETS)))


def context_weight(feature: Column, sld: Column, tld: Column) -> Column:
    """(weight, context) of a dictionary match by its place in the URL."""
    prefix, value = feature_prefix(feature), feature_value(feature)
    entry = lambda w, name: F.struct(F.lit(w).alias("weight"), F.lit(TX.CONTEXTS[name]).alias("context"))
    in_path = prefix.isin("path", "pseg", "qkey", "qk", "qv")
    in_host = prefix.isin("sld", "domain", "dpart")
    return (F.when(in_path & value.isin(K.NEUTRAL_URL_TERMS), entry(0.12, "neutral"))
            .when(in_path, entry(1.0, "path"))
            .when(prefix == "subdomain", entry(0.85, "subdomain"))
            .when(prefix.isin("ext", "scheme", "host_is_ip"), entry(1.0, "structural"))
            .when(prefix == "tld", entry(0.65, "tld"))
            .when(in_host & ((value == sld) | (value == tld)),
                  entry(0.18, "registered"))
            .when(in_host, entry(0.35, "host"))
            .when(prefix == "tok", entry(0.30, "free"))
            .otherwise(entry(0.50, "generic")))


def _lookup(dictionary: DataFrame, metadata: bool) -> DataFrame:
    """(kind, key, scope, score): what the dictionary and its lexicon know about a URL part."""
    lex = L.lexicon_from_dictionary(dictionary, metadata)
    kinds = (F.when(F.col("category").isin(TERM_CATEGORIES), strings(["part", "value"]))
             .when(F.col("category").isin("risk_extensions", "compressed_extensions"), strings(["ext"]))
             .when(F.col("category") == "risk_tlds", strings(["tld"]))
             .when(F.col("category") == "impersonation_targets", strings(["brand", "sld"])))
    terms = lex.select(F.explode(kinds).alias("kind"), F.col("term").alias("key"), F.col("category").alias("scope"),
                       F.lit(None).cast("double").alias("score"))
    return dictionary.select(F.lit("feature").alias("kind"), F.col("token").alias("key"), "scope", "score"
                             ).unionByName(terms)


def learned_hits(d: DataFrame, dictionary: DataFrame, metadata: bool,
                 key: str = "row_id") -> DataFrame:
    """Term hits and dictionary matches of a learned dictionary; one row per `key`.

    Only the looked-up parts are exploded; the row itself crosses the network once, for the join back.
    """
    d = scoring_features(d)
    tag = lambda kind, items: F.transform(items, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("key")))
    one = lambda c: F.array(F.coalesce(c, F.lit("")))
    items = F.concat(
        tag("feature", F.col("features")), tag("part", F.col("context_parts")), tag("brand", F.col("brand_zone")),
        tag("value", F.array_distinct(F.flatten(F.transform("pairs", value_parts)))),
        tag("ext", one(F.col("extension"))), tag("tld", one(F.col("tld"))), tag("sld", one(F.col("sld_plain"))))
    long = exploded(d, items, "item", key, "sld", "tld").select(key, "sld", "tld", "item.kind", "item.key")
    # A dictionary of n rows implies at most 3n terms; each has up to two kinds.
    lookup = _lookup(dictionary, metadata)
    found = long.join(lookup, ["kind", "key"])
    is_feature = F.col("kind") == "feature"
    # Terms get no weight; the key column is a feature only where kind says so.
    weight = context_weight(F.col("key"), F.col("sld"), F.col("tld"))
    found = found.withColumn("w", F.when(is_feature, weight))
    found = found.withColumn("value", F.col("score") * F.col("w.weight"))
    terms = lambda kind, scopes: F.sort_array(F.collect_set(F.when(
        (F.col("kind") == kind) & F.col("scope").isin(scopes), F.col("key"))))
    has = lambda kind, scope: F.coalesce(F.bool_or((F.col("kind") == kind) & (F.col("scope") == scope)), F.lit(False))
    best = lambda scope: F.coalesce(F.max(F.when(is_feature & (F.col("scope") == scope), F.col("value"))), F.lit(0.0))
    match = F.struct(F.round("value", 9).alias("value"), F.col("scope").alias("label"), F.col("key").alias("feature"),
                     F.col("w.context").alias("context"))
    per_row = found.groupBy(key).agg(
        terms("part", ["risk_terms"]).alias("risk_hits"), terms("part", ["phishing_intent_terms"]).alias("phishing_hits"),
        terms("part", ["defacement_terms"]).alias("defacement_hits"),
        terms("part", ["malware_terms"]).alias("malware_hits"),
        terms("brand", ["impersonation_targets"]).alias("brand_hits"), terms("value", TERM_CATEGORIES).alias("query_terms"),
        has("ext", "risk_extensions").alias("ext_risky"), has("ext", "compressed_extensions").alias("ext_compressed"),
        has("tld", "risk_tlds").alias("tld_risky"), has("sld", "impersonation_targets").alias("sld_brand"),
        best("common").alias("best_common"), *[best(c).alias("best_" + c) for c in K.MALICIOUS],
        F.slice(F.sort_array(F.collect_list(F.when(is_feature, match)), False), 1, 5).alias("top_matches"))
    d = d.join(per_row, key, "left")
    for name in HITS:
        d = d.withColumn(name, F.coalesce(name, empty_strings()))
    for name in ["ext_risky", "ext_compressed", "tld_risky", "sld_brand"]:
        d = d.withColumn(name, F.coalesce(name, F.lit(False)))
    for name in ["best_common"] + ["best_" + c for c in K.MALICIOUS]:
        d = d.withColumn(name, F.coalesce(name, F.lit(0.0)))
    return d


def dictionary_matches(d: DataFrame, dictionary: DataFrame, key: str = "row_id") -> DataFrame:
    """Best context-weighted score per scope of rows with `features`: best_<scope>, matches; rows with a match only."""
    long = exploded(d, F.col("features"), "token", key, "sld", "tld")
    found = long.join(dictionary.select("token", "scope", "score"), "token")
    weight = context_weight(F.col("token"), F.col("sld"), F.col("tld"))["weight"]
    found = found.select(key, "scope", (F.col("score") * weight).alias("value"))
    best = lambda scope: F.coalesce(F.max(F.when(F.col("scope") == scope, F.col("value"))), F.lit(0.0))
    return found.groupBy(key).agg(F.count("*").alias("matches"),
                                  *[best(c).alias("best_" + c) for c in [L.COMMON] + K.MALICIOUS])


def rules(learned: bool) -> list[tuple[str, Column, Column, dict[str, Column], Column]]:
    """(name, condition, score, score per class, reason) in reason order.

    The columns are those of `parsed` and of one of the hit sources.
    """
    c, lit = F.col, F.lit
    n = lambda name: F.size(name)
    text = lambda name, *values: filled(TX.URL_REASONS[name], *values)
    first = lambda name, k=5: F.array_join(F.slice(name, 1, k), ", ")
    has_file = F.contains("last_segment", lit("."))
    deface = F.least(lit(0.44), lit(0.28) + lit(0.06) * (n("defacement_hits") - 1))
    deface_page = ((n("defacement_hits") > 0) & F.arrays_overlap("path_parts", "defacement_hits")
                   & c("last_segment").rlike(r"[.](html|htm|php)$"))
    lure = F.least(lit(0.30), lit(0.12) + lit(0.06) * n("malware_hits"))
    brand = F.when(n("phishing_hits") == 1, 0.30).otherwise(0.24)
    delivery = F.when(F.size(F.array_remove("malware_hits", "exe")) > 0, text("malware_terms", first("malware_hits"))
                      ).otherwise(text("malware_exe"))
    # (rule, condition, score, score per class, values of the text)
    table = [
        ("userinfo", F.contains("clean", lit("@")), lit(0.25), {"phishing": lit(0.18)}, []),
        ("percent", F.contains("clean", lit("%")), lit(0.10), {"phishing": lit(0.04)}, []),
        ("ip_host", c("is_ipv4"), lit(0.30), {}, []),
        ("long_url", F.length("clean") >= 120, lit(0.10), {}, []),
        ("many_labels", (n("labels") >= 4) & ~c("is_ipv4"), lit(0.08), {}, []),
        ("mixed_digits", c("mixes_digits"), lit(0.14), {}, []),
        ("lookalike", c("looks_alike"), lit(0.05), {}, [c("sld_plain")]),
        ("many_digits", c("looks_alike") & (c("sld_digits") >= 2), lit(0.15), {}, []),
        ("impersonation", c("looks_alike") & c("sld_brand"), lit(0.22), {"phishing": lit(0.22)}, [c("sld_plain")]),
        ("risk_tld", c("tld_risky") & ~c("is_ipv4"), lit(0.16), {}, [c("tld")]),
        ("compressed", c("ext_risky") & c("ext_compressed"), lit(0.28), {"malware": lit(0.22)}, [c("extension")]),
        ("executable", c("ext_risky") & ~c("ext_compressed"), lit(0.40), {"malware": lit(0.34)}, [c("extension")]),
        ("risk_terms", n("risk_hits") > 0, F.least(lit(0.30), lit(0.08) * n("risk_hits")), {}, [first("risk_hits")]),
        ("phishing_terms", n("phishing_hits") >= 2, lit(0.18), {"phishing": lit(0.24)}, [first("phishing_hits")]),
        ("defacement_terms", n("defacement_hits") > 0, deface, {"defacement": deface}, [first("defacement_hits")]),
        ("defacement_page", deface_page, lit(0.08), {"defacement": lit(0.08)}, []),
        ("malware_terms", (n("malware_hits") > 0) & has_file, lure, {"malware": lure}, None),
        ("brand", (n("brand_hits") > 0) & (n("phishing_hits") > 0), brand, {"phishing": brand}, [first("brand_hits", 3)]),
        ("http", c("scheme") == "http", lit(0.08), {}, []),
    ]
    if learned:
        best = F.greatest("best_common", *["best_" + x for x in K.MALICIOUS])
        matches = F.transform("top_matches", lambda m: F.concat(
            m["label"], lit(":"), m["feature"], lit(" ("), m["context"], lit(")")))
        table.append(("dictionary", F.coalesce(n("top_matches"), lit(0)) > 0, F.least(lit(0.35), best / 20.0),
                      {x: F.least(lit(0.45), c("best_" + x) / 18.0) for x in K.MALICIOUS}, [F.array_join(matches, ", ")]))
    return [(name, cond, score, by, delivery if values is None else text(name, *values))
            for name, cond, score, by, values in table]


def query_reasons() -> Column:
    """One reason per query pair whose value holds a known term."""
    def reason(p):
        key, value = F.trim(p["key"]), F.trim(p["value"])
        hits = F.sort_array(F.array_intersect(value_parts(p), F.col("query_terms")))
        return F.when((key != "") & (value != "") & (F.size(hits) > 0), filled(
            TX.URL_REASONS["query"], key, F.substring(value, 1, 80), F.array_join(F.slice(hits, 1, 5), ", ")))

    return F.array_compact(F.transform("pairs", reason))


def apply_rules(d: DataFrame, learned: bool, only: list[str] | None = None) -> DataFrame:
    """Add raw_score, type_<class> and url_reasons; `only` limits the sums to some rules."""
    chosen = [r for r in rules(learned) if only is None or r[0] in only]
    total = sum((F.when(cond, score).otherwise(0.0) for _, cond, score, _, _ in chosen), F.lit(0.0))
    d = d.withColumn("raw_score", total)
    for name in K.MALICIOUS:
        parts = [F.when(cond, by[name]).otherwise(0.0) for _, cond, _, by, _ in chosen if name in by]
        d = d.withColumn("type_" + name, sum(parts, F.lit(0.0)))
    reasons = F.array_compact(F.array(*[F.when(cond, text) for _, cond, _, _, text in chosen]))
    return d.withColumn("url_reasons", F.concat(query_reasons(), reasons) if only is None else reasons)


def url_evidence(df: DataFrame, dictionary: DataFrame | None = None, metadata: bool = True,
                 key: str = "row_id",
                 url: str = "url") -> DataFrame:
    """The input's rows with url_score, type_<class>, url_reasons and parse_error.

    Without a dictionary no shuffle happens.
    """
    keep = df.columns
    d = parsed(df, url)
    d = static_hits(d) if dictionary is None else learned_hits(d, dictionary, metadata, key)
    d = apply_rules(d, dictionary is not None)
    return d.select(*keep, clip01(F.col("raw_score")).alias("url_score"), *["type_" + c for c in K.MALICIOUS],
                    "url_reasons", "parse_error")
