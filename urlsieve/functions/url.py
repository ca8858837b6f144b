"""URL cleaning and parsing as column expressions (no Python runs per row)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters removed by stripping a text, as in Python's str.strip().
WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + \
    "    　"
CONTROL = "".join(map(chr, range(0x20))) + "\x7f"
SCHEME_RE = r"^[a-zA-Z][a-zA-Z0-9+\-.]*://"
# URL schemes whose last path segment may carry ";parameters".
PARAM_SCHEMES = [
    "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps", "rtspu", "sip", "sips", "mms", "sftp", "tel",
]
# Host characters that turn into a URL delimiter under NFKC; such hosts are invalid.
_NFKC_DELIMITERS = "".join(
    c for c in map(chr, range(0x80, 0x10000))
    if unicodedata.category(c) not in ("Cs", "Cn") and set(unicodedata.normalize("NFKC", c)) & set("/?#@:")
)
IPV4_RE = r"^\d{1,3}(\.\d{1,3}){3}$"


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def if_array(cond: Column, items: Column) -> Column:
    return F.when(cond, items).otherwise(empty_strings())


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else empty_strings()


def _decode(c: Column) -> Column:
    # A bare "%" is kept as text; try_url_decode then never meets a broken escape.
    return F.try_url_decode(F.regexp_replace(c, r"%(?![0-9a-fA-F]{2})", "%25"))


def percent_decode(c: Column) -> Column:
    """Decode %XX once, keep "+", drop bytes that are not UTF-8."""
    decoded = F.regexp_replace(_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), "�", "")
    return F.when(F.contains(c, F.lit("%")), decoded).otherwise(c)


def form_decode(c: Column) -> Column:
    """Decode a query key or value: "+" is a space, invalid bytes become U+FFFD."""
    return F.when(c.rlike("[%+]"), _decode(c)).otherwise(c)


def clean_url(c: Column) -> Column:
    """Trim, lower, decode once, then drop brackets and control characters."""
    return F.translate(percent_decode(F.lower(strip(text(c)))), "[]" + CONTROL, "")


def clean_evidence_url(c: Column) -> Column:
    """As clean_url, but brackets and control characters stay."""
    return percent_decode(F.lower(strip(text(c))))


def split_alnum(c: Column, min_length: int = 1) -> Column:
    """Runs of ASCII letters and digits of at least min_length."""
    return F.filter(F.split(c, "[^a-zA-Z0-9]+"), lambda x: F.length(x) >= min_length)


def split_parts(c: Column) -> Column:
    """Clean (that is, decode again) and split; parts have two characters or more."""
    return split_alnum(clean_url(c), 2)


def split_clean_parts(c: Column) -> Column:
    """split_parts of a text that clean_url and lower have passed: only a residual "%" needs cleaning again."""
    return split_alnum(F.when(F.contains(c, F.lit("%")), clean_url(c)).otherwise(c), 2)


def char_ngrams(part: Column) -> Column:
    """All 3-grams, then all 4-grams of a part with at least 4 characters, prefixed char:."""
    low = F.lower(part)
    return F.flatten(F.transform(
        F.array(F.lit(3), F.lit(4)),
        lambda n: F.transform(
            F.sequence(F.lit(1), F.length(low) - n + 1),
            lambda i: F.concat(F.lit("char:"), F.substring(low, i, n)),
        ),
    ))


def with_default_scheme(c: Column, scheme: str) -> Column:
    return F.when(c.rlike(SCHEME_RE), c).otherwise(F.concat(F.lit(scheme + "://"), c))


def after(c: Column, head: Column, skip: int) -> Column:
    return F.substring(c, F.length(head) + F.lit(skip + 1), F.length(c))


def split_url(df: DataFrame, target: str, prefix: str = "") -> DataFrame:
    """Add scheme, netloc, path, params-free path, query and fragment of the absolute URL in `target`.

    Only substring arithmetic: each step is one pass in generated code.
    """
    p = lambda name: prefix + name
    t = F.col(target)
    scheme = F.substring_index(t, "://", 1)
    df = df.withColumn(p("scheme"), F.lower(scheme)).withColumn("_rest", after(t, scheme, 3))
    df = df.withColumn("_nofrag", F.substring_index("_rest", "#", 1))
    df = df.withColumn("_noquery", F.substring_index("_nofrag", "?", 1))
    df = df.withColumn(p("netloc"), F.substring_index("_noquery", "/", 1))
    raw_path = after(F.col("_noquery"), F.col(p("netloc")), 0)
    df = df.withColumn(p("path"), F.when(
        F.contains(raw_path, F.lit(";")) & F.col(p("scheme")).isin(PARAM_SCHEMES),
        F.regexp_replace(raw_path, ";[^/]*$", ""),
    ).otherwise(raw_path))
    df = df.withColumn(p("query"), after(F.col("_nofrag"), F.col("_noquery"), 1))
    df = df.withColumn(p("fragment"), after(F.col("_rest"), F.col("_nofrag"), 1))
    return df.drop("_rest", "_nofrag", "_noquery")


def invalid_netloc(netloc: Column) -> Column:
    """Unbalanced brackets, or a character that normalises to a delimiter."""
    unbalanced = F.contains(netloc, F.lit("[")) != F.contains(netloc, F.lit("]"))
    return unbalanced | netloc.rlike("[" + _NFKC_DELIMITERS + "]")


def with_url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Tokeniser-side parsing: cleans `url`, adds clean, scheme, netloc, path, query, fragment.

    Invalid hosts are read as http://invalid.local/.
    """
    df = df.withColumn("clean", clean_url(F.col(url)))
    df = split_url(df.withColumn("_target", with_default_scheme(F.col("clean"), "http")), "_target")
    bad = invalid_netloc(F.col("netloc"))
    return (df.withColumn("_bad", bad)
            .withColumn("scheme", F.when(F.col("_bad"), "http").otherwise(F.col("scheme")))
            .withColumn("netloc", F.when(F.col("_bad"), "invalid.local").otherwise(F.lower("netloc")))
            .withColumn("path", F.when(F.col("_bad"), "/").otherwise(F.lower("path")))
            .withColumn("query", F.when(F.col("_bad"), "").otherwise(F.lower("query")))
            .withColumn("fragment", F.when(F.col("_bad"), "").otherwise(F.col("fragment")))
            .drop("_target", "_bad"))


def host_of_netloc(netloc: Column) -> Column:
    """Without user info, port and one leading "www."."""
    host = F.substring_index(F.substring_index(netloc, "@", -1), ":", 1)
    return F.regexp_replace(host, r"^www[.]", "")


def normalized_host(netloc: Column) -> Column:
    return F.btrim(host_of_netloc(netloc), F.lit("."))


def hostname(netloc: Column) -> Column:
    """Host without user info and port; the text between brackets for a bracketed host."""
    info = F.substring_index(netloc, "@", -1)
    bracketed = F.substring_index(F.substring_index(info, "[", -1), "]", 1)
    return F.lower(F.when(F.contains(info, F.lit("[")), bracketed).otherwise(F.substring_index(info, ":", 1)))


def query_pairs(query: Column) -> Column:
    """Ordered key/value pairs; blanks and duplicates stay."""
    pieces = F.filter(F.split(query, "&"), lambda x: x != "")
    return F.transform(pieces, lambda x: F.struct(
        form_decode(F.substring_index(x, "=", 1)).alias("key"),
        form_decode(after(x, F.substring_index(x, "=", 1), 1)).alias("value"),
    ))


def labels_of(host: Column) -> Column:
    return F.filter(F.split(host, "[.]"), lambda x: x != "")


def is_ipv4(host: Column) -> Column:
    return host.rlike(IPV4_RE)


def with_evidence_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Evidence-side parsing: adds clean, scheme, host, path, query, parse_error and the host anatomy.

    A URL whose host cannot be parsed gets a null host and parse_error = true.
    """
    df = df.withColumn("clean", with_default_scheme(clean_evidence_url(F.col(url)), "https"))
    df = split_url(df.withColumn("_target", F.translate("clean", "\t\r\n", "")), "_target")
    df = df.withColumn("parse_error", invalid_netloc(F.col("netloc")))
    df = df.withColumn("host", F.when(~F.col("parse_error"), hostname(F.col("netloc"))))
    host = F.coalesce("host", F.lit(""))
    df = df.withColumn("labels", labels_of(host)).withColumn("is_ipv4", is_ipv4(host))
    n = F.size("labels")
    df = (df.withColumn("tld", F.coalesce(F.try_element_at("labels", F.lit(-1)), F.lit("")))
          .withColumn("sld", F.coalesce(F.try_element_at("labels", F.lit(-2)), F.lit("")))
          .withColumn("sub_labels", if_array(n >= 3, F.slice("labels", 1, F.greatest(n - 2, F.lit(0)))))
          .withColumn("last_segment", F.lower(F.substring_index("path", "/", -1))))
    df = (df.withColumn("label_parts", F.flatten(F.transform("labels", lambda x: split_alnum(x))))
          .withColumn("sub_parts", F.flatten(F.transform("sub_labels", lambda x: split_alnum(x))))
          .withColumn("path_parts", split_alnum(F.col("path")))
          .withColumn("query_parts", split_alnum(F.col("query"))))
    return (df.withColumn("context_parts", F.array_distinct(
                F.concat("sub_labels", "sub_parts", "path_parts", "query_parts")))
            .withColumn("extension", F.when(F.contains("last_segment", F.lit(".")),
                                            F.substring_index("last_segment", ".", -1)))
            .drop("_target", "fragment"))


def exploded(df: DataFrame, items, name: str, *keep) -> DataFrame:
    """One row per array element, in column `name`, next to `keep`; empty arrays give no row.

    An inner explode makes the optimizer infer a filter on the array's size and push it down, which
    repeats the whole expression behind `items`. The outer form with a filter afterwards does not.
    """
    return df.select(*keep, F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())


def filled(template: str, *values: Column) -> Column:
    """The template with its {} places filled from columns."""
    pieces = template.split("{}")
    items = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:]):
        items += [value.cast("string"), F.lit(piece)]
    return F.concat(*[i for i in items])
