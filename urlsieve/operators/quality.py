"""Row quality: URL validation and public-address checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.url import hostname, split_url, strip, with_default_scheme


def url_error(url: Column, max_length: int = K.MAX_URL_LENGTH) -> Column:
    """Error code of a URL, null when it is accepted."""
    clean = strip(url)
    return (F.when(url.isNull() | (clean == ""), "missing_url")
            .when(clean.rlike(r"[\x00-\x1f\x7f]"), "invalid_url")
            .when(F.length(clean) > max_length, "url_too_long"))


def validated(df: DataFrame, url: str = "url", max_length: int = K.MAX_URL_LENGTH) -> DataFrame:
    """Add error_code; rows with a code belong in quarantine, the others continue."""
    return df.withColumn("error_code", url_error(F.col(url), max_length))


def accepted(df: DataFrame) -> DataFrame:
    return df.filter("error_code IS NULL")


def quarantined(df: DataFrame) -> DataFrame:
    return df.filter("error_code IS NOT NULL")


# Address blocks that are not public: (first octets as number range), per RFC 1122, 1918, 3927, 5771, 6598, 6890.
BLOCKED_RANGES = [
    ("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"), ("172.16.0.0", "172.31.255.255"), ("192.0.0.0", "192.0.0.8"),
    ("192.0.0.11", "192.0.0.255"), ("192.0.2.0", "192.0.2.255"), ("192.168.0.0", "192.168.255.255"),
    ("198.18.0.0", "198.19.255.255"), ("198.51.100.0", "198.51.100.255"), ("203.0.113.0", "203.0.113.255"),
    ("224.0.0.0", "255.255.255.255"),
]


def _number(address: str) -> int:
    a, b, c, d = map(int, address.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def ipv4_number(host: Column) -> Column:
    """The address a resolver takes a host of numbers for, null for a name: one to four decimal, octal or hexadecimal
    parts, the last of which fills the remaining bytes. -1 where a part is too large."""
    parts = F.split(host, "[.]")
    value = lambda x: F.when(x.rlike("^0[xX]"), F.conv(F.concat(F.lit("0"), F.substring(x, F.lit(3), F.length(x))), 16, 10)) \
        .when(x.rlike("^0[0-7]+$"), F.conv(x, 8, 10)).otherwise(x).try_cast("bigint")
    n = F.size(parts)
    numbers = F.transform(parts, lambda x: F.when(F.length(x) > 13, F.lit(1 << 40)).otherwise(F.coalesce(value(x), F.lit(1 << 40))))
    last = F.get(numbers, n - 1)
    room = F.pow(F.lit(256.0), F.lit(5) - n).cast("bigint")
    bad = (last >= room) | F.exists(F.slice(numbers, F.lit(1), n - 1), lambda x: x > 255)
    front = F.aggregate(F.slice(numbers, F.lit(1), n - 1), F.lit(0).cast("bigint"), lambda acc, x: acc * 256 + x)
    number = F.when(bad, F.lit(-1).cast("bigint")).otherwise(front * room + last)
    return F.when(host.rlike(r"^(0[xX][0-9a-fA-F]*|[0-9]+)([.](0[xX][0-9a-fA-F]*|[0-9]+)){0,3}$"), number)


def ipv6_blocked(host: Column) -> Column:
    """Whether a literal of version 6 lies outside the public ranges, or is none; null for other hosts.

    Public is 2000::/3 without its special parts.
    """
    bare = F.regexp_replace(host, "%.*$", "")
    side = lambda i: F.filter(F.split(F.coalesce(F.get(F.split(bare, "::"), i), F.lit("")), ":"), lambda x: x != "")
    head, tail = side(0), side(1)
    missing = F.lit(8) - F.size(head) - F.size(tail)
    zeros = F.when(missing > 0, F.array_repeat(F.lit("0"), missing)).otherwise(F.array().cast("array<string>"))
    groups = F.concat(head, zeros, tail)
    g = lambda i: F.conv(F.get(groups, i), 16, 10).try_cast("bigint")
    g0, g1 = g(0), g(1)
    wrong = F.exists(groups, lambda x: ~x.rlike("^[0-9a-fA-F]{1,4}$")) | (F.size(groups) != 8) \
        | (~F.contains(bare, F.lit("::")) & (missing != 0))
    kept = (g1 == 3) | ((g1 == 4) & (g(2) == 0x112)) | g1.between(0x20, 0x3F)
    special = ((g0 == 0x2001) & (g1 < 0x200) & ~kept) | ((g0 == 0x2001) & (g1 == 0xDB8)) | (g0 == 0x2002) \
        | ((g0 == 0x3FFF) & (g1 < 0x1000))
    return F.when(F.contains(host, F.lit(":")), F.coalesce(wrong | ~g0.between(0x2000, 0x3FFF) | special, F.lit(True)))


def public_http_error(df: DataFrame, url: str = "url", out: str = "block_reason") -> DataFrame:
    """Add the reason a URL must not be fetched, null when it may be: scheme, host, or a host that is this machine or
    a literal address outside the public ranges, in any spelling a resolver takes."""
    d = split_url(df.withColumn("_target", with_default_scheme(strip(F.col(url)), "https")), "_target", "_p_")
    d = d.withColumn("_host", F.regexp_replace(hostname(F.col("_p_netloc")), "[.]$", ""))
    d = d.withColumn("_number", ipv4_number(F.col("_host"))).withColumn("_v6", ipv6_blocked(F.col("_host")))
    blocked = F.col("_host").rlike("(^|[.])localhost$") | F.coalesce("_v6", F.lit(False)) | (F.col("_number") == -1)
    for low, high in BLOCKED_RANGES:
        blocked = blocked | F.col("_number").between(_number(low), _number(high))
    reason = (F.when(~F.col("_p_scheme").isin("http", "https"), "unsupported_scheme")
              .when(F.col("_host") == "", "missing_host")
              .when(blocked, "blocked_private_or_local_address"))
    return d.withColumn(out, reason).drop("_target", "_host", "_number", "_v6", "_p_scheme", "_p_netloc", "_p_path",
                                          "_p_query", "_p_fragment")
