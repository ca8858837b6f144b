"""Sources and sinks: labelled URLs, lexicons, dictionaries by version, requests, page snapshots, result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.url import exploded, strip

LABELLED = "url string, type string"


def read_labelled_urls(spark: SparkSession, path: str, fmt: str = "csv", url: str = "url", label: str = "type",
                       labels: dict[str, str] | None = None) -> DataFrame:
    """(url, type) of a labelled table; rows with a null in either are dropped.

    Text formats are read with a header and no inference; only the two columns are parsed. `labels` renames
    label codes at the source, for tables that write 0 and 1 for class names.
    """
    reader = spark.read.option("header", True).option("escape", '"') if fmt == "csv" else spark.read
    d = reader.format(fmt).load(path).select(F.col(url).cast("string").alias("url"), F.col(label).cast("string").alias("type"))
    d = d.dropna()
    for code, name in (labels or {}).items():
        d = d.withColumn("type", F.when(F.col("type") == code, name).otherwise(F.col("type")))
    return d


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(category, term) of a JSON object whose values are lists of terms; other values are skipped."""
    d = spark.read.option("multiLine", True).json(path)
    lists = [f.name for f in d.schema.fields if f.dataType.typeName() == "array"]
    items = F.array(*[F.struct(F.lit(n).alias("category"), F.col(f"`{n}`").alias("terms")) for n in lists])
    d = exploded(d, items, "i").select("i.*")
    return exploded(d, F.col("terms"), "term", "category").distinct()


def write_lexicon(lexicon: DataFrame, path: str) -> None:
    """One JSON object from (category, term); a lexicon is a bounded table."""
    per = lexicon.groupBy("category").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    whole = per.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("category", "terms")))).alias("value"))
    whole.coalesce(1).write.mode("overwrite").text(path)


def write_dictionary(dictionary: DataFrame, path: str, version: int | None = None) -> None:
    """Store dictionaries by version; each version given replaces its own folder only."""
    d = dictionary if version is None else dictionary.withColumn("version", F.lit(version))
    (d.repartition("version").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("version").parquet(path))


def read_dictionary(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version, or all; the filter on the folder name prunes the scan."""
    d = spark.read.parquet(path)
    return d if version is None else d.filter(F.col("version") == version).drop("version")


def write_batch(df: DataFrame, path: str, batch_id: int, fmt: str = "parquet") -> None:
    """Result rows of one batch; a replayed batch overwrites its own folder."""
    (df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("header", True).partitionBy("batch_id").format(fmt).save(path))


def write_summary(summary: DataFrame, path: str) -> None:
    """The one row of a run's summary as one JSON object."""
    summary.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def request_urls(df: DataFrame, payload: str = "payload", *keep: str) -> DataFrame:
    """(keep, pos, url): URLs of JSON requests with `urls` (list or one string) or `url`; blanks are skipped."""
    raw = F.from_json(payload, "urls string, url string")
    d = df.select(*keep, raw.alias("r")).select(*keep, "r.urls", "r.url")
    listed = F.from_json("urls", "array<string>")
    urls = F.when(F.col("urls").isNotNull(), F.coalesce(listed, F.array("urls"))).otherwise(F.array("url"))
    clean = F.transform(urls, lambda u, i: F.struct(i.alias("pos"), strip(u).alias("url")))
    return exploded(d, clean, "u", *keep).select(*keep, "u.pos", "u.url").filter("url <> ''")


def page_snapshots(df: DataFrame, html: str = "html", max_bytes: int | None = None) -> DataFrame:
    """Pages with their body cut to `max_bytes` UTF-8 bytes; a broken last character is dropped.

    The default keeps whole bodies; constants.MAX_HTML_BYTES is what a bounded crawler would have stored.
    """
    if max_bytes is None:
        return df
    return df.withColumn(html, truncated(F.col(html), max_bytes))


def truncated(c: Column, max_bytes: int = K.MAX_HTML_BYTES) -> Column:
    cut = F.substring(F.encode(c, "UTF-8"), 1, max_bytes)
    # At most three bytes of a character can be left over at the end.
    tail = F.when(F.is_valid_utf8(cut.cast("string")), cut)
    for n in (1, 2, 3):
        shorter = F.substring(F.encode(c, "UTF-8"), 1, max_bytes - n)
        tail = F.coalesce(tail, F.when(F.is_valid_utf8(shorter.cast("string")), shorter))
    return F.when(F.octet_length(c) <= max_bytes, c).otherwise(tail.cast("string"))
