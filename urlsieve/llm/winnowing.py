"""Benchmark decontamination by winnowing: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import ascii_lower, broadcast_counted

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what separates words, after lower-casing
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # a word before lower-casing
GRAM = 5


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                  item_key: str = "item_id", item_text: str = "text", window: int = 10, gram: int = GRAM) -> DataFrame:
    """For every row of `docs`: key, n_words, n_hit, n_items, items_sha256, contaminated, text_hash.

    Every shared run of `window` words is found. A window of w = window - gram + 1 successive grams keeps its
    smallest hash; equal windows keep the same, so joining the kept hashes of both sides misses none. A document
    keeps a hash where it changes and at least every w windows, so each kept one stands for at most w windows.
    Those are spelled out, joined with the benchmark's windows word by word, and extended: overlapping windows
    count each word once. Items below `window` words are one window of their own length, matched the same way
    by their whole hash.

    Null text has no words; a document or benchmark without words has no hits, and hits nothing. An item
    without id marks words but is not counted or listed. Repeated rows give repeated results; rows that share a
    key but not the text are told apart by the hash of the text. Other columns are not looked at.
    """
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    counts = rows.select("key", "text_hash", F.when(F.col("text").isNull(), 0).otherwise(
        F.regexp_count("text", F.lit(WORD))).cast("long").alias("n_words"))

    items = benchmark.select(F.col(item_key).cast("string").alias("item"), words(F.col(item_text)).alias("words"))
    items = items.withColumn("n", F.size("words")).filter("n > 0")
    spans = F.when(F.col("n") < window, F.array(F.struct(
        F.col("n").alias("size"), _spelled("words", F.lit(0), F.col("n")).alias("window")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("n") - window), lambda i: F.struct(
            F.lit(window).alias("size"), _spelled("words", i, F.lit(window)).alias("window"))))
    targets = written(items.select("item", F.explode_outer(spans).alias("w")).select("item", "w.size", "w.window").distinct(),
                      "targets")
    sizes = [r["size"] for r in targets.select("size").distinct().collect()]  # at most `window` of them
    prints = written(targets.select("size", F.split("window", " ").alias("words")).select(
        "size", F.when(F.col("size") < window, _hash("words", F.lit(0), F.col("size"), window)).otherwise(
            F.array_min(_grams("words", gram))).alias("print")).distinct(), "prints")
    prints = broadcast_counted(prints, prints.count())

    text_rows = rows.select("key", "text_hash", words(F.col("text")).alias("words"))
    found = None
    for size in sorted(sizes):
        part = _kept(text_rows, window, gram) if size == window else _whole(text_rows, size, window)
        part = part.join(prints.filter(F.col("size") == size).select("print"), "print", "left_semi")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return _result(counts, None, key)
    found = written(found.groupBy("key", "text_hash").agg(F.collect_set(F.struct("at", "last", "size")).alias("runs")),
                    "candidates")
    found = broadcast_counted(found.select(F.col("key").alias("f_key"), F.col("text_hash").alias("f_hash"), "runs"),
                              found.count())
    starts = F.flatten(F.transform("runs", lambda r: F.transform(
        F.sequence(r["at"], r["last"]), lambda i: F.struct(i.alias("at"), r["size"].alias("size")))))
    spelled = rows.join(found, F.col("key").eqNullSafe(F.col("f_key")) & (F.col("text_hash") == F.col("f_hash"))) \
        .select("key", "text_hash", F.array_distinct(starts).alias("starts"), words(F.col("text")).alias("words")) \
        .select("key", "text_hash", F.explode_outer("starts").alias("w"), "words") \
        .select("key", "text_hash", "w.at", "w.size", _spelled("words", F.col("w.at"), F.col("w.size")).alias("window")) \
        .filter("at is not null").distinct()
    hits = written(spelled.join(targets.select("window").distinct(), "window", "left_semi"), "hits")
    places = hits.groupBy("key", "text_hash").agg(
        F.array_sort(F.collect_set(F.struct("at", "size"))).alias("places")).select(
        "key", "text_hash", F.aggregate("places", F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")), lambda a, p: F.struct(
            F.greatest(a["end"], p["at"] + p["size"]).alias("end"),
            (a["total"] + p["at"] + p["size"] - F.least(F.greatest(a["end"], p["at"]), p["at"] + p["size"])).alias("total")),
            lambda a: a["total"]).cast("long").alias("n_hit"))
    listed = hits.join(targets.filter("item is not null").select("window", "item"), "window") \
        .groupBy("key", "text_hash").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return _result(counts, places.join(listed.withColumnRenamed("key", "i_key"), F.col("key").eqNullSafe(F.col("i_key")) & (
        places["text_hash"] == listed["text_hash"]), "left").select("key", places["text_hash"], "n_hit", "items"), key)


def _result(counts: DataFrame, hits: DataFrame | None, key: str) -> DataFrame:
    if hits is None:
        joined = counts.withColumns({"n_hit": F.lit(None).cast("long"), "items": F.lit(None).cast("array<string>")})
    else:
        h = hits.select(F.col("key").alias("h_key"), F.col("text_hash").alias("h_hash"), "n_hit", "items")
        joined = counts.join(h, F.col("key").eqNullSafe(F.col("h_key")) & (F.col("text_hash") == F.col("h_hash")), "left")
    hit, items = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(F.col("key").alias(key), "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
                         F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
                         "text_hash")


def _spelled(words: str, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start + 1, size), " ")


def _hash(words: str, start: Column, size: Column, most: int) -> Column:
    """Hash of the `size` words from `start`, at most `most`; a missing word counts as nothing."""
    return F.xxhash64(*[F.when(F.lit(x) < size, F.get(words, start + x)) for x in range(most)])


def _grams(words: str, gram: int) -> Column:
    """Hashes of the runs of `gram` words; the array must have as many words."""
    return F.transform(F.sequence(F.lit(0), F.size(words) - gram),
                       lambda i: F.xxhash64(*[F.get(words, i + x) for x in range(gram)]))


def _kept(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """Kept hashes: key, text_hash, print, size, and the windows [at, last] it may stand for."""
    w = window - gram + 1
    least = lambda at: F.least(*[F.get("grams", at + x) for x in range(w)])
    long = rows.filter(F.size("words") >= window).select("key", "text_hash", _grams("words", gram).alias("grams"))
    at = long.select("key", "text_hash", "grams", F.explode_outer(F.sequence(F.lit(0), F.size("grams") - w)).alias("at"))
    kept = at.filter((F.col("at") % w == 0) | (least(F.col("at")) != least(F.col("at") - 1)))
    return kept.select("key", "text_hash", least(F.col("at")).alias("print"), F.lit(window).alias("size"), "at",
                       F.least(F.col("at") + w - 1, F.size("grams") - w).alias("last"))


def _whole(rows: DataFrame, size: int, window: int) -> DataFrame:
    """Hashes of all runs of `size` words, in the form of `_kept`."""
    at = rows.filter(F.size("words") >= size).select(
        "key", "text_hash", "words", F.explode_outer(F.sequence(F.lit(0), F.size("words") - size)).alias("at"))
    return at.select("key", "text_hash", _hash("words", F.col("at"), F.lit(size), window).alias("print"),
                     F.lit(size).alias("size"), "at", F.col("at").alias("last"))
