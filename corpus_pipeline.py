"""Corpus preparation: language, near copies, benchmark passages, mixture, shards.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before kept, and returns the columns
of `docs`; the last adds shard and slot in place of any of that name. Nulls in any column go through, extra columns
are carried along, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsieve.llm import curriculum, jaccard_join, language, sharding, winnowing
from urlsieve.llm.common import table, unclashing, without
from urlsieve.session import written

SHARDS = 8
ORACLE_SQL = None  # cross-parsing has no SQL


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that have no language: null text, or not one letter. The rest keep their label; a
    missing one is filled with the prediction, which is learned from the labelled documents. Where no label could be
    learned from, it stays null."""
    found = language.identify(docs, language.fit(docs), out="__lang", score="__score", lettered="__lettered")
    learned = F.when(F.col("__lang") != language.UNDETERMINED, F.col("__lang"))
    return found.filter("__lettered").withColumn("lang", F.coalesce("lang", learned)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies (five words, similarity 0.8): that with the smallest doc_id.
    Documents without words are nobody's copy; of repeated rows one stays."""
    joined = written(jaccard_join.jaccard_join(docs, k=5, percent=80).select("doc_id", "text_hash", "keeper"), "joined")
    kept = without(docs, joined.filter("not keeper"))
    repeated = joined.filter("keeper").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1")
    repeated = written(repeated.select("doc_id", "text_hash"), "repeated")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")),
                     F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")))
    return without(kept, repeated).unionByName(once.dropDuplicates(["__id", "__hash"]).select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold ten successive words, or a whole shorter item, of the benchmark."""
    return without(docs, winnowing.decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("contaminated"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document, in training order. Of a last pass that the mix cuts, half the
    document or more counts as taken; documents without words are not taken."""
    mixed = curriculum.curriculum(_whole(docs), keep=("__row",))
    passes = F.round(F.col("taken") / F.greatest("size", F.lit(1))).cast("int")
    mixed = mixed.withColumn("positions", F.slice("positions", F.lit(1), passes))
    rows = curriculum.training_order(mixed, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.select(*[F.col("__row")[c].alias(c) for c in docs.columns])


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot."""
    put = sharding.shard(_whole(docs), shards=SHARDS, keep=("__row",))
    names = unclashing(docs.columns, ["shard", "slot"])
    return put.select(*[F.col("__row")[c].alias(c) for c in names], "shard", "slot")


def _whole(docs: DataFrame) -> DataFrame:
    """What the operators read, and the whole row as one column, so that no name can clash."""
    return docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("__row"))


STAGES = [("language_id", language_id), ("near_copies", near_copies), ("decontamination", decontamination),
          ("mixture", mixture), ("shards", shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; each but the last is written, texts tightly packed, and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name, "zstd")
    return STAGES[-1][1](spark, docs, sf_dir)
