"""Test-then-train evaluation over a pseudo-stream: seeded order, warm-up prefix, batches, dictionary versions.

Batch 0 is the warm-up. Version v of the dictionary is built from the warm-up and batches
`UPDATE_INTERVAL * v - WINDOW_BATCHES + 1 .. UPDATE_INTERVAL * v`; batch b is scored with version
floor((b - 1) / UPDATE_INTERVAL). All versions come out of one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import features as FE
from ..operators import lexicon as L
from ..operators import metrics as MT
from ..operators.model import shuffle_key
from ..session import written

BUCKET_DIGITS = 4  # 16 ** 4 buckets of a uniform hexadecimal key


def global_rank(df: DataFrame, key: str, tie: str, out: str = "rn") -> DataFrame:
    """Exact row number over (key, tie) without a global sort; `key` is a uniform hexadecimal text.

    Rows are numbered inside 65,536 even key ranges. Only the ranges' counts, at most that many rows,
    meet in one task and are broadcast.
    """
    d = df.withColumn("_b", F.substring(key, 1, BUCKET_DIGITS))
    before = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = d.groupBy("_b").agg(F.count("*").alias("_n")).select(
        "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    d = d.join(F.broadcast(offsets), "_b")
    rank = F.row_number().over(W.partitionBy("_b").orderBy(key, tie))
    return d.withColumn(out, F.col("_offset") + rank).drop("_b", "_offset")


def ordered(df: DataFrame, key: str = "row_id", url: str = "url") -> DataFrame:
    """Add order_key, rn, the warm-up flag of the exact split, and that of the sort-free hash split."""
    d = global_rank(df.withColumn("order_key", shuffle_key(key, url)), "order_key", key)
    d = d.withColumn("n_rows", df.agg(F.count("*").alias("n")).scalar())
    bucket = F.conv(F.substring("order_key", 1, 8), 16, 10).cast("long") % 1000
    return (d.withColumn("warmup_size", F.floor(F.col("n_rows") * K.WARMUP_PER_MILLE / 1000))
            .withColumn("warmup", F.col("rn") <= F.col("warmup_size"))
            .withColumn("warmup_hash", bucket < K.WARMUP_PER_MILLE))


def batched(d: DataFrame, batch_size: Column | int = K.BATCH_SIZE) -> DataFrame:
    """Add batch_idx (0 for the warm-up, then 1, 2, ...) and n_batches to ordered rows."""
    size = batch_size if isinstance(batch_size, Column) else F.lit(batch_size)
    place = F.floor((F.col("rn") - F.col("warmup_size") - 1) / size) + 1
    last = F.floor((F.col("n_rows") - F.col("warmup_size") - 1) / size) + 1
    return (d.withColumn("batch_idx", F.when(F.col("warmup"), 0).otherwise(place))
            .withColumn("n_batches", last))


def versions_of(batch: Column, last_version: Column) -> Column:
    """Dictionary versions that learn from a batch."""
    first = F.ceil(batch / K.UPDATE_INTERVAL)
    final = F.least(F.floor((batch + K.WINDOW_BATCHES - 1) / K.UPDATE_INTERVAL), last_version)
    return (F.when(batch == 0, F.sequence(F.lit(0).cast("long"), last_version))
            .when(first <= final, F.sequence(first, final)))


def version_in_force(batch: Column) -> Column:
    return F.floor((batch - 1) / K.UPDATE_INTERVAL)


def dictionary_versions(d: DataFrame, top_common: int, top_class: int, min_df: int,
                        classes: list[str] = K.CLASSES, negative: str = K.BENIGN) -> DataFrame:
    """(version, scope, token, score, rank) of all versions, from rows with tokens, type, batch_idx, n_batches.

    Tokens are counted per batch first. A later batch teaches few versions, so its counts are repeated for those. The
    warm-up teaches all, and its counts are joined once, to the tokens that a version's window holds. The tokens that
    it does not hold have the counts of the warm-up; those with equal counts have one score, so they go through the
    versions as one row, and only what the cut keeps is spelled out. Rows grow with the rows read, not with versions
    times vocabulary.
    """
    names = ["n"] + ["n_" + c for c in classes]
    rows = d.withColumn("last_version", F.floor(F.col("n_batches") / K.UPDATE_INTERVAL))
    per_batch = written(L.token_df(rows, classes, by=["batch_idx", "last_version"]), "counts")
    keys = [c for c in per_batch.columns if c == "total_df" or c.startswith("df_")]
    docs = rows.groupBy("batch_idx", "last_version").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("type") == c).alias("n_" + c) for c in classes])
    totals = L.exploded(docs, versions_of(F.col("batch_idx"), F.col("last_version")), "version", *names)  # a row a version
    totals = totals.groupBy("version").agg(F.struct(*[F.sum(c).alias(c) for c in names]).alias("t"))

    warm = per_batch.filter("batch_idx = 0").withColumn("kind", F.concat_ws(",", *keys))
    later = L.exploded(per_batch.filter("batch_idx > 0"), versions_of(F.col("batch_idx"), F.col("last_version")), "version", "token", *keys)
    window = later.groupBy("version", "token").agg(*[F.sum(c).alias(c) for c in keys])
    known = warm.select("token", "kind", *[F.col(c).alias("_" + c) for c in keys])
    touched = written(window.join(known, "token", "left").select(
        "version", "token", "kind", *[(F.col(c) + F.coalesce("_" + c, F.lit(0))).alias(c) for c in keys]), "touched")

    hits = touched.filter("kind is not null").groupBy("version", "kind").agg(F.count("*").alias("hits"))
    kinds = warm.filter(F.col("total_df") >= min_df).groupBy("kind", "last_version", *keys).agg(F.count("*").alias("size"))
    untouched = L.exploded(kinds, F.sequence(F.lit(0).cast("long"), "last_version"), "version", "kind", "size", *keys)
    untouched = untouched.join(hits, ["version", "kind"], "left").withColumn("hits", F.coalesce("hits", F.lit(0))) \
        .withColumn("tokens", F.col("size") - F.col("hits")).filter("tokens > 0").drop("size")
    score = lambda counts: L.log_odds(counts.join(totals, "version"), F.col("t"), classes, negative, min_df).drop("t")
    exact = score(touched.drop("kind")).withColumn("tokens", F.lit(1).cast("long"))
    scored = exact.unionByName(score(untouched), allowMissingColumns=True).withColumn("place", F.round("score", L.RANK_PLACES))
    scored = written(scored, "scored")
    most = max(top_common, top_class)
    before = W.partitionBy("version", "scope").orderBy(F.desc("place")).rowsBetween(W.unboundedPreceding, -1)
    places = scored.groupBy("version", "scope", "place").agg(F.sum("tokens").alias("tokens")) \
        .withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0))).filter(F.col("before") < most).drop("tokens")
    kept = scored.join(places, ["version", "scope", "place"]).withColumn("wanted", most - F.col("before") + F.coalesce("hits", F.lit(0)))
    deepest = most + (hits.agg(F.max("hits")).first()[0] or 0)
    spelled = L.top_k(warm.select("kind", "token"), ["kind"], [F.asc("token")], deepest)
    opened = kept.filter("kind is not null").drop("token").join(spelled, "kind").filter(F.col("rank") <= F.col("wanted"))
    opened = opened.join(touched.select("version", "token"), ["version", "token"], "left_anti")
    columns = ["version", "scope", "token", "score"]
    final = kept.filter("kind is null").select(columns).unionByName(opened.select(columns))
    return L.cut(final, top_common, top_class, by=["version"]).select("version", "scope", "token", "score", "rank")


def lexicon_argmax(d: DataFrame) -> DataFrame:
    """Add a prediction from dictionary features: benign under two common hits, else the best class, then name."""
    best = F.greatest(*[f"{c}_score" for c in K.MALICIOUS])
    label = F.lit(None).cast("string")
    for c in reversed(K.MALICIOUS):
        label = F.when(F.col(f"{c}_score") == best, c).otherwise(label)
    return d.withColumn("prediction", F.when(F.col("common_count") < 2, K.BENIGN).otherwise(label))


def scored_stream(d: DataFrame, versions: DataFrame) -> DataFrame:
    """(row_id, type, batch_idx, version, prediction): every batch scored by the version in force before it."""
    stream = d.filter("batch_idx > 0").withColumn("version", version_in_force(F.col("batch_idx")))
    hits = FE.risk_features(stream, versions, by=["version"])
    return lexicon_argmax(stream.select("row_id", "type", "batch_idx", "version").join(hits, "row_id"))


def run_summary(cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row over a whole run: its sizes and settings, the metrics over all batches, and how often benign and phishing
    were taken for each other. `cells` is (type, prediction, n), of any number of batches, `sizes` is (batch_idx, n) with
    the warm-up as batch 0."""
    batch, n = F.col("batch_idx"), F.col("n")
    of = sizes.agg(F.coalesce(F.sum(F.when(batch == 0, n)), F.lit(0)).alias("warmup_size"),
                   F.coalesce(F.sum(F.when(batch > 0, n)), F.lit(0)).alias("progressive_stream_size"),
                   F.count_if(batch > 0).alias("batches"))
    swapped = lambda a, b: F.coalesce(F.sum(F.when((F.col("type") == a) & (F.col("prediction") == b), n)), F.lit(0))
    wrong = cells.agg(swapped(K.BENIGN, K.PHISHING).alias("benign_to_phishing"), swapped(K.PHISHING, K.BENIGN).alias("phishing_to_benign"))
    metrics = ["accuracy", "macro_f1", "weighted_f1", "phishing_precision", "phishing_recall", "phishing_f1"]
    d = MT.summary(MT.per_class(cells)).withColumns({"_of": of.select(F.struct(*of.columns)).scalar(),
                                                     "_wrong": wrong.select(F.struct(*wrong.columns)).scalar()})
    return d.select("_of.*", F.lit(K.WARMUP_PER_MILLE / 1000).alias("warmup_ratio"), F.lit(K.UPDATE_INTERVAL).alias("update_interval"),
                    F.lit(K.WINDOW_BATCHES).alias("sliding_window_batches"),
                    *[F.col(m).alias("cumulative_" + m) for m in metrics], "_wrong.*")
