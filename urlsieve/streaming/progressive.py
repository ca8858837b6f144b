"""Test-then-train over a real stream: every micro-batch is scored, measured, and only then learned from.

All state lies in tables under one folder, keyed by batch or version; a replayed micro-batch overwrites
exactly what its first run wrote.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import constants as K
from ..functions.tokens import with_tokens
from ..operators import features as FE
from ..operators import lexicon as L
from ..operators import metrics as MT
from ..operators import model as M
from ..plans import progressive as PR
from ..session import staged
from ..sources.readers import read_dictionary, write_batch, write_dictionary, write_summary


@dataclass
class Progressive:
    """Folder and dictionary profile of one run. Call warm_up once, then start (or step per batch)."""

    path: str
    top_common: int = K.ADAPTIVE_PROFILE[0]
    top_class: int = K.ADAPTIVE_PROFILE[1]
    min_df: int = K.ADAPTIVE_PROFILE[2]
    linear_model: bool = False
    rate: float = 0.5
    steps: int = 1  # gradient steps per batch

    def _table(self, name: str) -> str:
        return f"{self.path}/{name}"

    # --- dictionary state ---

    def _store_counts(self, rows: DataFrame, batch: int) -> None:
        """Token and document counts of a batch: all a dictionary needs to know of it."""
        write_batch(L.token_df(rows, K.CLASSES), self._table("token_counts"), batch)
        write_batch(L.class_totals(rows, K.CLASSES), self._table("totals"), batch)

    def _build_version(self, spark: SparkSession, version: int, last_batch: int) -> None:
        """Dictionary from the warm-up (batch 0) and the window that ends with last_batch."""
        first = last_batch - K.WINDOW_BATCHES + 1
        wanted = (F.col("batch_id") == 0) | F.col("batch_id").between(max(first, 1), last_batch)
        summed = lambda name, *keys: (lambda d: d.groupBy(*keys).agg(*[
            F.sum(c).alias(c) for c in d.columns if c not in (*keys, "batch_id")]))(
            spark.read.parquet(self._table(name)).filter(wanted))
        totals = summed("totals")
        scored = L.log_odds(summed("token_counts", "token"), totals.select(F.struct(*totals.columns)).scalar(), K.CLASSES,
                            K.BENIGN, self.min_df)
        d = L.cut(scored, self.top_common, self.top_class).select("scope", "token", "score", "rank")
        write_dictionary(d, self._table("dictionary"), version)

    def warm_up(self, rows: DataFrame) -> None:
        """Version 0 from labelled (row_id, url, type) rows, and the model's first weights."""
        rows = with_tokens(rows)
        self._store_counts(rows, 0)
        spark = rows.sparkSession
        self._build_version(spark, 0, 0)
        if self.linear_model:
            FE.tfidf_vocabulary(rows).write.mode("overwrite").parquet(self._table("vocabulary"))
            dense = FE.dense_features(rows, read_dictionary(spark, self._table("dictionary"), 0))
            FE.scaler(dense).write.mode("overwrite").parquet(self._table("scaler"))
            zero = spark.createDataFrame([("dense:length", c, 0.0) for c in K.CLASSES],
                                         "feature string, class string, weight double")
            write_batch(self._trained(rows, zero, 0), self._table("weights"), 0)

    # --- linear model state: weights version b is in force after batch b ---

    def _features(self, rows: DataFrame, version: int) -> DataFrame:
        spark = rows.sparkSession
        dense = FE.dense_features(rows, read_dictionary(spark, self._table("dictionary"), version))
        vocab = spark.read.parquet(self._table("vocabulary"))
        return FE.feature_table(FE.tfidf(rows, vocab), FE.scaled(dense, spark.read.parquet(self._table("scaler"))))

    def _weights(self, spark: SparkSession, batch: int) -> DataFrame:
        return spark.read.parquet(self._table("weights")).filter(F.col("batch_id") == batch).drop("batch_id")

    def _trained(self, rows: DataFrame, weights: DataFrame, version: int) -> DataFrame:
        """Weights after the steps on labelled rows, with the features of a dictionary version."""
        balance = FE.class_weights(rows).select("type", F.col("weight").alias("sample_weight"))
        labels = rows.join(balance, "type").select("row_id", F.col("type").alias("label"), "sample_weight")
        features = self._features(rows, version)
        for _ in range(self.steps):
            weights = staged(M.gradient_step(features, weights, labels, self.rate))
        return weights

    def _learn(self, rows: DataFrame, version: int, batch: int) -> None:
        """Weights in force after a batch: trained on it and, where it brought a new dictionary, once more on the window
        of stored batches under that dictionary. They start from the batch before, so a replay gives the same."""
        spark = rows.sparkSession
        weights = self._trained(rows, self._weights(spark, batch - 1), version)
        if batch % K.UPDATE_INTERVAL == 0:
            window = spark.read.parquet(self._table("rows")).filter(
                F.col("batch_id").between(max(batch - K.WINDOW_BATCHES + 1, 1), batch)).drop("batch_id")
            weights = self._trained(window, weights, batch // K.UPDATE_INTERVAL)
        write_batch(weights, self._table("weights"), batch)

    def _predict(self, rows: DataFrame, version: int, batch: int) -> DataFrame:
        if not self.linear_model:
            d = read_dictionary(rows.sparkSession, self._table("dictionary"), version)
            hits = FE.risk_features(rows, d)
            return PR.lexicon_argmax(rows.select("row_id", "type").join(hits, "row_id"))
        margins = M.margins(self._features(rows, version), self._weights(rows.sparkSession, batch - 1))
        p = M.one_vs_rest(margins).groupBy("row_id").pivot("class", K.CLASSES).agg(F.first("p"))
        p = p.select("row_id", *[F.coalesce(F.col(c), F.lit(0.0)).alias("p_" + c) for c in K.CLASSES])
        return M.phishing_gate(rows.select("row_id", "type").join(p, "row_id")).withColumnRenamed("base_pred", "prediction")

    # --- one micro-batch ---

    def step(self, batch: DataFrame, batch_id: int) -> None:
        """Score, measure, learn. Batches count from 1; batch_id from 0."""
        spark, b = batch.sparkSession, batch_id + 1
        version = (b - 1) // K.UPDATE_INTERVAL
        rows = with_tokens(batch)
        predicted = self._predict(rows, version, b).select("row_id", "type", "prediction")
        write_batch(predicted.withColumn("version", F.lit(version)), self._table("predictions"), b)
        stored = spark.read.parquet(self._table("predictions")).filter(F.col("batch_id") == b)
        cells = MT.cells(stored)
        write_batch(cells, self._table("cells"), b)
        write_batch(MT.summary(MT.per_class(cells)), self._table("metrics"), b)
        self._store_counts(rows, b)
        if b % K.UPDATE_INTERVAL == 0:
            self._build_version(spark, b // K.UPDATE_INTERVAL, b)
        if self.linear_model:
            write_batch(rows.select("row_id", "url", "type", "tokens"), self._table("rows"), b)
            self._learn(rows, version, b)

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Run over a stream of (row_id, url, type); one file per micro-batch keeps the batches apart."""
        return (stream.writeStream.foreachBatch(self.step).option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start())

    def cumulative(self, spark: SparkSession) -> DataFrame:
        """Metrics over all batches up to each one."""
        cells = spark.read.parquet(self._table("cells"))
        running = MT.cumulative(cells, "batch_id")
        return MT.summary(MT.per_class(running, ["batch_id"]), ["batch_id"])

    def run_summary(self, spark: SparkSession) -> DataFrame:
        """The run in one row, also written as JSON."""
        sizes = spark.read.parquet(self._table("totals")).groupBy("batch_id").agg(F.sum("n").alias("n"))
        cells = spark.read.parquet(self._table("cells"))
        summary = PR.run_summary(cells, sizes.select(F.col("batch_id").alias("batch_idx"), "n"))
        write_summary(summary, self._table("summary"))
        return summary


def running_cells(predictions: DataFrame) -> DataFrame:
    """Confusion counts of a stream of (type, prediction); for complete or update mode."""
    return predictions.groupBy("type", "prediction").count()
