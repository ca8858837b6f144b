"""Confusion cells and classification metrics, per group of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K


def cells(df: DataFrame, by: list[str] | None = None, truth: str = "type", pred: str = "prediction",
          classes: list[str] = K.CLASSES) -> DataFrame:
    """(by, type, prediction, n) for every pair of classes, zeros included, and for every other pair that occurs.

    Rows are counted first; the class grid is then built from one row per group. A label outside `classes` keeps
    its rows: it gets the cells it has, no zeros.
    """
    by = list(by or [])
    counted = df.groupBy(*by, F.col(truth).alias("type"), F.col(pred).alias("prediction")).agg(F.count("*").alias("n"))
    grid = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(p).alias("prediction")) for t in classes for p in classes])
    listed = F.col("type").isin(classes) & F.col("prediction").isin(classes)
    found = F.map_from_entries(F.collect_list(F.when(listed, F.struct(F.struct("type", "prediction"), "n"))))
    per_group = counted.groupBy(*by).agg(found.alias("m"))  # at most classes * classes entries
    full = per_group.select(*by, "m", F.explode(grid).alias("c"))
    full = full.select(*by, "c.type", "c.prediction", F.coalesce(F.try_element_at("m", F.col("c")), F.lit(0)).alias("n"))
    return full.unionByName(counted.filter(~F.coalesce(listed, F.lit(False))))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def per_class(cell_rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, class, tp, support, predicted, precision, recall, f1); zero divisions give 0."""
    by = list(by or [])
    sides = F.array(F.struct(F.col("type").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                             F.when(F.col("type") == F.col("prediction"), F.col("n")).otherwise(0).alias("tp")),
                    F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("support"),
                             F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")))
    d = cell_rows.select(*by, F.inline(sides)).groupBy(*by, "class").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    d = d.withColumn("precision", _ratio(F.col("tp"), F.col("predicted"))).withColumn(
        "recall", _ratio(F.col("tp"), F.col("support")))
    return d.withColumn("f1", _ratio(2.0 * F.col("tp"), F.col("support") + F.col("predicted")))


def _summaries(focus: str) -> list[Column]:
    seen = (F.col("support") + F.col("predicted")) > 0
    n = F.sum("support")
    aggs = [n.alias("rows"), _ratio(F.sum("tp"), n).alias("accuracy")]
    for m in ("precision", "recall", "f1"):
        aggs.append(F.coalesce(F.avg(F.when(seen, F.col(m))), F.lit(0.0)).alias("macro_" + m))
        aggs.append(_ratio(F.sum(F.col(m) * F.col("support")), n).alias("weighted_" + m))
        aggs.append(F.coalesce(F.max(F.when(F.col("class") == focus, F.col(m))), F.lit(0.0)).alias(f"{focus}_{m}"))
    return aggs


def summary(class_rows: DataFrame, by: list[str] | None = None, focus: str = K.PHISHING) -> DataFrame:
    """(by, rows, accuracy, macro and weighted precision/recall/f1, focus-class precision/recall/f1).

    The macro mean runs over classes that occur as truth or prediction.
    """
    return class_rows.groupBy(*(by or [])).agg(*_summaries(focus))


def report(class_rows: DataFrame, focus: str = K.PHISHING) -> DataFrame:
    """Classification report: one row per class, then accuracy, macro avg and weighted avg. One pass."""
    item = F.struct(F.col("class").alias("label"), "precision", "recall", "f1", "support")
    total = class_rows.agg(F.collect_list(item).alias("classes"), *_summaries(focus))  # one item per class
    row = lambda name, p, r, f: F.struct(F.lit(name).alias("label"), F.col(p).alias("precision"), F.col(r).alias("recall"),
                                         F.col(f).alias("f1"), F.col("rows").alias("support"))
    extra = F.array(row("accuracy", "accuracy", "accuracy", "accuracy"),
                    row("macro avg", "macro_precision", "macro_recall", "macro_f1"),
                    row("weighted avg", "weighted_precision", "weighted_recall", "weighted_f1"))
    return total.select(F.inline(F.concat("classes", extra)))


def cumulative(cell_rows: DataFrame, order: str = "batch_idx") -> DataFrame:
    """Cells summed over all batches up to each one; one group holds one small row per batch."""
    w = W.partitionBy("type", "prediction").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return cell_rows.withColumn("n", F.sum("n").over(w))
