"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written
from .common import unclashing

COLUMNS = ["size", "source_size", "target", "taken", "text_hash", "positions"]
WEIGHTS = (5.0, 2.0, 1.0)
# (time, weight) knots of each weight's schedule: how a source's share of the words moves while training runs.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 1.0), (1.0, 1.75)))
MOST_EPOCHS = 3
CELL_DIGITS = 4  # hexadecimal digits of the order key that name a cell: 65,536 cells a source
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, class, target) from (source, source_size): one row a source, null last.

    Targets share the sum of all sizes by weight; a target stops at `most` times the source's size and what
    exceeds it is shared again by weight. Taken in the order of limit / weight, a source stops there exactly
    when the level of the rest reaches it, so running sums replace the rounds.
    """
    everything, ordered = W.partitionBy(), W.orderBy(F.col("source").asc_nulls_last())
    d = sizes.withColumn("class", (F.row_number().over(ordered) - 1) % len(weights))
    d = d.withColumns({"weight": F.element_at(F.array(*map(F.lit, weights)), F.col("class") + 1),
                       "limit": (F.col("source_size") * most).cast("double")})
    filling = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    rest = F.sum("weight").over(filling.rowsBetween(W.currentRow, W.unboundedFollowing))
    d = d.withColumn("level", left / rest).withColumn("full", F.col("limit") <= F.col("level") * F.col("weight"))
    level = F.min(F.when(~F.col("full"), F.struct(F.col("limit") / F.col("weight"), "level"))).over(everything)["level"]
    return d.select("source", "source_size", "class", F.when(F.col("full"), F.col("limit")).otherwise(
        F.least("limit", level * F.col("weight"))).alias("target"))


def curriculum(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
               weights: tuple[float, ...] = WEIGHTS, schedules=SCHEDULES, most: int = MOST_EPOCHS,
               keep: tuple[str, ...] = ()) -> DataFrame:
    """For every row of `docs`: key, source, size, source_size, target, taken, text_hash, positions, and the columns
    of `keep` that are not named like one of these.

    A source's schedule, integrated over training time 0 to 1 and scaled to its target, is its cumulative demand
    for words. Its documents stand in a fixed order (md5 of the key, then key and text hash) and are laid end
    to end, over and over, along that demand; a pass of a document that begins before the demand ends is taken,
    and the last one is cut there. Inverting the demand at the middle of a pass gives its training position in
    `positions`; `training_order` sorts by it. So a source's taken words are its target rounded, and no document
    is taken more than `most` times.

    Running sums add the words of the cells before (65,536 per source by the order key) to those inside a cell,
    so no source is gathered in one task; one row a source meets in one task. Null text or text without words
    has size 0, is taken 0 times and has no position; null is a source of its own, the last. Repeated rows are
    documents of their own. Rows with a null key stand first. An empty table gives an empty one.
    """
    keep = tuple(unclashing(list(keep), [key, source, *COLUMNS]))
    d = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), words(F.col(text)).alias("size"),
                    F.xxhash64(text).alias("text_hash"), *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)])
    order = F.md5(F.coalesce(F.col("key").cast("string"), F.lit("")))
    # `src` is the source without null, so that sums and join below share one shuffle of the rows
    d = d.withColumns({"order": order, "cell": F.substring(order, 1, CELL_DIGITS),
                       "src": F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))})
    if not keep:
        d = written(d, "mix")
    cells = written(d.groupBy("source", "src", "cell").agg(F.sum("size").alias("cell_size")), "cells")
    targets = source_targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, most)
    before = W.partitionBy("source").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("cells_before", F.coalesce(F.sum("cell_size").over(before), F.lit(0)))
    meant = cells.alias("c").join(targets.alias("t"), F.expr("c.source <=> t.source")).select(
        "src", "cell", "cells_before", "source_size", "target", "class")
    inside = W.partitionBy("src", "cell").orderBy("order", "key", "text_hash").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))) \
        .join(meant, ["src", "cell"])
    demand = F.round("target").cast("long")
    start = F.col("cells_before") + F.col("inside")
    full = F.when(F.col("source_size") > 0, F.floor(demand / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    rest = F.least(F.greatest(demand - full * F.col("source_size") - start, F.lit(0)), F.col("size"))
    d = d.withColumns({"demand": demand, "start": start, "full": full, "rest": rest})
    passes = F.when(F.col("size") > 0, F.col("full") + (F.col("rest") > 0).cast("long")).otherwise(0)
    middle = lambda p: (p * F.col("source_size") + F.col("start")
                        + F.when(p < F.col("full"), F.col("size")).otherwise(F.col("rest")) / 2) / F.col("demand")
    positions = F.when(passes > 0, F.transform(F.sequence(F.lit(0).cast("long"), passes - 1),
                                               lambda p: _time_of(middle(p), F.col("class"), schedules)))
    return d.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target",
                    (F.col("full") * F.col("size") + F.col("rest")).alias("taken"), "text_hash",
                    F.coalesce(positions, F.array().cast("array<double>")).alias("positions"),
                    *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)])


def training_order(mixed: DataFrame, partitions: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """One row for every pass with its training `position`, sorted by it (then by `ties`) over range partitions."""
    names = unclashing(mixed.columns, ["positions", "position"])
    rows = mixed.select(*names, F.explode_outer("positions").alias("position")).filter("position is not null")
    return rows.repartitionByRange(partitions, "position").sortWithinPartitions("position", *ties)


def training_steps(mixed: DataFrame, partitions: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """Every row of `mixed` with its passes in the training order: `passes`, `first_position` and `first_step`, the
    number of passes before its first one; null where it is not taken.

    The passes are written in training order; a pass's step is its place in its range after the rows of the ranges
    before. One row a range meets in one task.
    """
    names = unclashing(mixed.columns, ["__no", "passes", "first_position", "first_step"])
    mixed = written(mixed.withColumn("__no", F.monotonically_increasing_id()), "mixed")
    order = training_order(mixed.select("__no", "positions", *ties), partitions, ties)
    at = F.monotonically_increasing_id()  # the range above 33 bits of the place in it
    order = written(order.select("__no", "position", F.shiftright(at, 33).alias("range"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "training")
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = order.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    steps = order.join(ranges, "range").groupBy("__no").agg(
        F.count("*").cast("int").alias("passes"), F.min("position").alias("first_position"), F.min(F.col("start") + F.col("at")).alias("first_step"))
    return mixed.select("__no", *names).join(steps, "__no", "left").select(
        *names, F.coalesce("passes", F.lit(0)).alias("passes"), "first_position", "first_step")


def _time_of(share: Column, kind: Column, schedules) -> Column:
    """Training time at which a schedule has used `share` of its integral: a quadratic in the right section."""
    out = F.lit(None).cast("double")
    for c, knots in enumerate(schedules):
        areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
        done, time = 0.0, F.lit(float(knots[-1][0]))
        sections = []
        for ((t0, w0), (t1, w1)), area in zip(zip(knots, knots[1:]), areas):
            sections.append((t0, w0, t1, w1, done, done + area))
            done += area
        for t0, w0, t1, w1, low, high in reversed(sections):
            y, slope = share * done - low, (w1 - w0) / (t1 - t0)
            x = y / w0 if slope == 0 else (F.sqrt(F.greatest(F.lit(w0 * w0) + y * (2 * slope), F.lit(0.0))) - w0) / slope
            time = F.when(share * done < high, F.least(x + t0, F.lit(t1))).otherwise(time)
        out = F.when(kind == c, time).otherwise(out)
    return out
