"""Sharding by sampled splitters: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written
from .common import unclashing

COLUMNS = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
RANGES_PER_SHARD = 16
SAMPLES_PER_RANGE = 64
RANGE_ROWS = 200_000  # a range with more rows is divided
WHOLE_GROUP_SHARE = 100  # a group of equal texts stays together up to this part of a shard


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8,
          keep: tuple[str, ...] = ()) -> DataFrame:
    """Key, size, text_crc32, law, shard, slot, grown_shard (and the columns of `keep`) for every row of `docs`.

    Law `bytes`: shards are ranges of one order with nearly equal sums of size (UTF-8 bytes of the text plus 1).
    The order is by a hash of the text, then by key, so equal texts stand together.

    1. A sample of keys, each row drawn with a chance in proportion to its size, gives quantiles of the hash as
       splitters (expected size: SAMPLES_PER_RANGE x RANGES_PER_SHARD x shards, at any input size).
    2. Rows and bytes of every range are counted over all rows. A range with more than RANGE_ROWS rows is divided
       into even parts of its hash interval; a part that is still overfull holds a hot text and is divided by
       a hash of the key.
    3. Running sums inside the ranges, on top of the sums of the ranges before, give each row's place in the bytes
       and so its shard; a group of equal texts of at most 1 / WHOLE_GROUP_SHARE of a shard goes by its middle
       and stays whole, a larger one is cut where the shard is full.
    4. The slot is the row's number in the whole order less the number at which its shard begins.

    Null text counts no bytes and has the checksum of the empty one. Null keys stand first in their group; rows
    with equal key and text get successive slots. Of kept columns, those named like the new ones are left out. An
    empty table gives an empty one.
    """
    keep = tuple(unclashing(list(keep), [key, *COLUMNS]))
    h = F.xxhash64(text)
    given = docs.select(F.col(key).alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"),
                        F.crc32(F.coalesce(text, F.lit(""))).alias("crc"), h.alias("h"),
                        *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)])
    given = given.withColumn("size", F.col("bytes") + 1)
    rows = written(given.select("key", "size", "crc", "h"), "sizes")
    total = rows.agg(F.sum("size")).first()[0] or 0
    rows_out = given.drop("bytes") if keep else rows

    ranges = shards * RANGES_PER_SHARD
    chance = F.lit(float(ranges * SAMPLES_PER_RANGE)) * F.col("size") / F.lit(float(max(total, 1)))
    drawn = rows.filter((F.pmod(F.xxhash64("h", "key", F.lit("draw")), F.lit(1 << 30)) / F.lit(float(1 << 30))) < chance)
    cuts = drawn.agg(F.percentile_approx("h", [i / ranges for i in range(1, ranges)], 10_000)).first()[0]
    cuts = sorted(set(cuts or []))
    ends = [-(1 << 63), *cuts, (1 << 63) - 1]

    at = _range_of(F.col("h"), cuts)
    counted = rows.select(at.alias("r")).groupBy("r").agg(F.count("*").alias("n")).collect()  # a row for each range
    parts = {x["r"]: -(-x["n"] // RANGE_ROWS) for x in counted if x["n"] > RANGE_ROWS}
    part = F.lit(0).cast("long")
    for r, k in parts.items():
        lo, wide = float(ends[r]), float(ends[r + 1]) - float(ends[r])
        part = F.when(F.col("r") == r, F.least(F.floor((F.col("h").cast("double") - lo) / wide * k), F.lit(k - 1))
                      .cast("long")).otherwise(part)
    place = lambda d: d.withColumn("r", at).withColumn("p", part)
    overfull = place(rows).groupBy("r", "p").agg(F.count("*").alias("n")).filter(F.col("n") > RANGE_ROWS) \
        .select("r", "p", F.ceil(F.col("n") / RANGE_ROWS).alias("pieces"))
    pieces = {(x["r"], x["p"]): x["pieces"] for x in overfull.collect()}  # fewer than rows / RANGE_ROWS
    piece = F.lit(0).cast("long")
    if pieces:
        table = F.create_map(*[y for (r, p), k in pieces.items() for y in (F.lit(f"{r}.{p}"), F.lit(k))])
        many = F.coalesce(F.get(F.map_values(F.map_filter(table, lambda a, b: a == F.concat_ws(".", "r", "p"))), F.lit(0)), F.lit(1))
        piece = F.pmod(F.xxhash64("key", F.lit("piece")), many)
    cells = ("r", "p", "q")
    place_all = lambda d: place(d).withColumn("q", piece)
    sums = place_all(rows).groupBy(*cells).agg(F.sum("size").alias("cell_size"), F.count("*").alias("cell_rows"))
    before = W.orderBy(*cells).rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*cells, F.coalesce(F.sum("cell_size").over(before), F.lit(0)).alias("size_before"),
                          F.coalesce(F.sum("cell_rows").over(before), F.lit(0)).alias("rows_before"))

    inner, group = W.partitionBy(*cells).orderBy("h", "key"), W.partitionBy(*cells, "h")
    own_before = F.coalesce(F.sum("size").over(inner.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = place_all(rows_out).join(offsets, list(cells)).withColumns({
        "start": F.col("size_before") + own_before, "rank": F.col("rows_before") + F.row_number().over(inner) - 1}) \
        .withColumns({"group_start": F.min("start").over(group), "group_size": F.sum("size").over(group)})
    whole = F.col("group_size") * (shards * WHOLE_GROUP_SHARE) <= F.lit(total)
    middle = F.when(whole, F.col("group_start") + F.col("group_size") / 2).otherwise(F.col("start") + F.col("size") / 2)
    ranked = ranked.withColumn("shard", F.least(F.floor(middle * shards / F.lit(float(max(total, 1)))), F.lit(shards - 1)).cast("int"))
    firsts = ranked.groupBy("shard").agg(F.min("rank").alias("first_rank"))
    return ranked.join(F.broadcast(firsts), "shard").select(  # at most `shards` rows
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("rank") - F.col("first_rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)])


def _range_of(h: Column, cuts: list[int]) -> Column:
    """Number of splitters at or below `h`, by nested comparisons."""
    def down(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(h < F.lit(cuts[mid]), down(lo, mid)).otherwise(down(mid + 1, hi))

    return down(0, len(cuts)).cast("int")
