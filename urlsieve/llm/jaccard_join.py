"""N-gram Jaccard join: classes of equal shingle sets, their links, and the components these form."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import broadcast_counted, text_buffers
from .components import components
from .shingles import mix, shingle_sets
from .tsearch import block_links

CELL_BITS = 20  # cells of the shingle frequency sketch: a few MB, whatever the size of the corpus
SLICES = 64
BLOCK_SHINGLES = 500_000  # aim for the shingles in one block of sets
LINKS = "a long, b long"
SPARE = 32  # a prefix is longer by n / SPARE shingles, and linked sets then share as many more of them


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3, percent: int = 90) -> DataFrame:
    """For every row of `docs`: key, n_shingles (set size), class_id, component_id (smallest key of its component),
    text_hash, and keeper: whether the row is the one its component would keep (smallest key, then text hash).

    Two rows link when 100 * |A & B| >= percent * |A or B| of their sets of `k`-word shingles. The join is exact:

    1. Equal sets form a class, and only one row of a class goes on.
    2. A sketch of all shingles gives one order, frequent ones last. Linked sets share a shingle among the first
       n - ceil(percent * n / 100) + 1 of each (the prefix), and one more for each shingle that the prefix is longer.
    3. Classes with the same smallest hash are searched in blocks first (`tsearch.block_links`). A block that
       would be too large is divided, and each part gets the class that stands first, so near copies by the
       thousand still meet in one component.
    4. Only prefix shingles whose classes are not yet in one component remain, and only classes with as many of
       them as a partner needs. Classes outside a shingle's most common component visit the other blocks that
       hold it, if these hold enough of them, and are searched there in the same way; blocks are formed anew so
       that the holders of a shingle are in few of them.

    No pair within a group is written: a block returns a link only where two components become one.

    Texts are read whole. Null or empty text and text without words: size 0, no class, linked with nothing, so
    component_id is the row's own key. Shorter texts are one shingle. Rows with a null key take part; a component
    of such rows alone has a null id. Repeated rows give repeated results. Other columns of `docs` are not looked
    at. Shingles, and classes of equal sets, are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    sketch = spark.sparkContext.broadcast(_sketch(source, k))
    signed = written(source.mapInArrow(_signer(k, percent, sketch), "key " + source.schema["key"].dataType.simpleString()
                     + ", text_hash long, n long, class_id long, anchor long, prefix array<long>"), "sets")
    named = signed.filter("class_id is not null")
    classes = written(named.groupBy("class_id").agg(
        F.min("key").alias("least"), F.min(_rank()).alias("row"), F.first("n").alias("n"),
        F.first("anchor").alias("anchor"), F.first("prefix").alias("prefix")), "classes")

    total = classes.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_SHINGLES))
    groups = classes.groupBy("anchor").agg(F.count("*").alias("members"), F.sum("n").alias("weight"),
                                           F.min("class_id").alias("first")).filter("members > 1") \
        .withColumn("parts", F.ceil(F.col("weight") / BLOCK_SHINGLES))
    placed = written(classes.join(groups, "anchor", "left").select(
        "class_id", "n", "row", "first", "parts",
        F.xxhash64(F.pmod("anchor", F.lit(blocks)), F.when(F.col("parts") > 1, F.col("anchor")),
                   F.when(F.col("parts") > 1, F.pmod(F.xxhash64("class_id"), F.col("parts")))).alias("block"),
        F.when((F.col("parts") > 1) & (F.col("class_id") == F.col("first")), F.transform(
            F.sequence(F.lit(0).cast("long"), F.col("parts") - 1),
            lambda p: F.xxhash64(F.pmod("anchor", F.lit(blocks)), F.col("anchor"), p))).alias("everywhere")), "placed")
    own = F.array(F.struct(F.col("block").alias("block"), F.lit(False).alias("visitor")))
    near = placed.filter("first is not null").select(
        "class_id", "row", F.col("class_id").alias("label"),
        F.when(F.col("everywhere").isNotNull(), F.array_distinct(F.concat(own, F.transform(
            "everywhere", lambda b: F.struct(b.alias("block"), F.lit(False).alias("visitor")))))).otherwise(own).alias("goes"))
    first_links = _search(source, near, k, percent)
    known = components(first_links)

    labelled = written(placed.join(known.withColumnRenamed("node", "class_id"), "class_id", "left").select(
        "class_id", "n", "block", "row", F.coalesce("root", "class_id").alias("label")), "labelled")
    second_links = _search(source, _visits(labelled, classes.select("class_id", "prefix"), percent), k, percent)
    joined = components(second_links).withColumnRenamed("node", "label")  # these links are between labels

    ids = classes.select("class_id", "least", "row").join(labelled.select("class_id", "label"), "class_id") \
        .join(joined, "label", "left").withColumn("root", F.coalesce("root", "label"))
    least = ids.groupBy("root").agg(F.min("least").alias("component_id"), F.min("row").alias("kept"))
    ids = ids.join(least, "root").select("class_id", "component_id", "kept")
    return signed.join(ids, "class_id", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), "class_id",
        F.when(F.col("class_id").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"),
        "text_hash", (F.col("class_id").isNull() | F.col("kept").eqNullSafe(_rank())).alias("keeper"))


def _rank():
    """Order in which rows would be kept: by key, null last, then by text."""
    return F.struct(F.col("key").isNull().alias("missing"), "key", "text_hash")


def _visits(labelled: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """Where classes must still be searched: class_id, row, label, goes (blocks, and whether only as a visitor).

    A partner of a set of n has percent * n / 100 shingles or more, so both prefixes together hold at least
    `least` shared ones. For each of those, one of the two is outside the common component and visits the
    other's block; so one of the two visits for half of them or more. All prefix shingles move with their class
    alone; what is known of the class is joined to those that stay.
    """
    facts = labelled.select("class_id", "n", (1 + F.floor(F.ceil(F.col("n") * percent / 100) / SPARE)).alias("least"),
                            "block", "label")
    left = labelled.select("class_id", "label").join(prefixes, "class_id") \
        .select("class_id", "label", F.explode_outer("prefix").alias("token")).filter("token is not null")
    for _ in range(2):  # without the classes that drop out, more shingles stand in one component only
        mixed = left.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")) \
            .filter("lo <> hi").select("token")
        left = written(left.select("class_id", "token").join(mixed, "token"), "posts")
        enough = left.groupBy("class_id").agg(F.count("*").alias("has")).join(facts, "class_id") \
            .filter("has >= least").drop("has")
        left = left.join(enough, "class_id")
    left = _rehoused(written(left, "posts"))
    common, held = _holders(left)
    fits = lambda low, high: f"100 * p.n >= {percent} * h.{low} and 100 * h.{high} >= {percent} * p.n"
    visits = left.join(common, "token").filter("label <> common").alias("p").join(held.alias("h"), F.expr(
        f"p.token = h.token and (p.block > h.block and (h.lo <> p.label or h.hi <> p.label) and {fits('low', 'high')} "
        f"or p.block <> h.block and {fits('common_low', 'common_high')})")) \
        .groupBy("p.class_id", F.col("h.block").alias("to")) \
        .agg(F.count_distinct("p.token").alias("shared"), F.first("p.least").alias("needs")) \
        .filter("2 * shared >= needs") \
        .select("class_id", F.struct(F.col("to").alias("block"), F.lit(True).alias("visitor")).alias("go"))
    homes = left.select("class_id", F.struct("block", F.lit(False).alias("visitor")).alias("go"))
    goes = homes.unionByName(visits).groupBy("class_id").agg(F.collect_set("go").alias("goes"))
    return labelled.select("class_id", "row", "label").join(goes, "class_id")


def _holders(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(token, common) with the label that most rows of a shingle have, and one row a shingle and block, whatever the
    number of components that hold it there: token, block, least and greatest label, the sizes of all its holders,
    and those of the common label's (null: it is not there)."""
    held = left.groupBy("token", "label", "block").agg(F.count("*").alias("rows"), F.min("n").alias("low"),
                                                       F.max("n").alias("high"))
    common = held.groupBy("token", "label").agg(F.sum("rows").alias("rows")) \
        .groupBy("token").agg(F.max_by("label", F.struct("rows", "label")).alias("common"))
    is_common = F.col("label") == F.col("common")
    return common, held.join(common, "token").groupBy("token", "block").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.min(F.when(is_common, F.col("low"))).alias("common_low"), F.max(F.when(is_common, F.col("high"))).alias("common_high"))


def _rehoused(left: DataFrame) -> DataFrame:
    """`left` with new blocks: classes live with those that share the commonest of their remaining shingles, so that
    the holders of a shingle stand in few blocks. An overfull home is divided."""
    common = left.groupBy("token").agg(F.count("*").alias("df"))
    homes = left.join(common, "token").groupBy("class_id").agg(
        F.max_by("token", F.struct("df", "token")).alias("home"), F.first("n").alias("size"))
    weights = homes.groupBy("home").agg(F.sum("size").alias("weight")) \
        .withColumn("parts", F.ceil(F.col("weight") / BLOCK_SHINGLES))
    total = homes.agg(F.sum("size")).first()[0] or 0
    block = F.xxhash64(F.pmod(F.xxhash64("home"), F.lit(max(1, -(-total // BLOCK_SHINGLES)))),
                       F.when(F.col("parts") > 1, F.col("home")),
                       F.when(F.col("parts") > 1, F.pmod(F.xxhash64("class_id"), F.col("parts"))))
    placed = homes.join(weights, "home").select("class_id", block.alias("block"))
    return written(left.drop("block").join(placed, "class_id"), "housed")


def _search(source: DataFrame, wanted: DataFrame, k: int, percent: int) -> DataFrame:
    """Links found when each wanted class goes to its blocks."""
    wanted = written(wanted, "wanted")
    rows = wanted.count()
    w = broadcast_counted(wanted.select("class_id", "label", "goes", F.col("row.key").alias("w_key"),
                                        F.col("row.text_hash").alias("w_hash")), rows)
    texts = source.join(w, (F.col("text_hash") == F.col("w_hash")) & F.col("key").eqNullSafe(F.col("w_key"))) \
        .select("class_id", "label", "goes", "text")
    sets = texts.mapInArrow(_setter(k), "class_id long, label long, block long, visitor boolean, tokens binary")
    return written(sets.groupBy("block").applyInArrow(_block_search(percent), LINKS), "found")


def _setter(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            goes = batch.column("goes").to_pylist()
            ids, labels = batch.column("class_id").to_pylist(), batch.column("label").to_pylist()
            out, held = [], 0
            for i, tokens in enumerate(shingle_sets(data, offsets, k)):
                packed = tokens.tobytes()
                for go in goes[i]:
                    out.append((ids[i], labels[i], go["block"], go["visitor"], packed))
                    held += len(packed)
                if held > 1 << 24:
                    yield _rows(out)
                    out, held = [], 0
            if out:
                yield _rows(out)

    def _rows(out):
        c = list(zip(*out))
        return pa.RecordBatch.from_arrays(
            [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()),
             pa.array(c[3], pa.bool_()), pa.array(c[4], pa.binary())], ["class_id", "label", "block", "visitor", "tokens"])

    return run


def _block_search(percent: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, labels = table.column("class_id").to_pylist(), table.column("label").to_pylist()
        seen: dict[int, int] = {}
        visitor = table.column("visitor").to_pylist()
        for i, x in enumerate(ids):  # a repeated row, or a visitor that lives here
            if x not in seen or visitor[seen[x]] and not visitor[i]:
                seen[x] = i
        keep = list(seen.values())
        tokens = table.column("tokens")
        links = block_links([np.frombuffer(tokens[i].as_buffer(), np.uint64) for i in keep], [labels[i] for i in keep],
                            [visitor[i] for i in keep], percent)
        pairs = [(labels[keep[i]], labels[keep[j]]) for i, j in links]
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    return run


def _signer(k: int, percent: int, sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = sketch.value.astype(np.uint64)
        mask = np.uint64(len(rank) - 1)
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            n, class_id, anchor, prefix = [], [], [], []
            for s in shingle_sets(data, offsets, k):
                n.append(len(s))
                if not len(s):
                    class_id.append(None), anchor.append(None), prefix.append(None)
                    continue
                digest = hashlib.blake2b(s.tobytes(), digest_size=8).digest()
                class_id.append(int.from_bytes(digest, "little", signed=True))
                anchor.append(int(mix(s[:1]).view(np.int64)[0]))
                order = np.argsort((rank[s & mask] << np.uint64(48)) | (s >> np.uint64(16)), kind="stable")
                prefix.append(s[order[:len(s) - -(-percent * len(s) // 100) + 1 + len(s) // SPARE]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(class_id, pa.int64()),
                 pa.array(anchor, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))],
                ["key", "text_hash", "n", "class_id", "anchor", "prefix"])

    return run


def _sketch(source: DataFrame, k: int) -> np.ndarray:
    """How often shingles of each hash cell occur in the whole corpus, as ranks of 16 bits on a logarithmic scale."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            held, size = [], 0
            for s in shingle_sets(data, offsets, k):
                held.append(s)
                size += len(s)
                if size > 1 << 18:
                    cells += np.bincount(np.concatenate(held) & np.uint64(len(cells) - 1), minlength=len(cells))
                    held, size = [], 0
            if held:
                cells += np.bincount(np.concatenate(held) & np.uint64(len(cells) - 1), minlength=len(cells))
        parts = cells.reshape(SLICES, -1)
        task = int(cells[:997].sum()) & 63
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(SLICES), pa.int32()), pa.array([task] * SLICES, pa.int32()),
             pa.array([p.astype(np.int64).tobytes() for p in parts], pa.binary())], ["slice", "part", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        counts = np.zeros((1 << CELL_BITS) // SLICES, np.int64)
        for batch in batches:
            for x in batch.column("counts"):
                counts += np.frombuffer(x.as_buffer(), np.int64)
        return counts

    def one(key: tuple, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()),
                                          pa.array([counts.tobytes()], pa.binary())], ["slice", "part", "counts"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from one(key, total(batches))

    def rank(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from one(key, (total(batches).astype(np.float32).view(np.uint32) >> np.uint32(15)).astype(np.uint16))

    schema = "slice int, part int, counts binary"
    ranks = source.select("text").mapInArrow(count, schema).groupBy("slice", "part").applyInArrow(add, schema) \
        .withColumn("part", F.lit(0)).groupBy("slice", "part").applyInArrow(rank, schema).collect()
    cells = np.zeros((SLICES, (1 << CELL_BITS) // SLICES), np.uint16)
    for row in ranks:
        cells[row["slice"]] = np.frombuffer(row["counts"], np.uint16)
    return cells.reshape(-1)
