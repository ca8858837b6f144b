"""Near duplicates by an LSH forest: several sorted orders of minhash signatures propose, full shingle sets decide."""

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

TREES = 20
DEPTH = 12  # minhash values of a tree; two bytes each in its order
ROUNDS = (2, 18)  # trees of each round of neighbours
DEPTHS = (4, 6, 8, 12)  # how much of an order a region shares; a crowded region is taken apart by the next
CROWDED = 64  # classes of a region outside its commonest component
BLOCK_SHINGLES = 500_000  # aim for the shingles that are compared in one block
LINKS = "a long, b long"


def forest_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 85) -> DataFrame:
    """For every row of `docs`: key, n_shingles (set size), class_id, component_id (smallest key of its component),
    and kept: whether the row's key is that one.

    Two rows link when 100 * |A & B| >= percent * |A or B| of their sets of `k`-word shingles.

    1. Equal sets form a class, and one row of a class goes on, with TREES signatures of DEPTH minhash values.
    2. Classes that share the first DEPTHS[0] values of no tree with another are done. Each tree sorts the rest by its signature, the orders range-partitioned over the cluster. Neighbours that
       share the first DEPTHS[0] values and are not in one component yet are compared on their full sets, in blocks of
       successive neighbours. This runs in rounds of trees, so a group of near copies by the thousand is one component
       after the first, and only its strays and their neighbours go on.
    3. A region holds all classes that share the first values of a tree. Where it still holds several components,
       each class outside the commonest visits the blocks where the others live, and is compared with them in full.
       A region with more than CROWDED such classes goes by longer signatures first, at the last all of them.

    Links are confirmed on full sets, so none is false. A linked pair is missed only where no tree puts both into one
    region: for similarity 0.85 and regions of four values less than once in a million pairs, of six (crowded regions)
    3 in 10,000; members of a group have many such pairs.

    Texts are read whole. Null or empty text and text without words: size 0, no class, linked with nothing, so
    component_id is the row's own key and kept is true. Shorter texts are one shingle. Rows with a null key take part
    and are kept when they are in no component with a key (component_id null). Repeated rows give repeated results.
    Other columns of `docs` are not looked at. Shingles and classes of equal sets are told apart by 64-bit hashes.
    """
    source = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    signed = written(source.mapInArrow(_signer(k), f"key {source.schema['key'].dataType.simpleString()}, text_hash long, "
                                                   "n long, class_id long, forest binary"), "signed")
    named = signed.filter("class_id is not null")
    classes = written(named.groupBy("class_id").agg(
        F.min("key").alias("least"), F.min(F.struct(F.col("key").isNull(), "key", "text_hash")).alias("row"),
        F.first("n").alias("n"), F.first("forest").alias("forest")), "classes")
    posts = written(_crowd(classes.select("class_id", "n", "forest", F.col("class_id").alias("label"))), "posts")
    named = written(classes.join(posts.select("class_id"), "class_id", "left_semi").select(
        "class_id", F.col("row.key").alias("w_key"), F.col("row.text_hash").alias("w_hash")), "rows")
    texts = written(source.join(broadcast_counted(named, named.count()), (F.col("text_hash") == F.col("w_hash")) & F.col(
        "key").eqNullSafe(F.col("w_key"))).select("class_id", "text"), "texts")
    links, first, labelled = None, 0, posts
    for number in ROUNDS:
        found = _compared(texts, _neighbours(labelled, first, first + number), k, percent)
        links = found if links is None else links.unionByName(found)
        first += number
        roots = written(components(links), "roots").withColumnRenamed("node", "class_id")
        labelled = posts.drop("label").join(roots, "class_id", "left").withColumn("label", F.coalesce("root", "class_id")).drop("root")
    posts = labelled
    links = links.unionByName(_compared(texts, _visits(posts, percent), k, percent))
    ids = classes.select("class_id", "least").join(components(links).withColumnRenamed("node", "class_id"), "class_id", "left") \
        .withColumn("root", F.coalesce("root", "class_id"))
    least = ids.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = ids.join(least, "root").select("class_id", "component_id")
    own = F.when(F.col("class_id").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return signed.join(ids, "class_id", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), "class_id", own.alias("component_id"),
        F.col("key").eqNullSafe(own).alias("kept"))


def _trees(posts: DataFrame, first: int, last: int) -> DataFrame:
    """class_id, n, label, tree, signature (bytes in sorting order) for the trees from `first` to before `last`."""
    tree = F.explode(F.sequence(F.lit(first), F.lit(last - 1))).alias("tree")
    return posts.select("class_id", "n", "label", "forest", tree).withColumn(
        "signature", F.substring("forest", F.col("tree") * (2 * DEPTH) + 1, F.lit(2 * DEPTH))).drop("forest")


def _crowd(posts: DataFrame) -> DataFrame:
    """The classes that share a region with another class."""
    regions = _trees(posts, 0, TREES).select("class_id", _region(DEPTHS[0]))
    shared = written(regions.groupBy("region").agg(F.count("*").alias("classes")).filter("classes > 1").select("region"), "shared")
    some = regions.join(broadcast_counted(shared, shared.count()), "region", "left_semi").select("class_id").distinct()
    return posts.join(some, "class_id", "left_semi")


def _region(depth: int):
    return F.xxhash64("tree", F.substring("signature", 1, 2 * depth)).alias("region")


def _neighbours(posts: DataFrame, first: int, last: int) -> DataFrame:
    """Blocks to compare: class_id, label, block, visitor. In the sorted order of each tree, successive classes
    that share the first DEPTHS[0] values and have different labels stand in one block; a chain of them is cut by
    size, and the class at the cut stands on both sides. Classes that no neighbour calls for stay out.

    The order is cut into partitions by samples of (tree, signature, class), so equal signatures by the million are
    several partitions. The two classes at such a cut are left to the other trees and to the regions.
    """
    parts = int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = _trees(posts, first, last).repartitionByRange(parts, "tree", "signature", "class_id") \
        .sortWithinPartitions("tree", "signature", "class_id")
    shared = 2 * DEPTHS[0]

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        before, held, block = None, 0, 0  # the class before this one, size and number of the open block
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("tree", "signature", "class_id", "label", "n"))
            for tree, signature, class_id, label, n in zip(*columns):
                now = (tree, signature[:shared], class_id, label, n)
                if before is not None and now[:2] == before[:2] and label != before[3]:
                    if held == 0 or held + n > BLOCK_SHINGLES:
                        block, held = block + 1, before[4]
                        out.append((*before[2:4], part << 32 | block))
                    out.append((class_id, label, part << 32 | block))
                    held += n
                else:
                    held = 0
                before = now
            if out:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*out)), pa.array([False] * len(out))],
                                                 ["class_id", "label", "block", "visitor"])

    return order.mapInArrow(chains, "class_id long, label long, block long, visitor boolean")


def _visits(posts: DataFrame, percent: int) -> DataFrame:
    """Blocks to compare: class_id, label, block, visitor, for the regions that hold several components."""
    todo, taken = _trees(posts, 0, TREES), None
    for depth in DEPTHS:
        regions = todo.select("*", _region(depth))
        held = regions.groupBy("region", "label").agg(F.count("*").alias("classes")).groupBy("region").agg(
            F.sum("classes").alias("classes"), F.max_by("label", F.struct("classes", "label")).alias("common"),
            F.max("classes").alias("most")).filter("classes > most")
        crowded = F.col("classes") - F.col("most") > CROWDED
        left = written(regions.join(held, "region").select(
            "class_id", "label", "n", "tree", "signature", "region", "common",
            (crowded & F.lit(depth != DEPTHS[-1])).alias("crowded")), "regions")
        some = left.filter("not crowded").select("class_id", "label", "n", "region", "common")
        taken = some if taken is None else taken.unionByName(some)
        todo = left.filter("crowded").select("class_id", "label", "n", "tree", "signature")
    taken = written(taken, "taken")

    sizes = taken.groupBy("region").agg(F.count("*").alias("holders"))
    homes = taken.join(sizes, "region").groupBy("class_id").agg(
        F.max_by("region", F.struct("holders", "region")).alias("home"), F.first("n").alias("n"))
    weights = homes.groupBy("home").agg(F.sum("n").alias("weight")).withColumn("parts", F.ceil(F.col("weight") / BLOCK_SHINGLES))
    placed = written(homes.join(weights, "home").select("class_id", F.xxhash64("home", F.pmod(
        F.xxhash64("class_id"), F.col("parts"))).alias("block")), "placed")
    taken = taken.join(placed, "class_id")
    living = taken.groupBy("region", "block").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.min("label").alias("lo"), F.max("label").alias("hi"),
        F.max(F.col("label") == F.col("common")).alias("commonest"))
    strays = taken.filter("label <> common")
    # of two strays one visits the other; the commonest component is only visited
    visits = strays.alias("s").join(living.alias("h"), F.expr(
        f"s.region = h.region and s.block <> h.block and (s.block > h.block or h.commonest) and (h.lo <> s.label or h.hi <> s.label) "
        f"and 100 * s.n >= {percent} * h.low and 100 * h.high >= {percent} * s.n")) \
        .select("s.class_id", F.col("h.block").alias("block"), F.lit(True).alias("visitor")).distinct()
    # of the rest only blocks where something can be compared
    here = taken.groupBy("block").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("block")
    needed = here.unionByName(visits.select("block")).distinct()
    goes = visits.unionByName(placed.join(needed, "block").select("class_id", "block", F.lit(False).alias("visitor")))
    return goes.join(posts.select("class_id", "label"), "class_id").select("class_id", "label", "block", "visitor")


def _compared(texts: DataFrame, wanted: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between labels found in the blocks of `wanted`, on full shingle sets."""
    goes = written(wanted.groupBy("class_id", "label").agg(F.collect_set(F.struct("block", "visitor")).alias("goes")), "goes")
    texts = texts.join(goes, "class_id").select("class_id", "label", "goes", "text")
    sets = texts.mapInArrow(_sets(k), "class_id long, label long, block long, visitor boolean, tokens binary")
    return written(sets.groupBy("block").applyInArrow(_block_search(percent), LINKS), "found")


def _sets(k: int):
    """A row for each block a text goes to, with its shingles."""
    names = ["class_id", "label", "block", "visitor", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            goes, rows, held = batch.column("goes"), [], 0
            ids = zip(batch.column("class_id").to_pylist(), batch.column("label").to_pylist())
            for i, ((class_id, label), tokens) in enumerate(zip(ids, shingle_sets(*text_buffers(batch.column("text")), k))):
                packed = tokens.tobytes()
                for go in goes[i].as_py():
                    rows.append((class_id, label, go["block"], go["visitor"], packed))
                    held += len(packed)
                    if held > 1 << 24:
                        yield _batch(rows)
                        rows, held = [], 0
            if rows:
                yield _batch(rows)

    def _batch(rows):
        types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return run


def _block_search(percent: int):
    """Links of one block; a class that stands there twice (a repeated row) counts once, living there rather than visiting."""
    def run(block: pa.Table) -> pa.Table:
        ids, visitor = block.column("class_id").to_pylist(), block.column("visitor").to_pylist()
        at = list({ids[i]: i for i in sorted(range(len(ids)), key=lambda i: not visitor[i])}.values())
        tokens, labels = block.column("tokens"), block.column("label").to_pylist()
        found = block_links([np.frombuffer(tokens[i].as_py(), np.uint64) for i in at], [labels[i] for i in at],
                            [visitor[i] for i in at], percent)
        return pa.table([pa.array([labels[at[x[e]]] for x in found], pa.int64()) for e in (0, 1)], names=["a", "b"])

    return run


def signatures(shingles: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> bytes:
    """Minhash values of a set of 64-bit shingles, one for each factor: 16 bits each, the high byte first."""
    x = mix(shingles).astype(np.uint32)
    least = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        part = x[i:i + 1024, None] * factors + shifts
        np.minimum(least, part.min(axis=0), out=least)
    return (mix(least.astype(np.uint64)) >> np.uint64(48)).astype(">u2").tobytes()


def _signer(k: int):
    rng = np.random.default_rng(13)
    factors = rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1)
    shifts = rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids, forest = [], [], []
            for s in shingle_sets(*text_buffers(batch.column("text")), k):
                n.append(len(s))
                whole = hashlib.blake2b(s.tobytes(), digest_size=8).digest()
                ids.append(int.from_bytes(whole, "little", signed=True) if len(s) else None)
                forest.append(signatures(s, factors, shifts) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(ids, pa.int64()),
                 pa.array(forest, pa.binary())], ["key", "text_hash", "n", "class_id", "forest"])

    return run
