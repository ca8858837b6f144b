"""Registered queries of the operators; each returns one row per document unless its name says otherwise."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import alignment as G
from . import curriculum as C
from . import images as I
from . import jaccard_join as J
from . import language as L
from . import lsh_forest as D
from . import periodic as R
from . import secrets as X
from . import sharding as S
from . import token_counts as K
from . import token_files as T
from . import tool_calls as H
from . import winnowing as N
from ..session import new_folder
from .common import table

QUERIES = {}
ORACLES: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op5_jaccard_join(spark, sf_dir):
    return J.jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register
def op9_winnowing(spark, sf_dir):
    return N.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"),
                           table(spark, sf_dir, "benchmark").select("item_id", "text")).drop("text_hash")


@register
def op8_sampled_splitters(spark, sf_dir):
    return S.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register
def op6_curriculum(spark, sf_dir):
    mixed = C.curriculum(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    steps = C.training_steps(mixed, int(spark.conf.get("spark.sql.shuffle.partitions")), ("source", "doc_id", "text_hash"))
    return steps.select("doc_id", "size", "source_size", "target", "taken", "source", "passes", "first_position", "first_step")


@register
def op1_cross_parsing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = L.fit(docs.filter(~L.held_out(F.col("doc_id"))))
    return L.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", L.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@register
def op3_bit_planes(spark, sf_dir):
    import public_tokenizers

    folder = new_folder(spark, "ids")
    files = T.write_token_files(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                public_tokenizers.path("word_bpe_49k.json"), folder, end_id=1)
    return T.read_token_files(spark, files, folder)


@register
def op10_zstd_novelty(spark, sf_dir):
    return X.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@register
def op2_offset_attribution(spark, sf_dir):
    import public_tokenizers as P

    return K.count_by_section(table(spark, sf_dir, "documents").select("doc_id", "text"),
                              P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@register
def op7_tool_calls(spark, sf_dir):
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    linked = H.link(H.derived_calls(chats).unionByName(H.written_calls(chats)),
                    H.derived_results(chats).unionByName(H.written_results(chats)))
    return H.in_order(linked, int(spark.conf.get("spark.sql.shuffle.partitions")))


@register
def op4_image_copies(spark, sf_dir):
    return I.find_copies(table(spark, sf_dir, "pages").select("page_id", "html"))


def with_planted_period(docs):
    """`docs` where one document in ten, by the checksum of its id, has the rest of its words from some position on
    replaced by a repeated stretch; such a text is its words joined by a space."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size("words")
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    cut = docs.withColumn("words", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))) \
        .withColumn("a", F.when(n > 0, a)).withColumn("p", F.when(n > 0, p))
    repeated = F.transform(F.sequence("a", n - 1), lambda i: F.get("words", F.col("a") + (i - F.col("a")) % F.col("p")))
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), repeated), " ")
    return cut.withColumn("text", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text"))).drop("words", "a", "p")


@register
def op11_periodic_runs(spark, sf_dir):
    found = R.periodic_runs(with_planted_period(table(spark, sf_dir, "documents").select("doc_id", "text")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    best = found.withColumn("best", R.best_run(F.col("runs")))
    return best.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                       F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
                       F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@register
def op12_token_alignment(spark, sf_dir):
    import public_tokenizers as P

    aligned = G.alignments(table(spark, sf_dir, "documents").select("doc_id", "text"),
                           P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return G.with_link_counts(aligned.withColumn("groups_sha256", digest).drop("groups")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@register
def op13_lsh_forest(spark, sf_dir):
    return D.forest_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("class_id")
