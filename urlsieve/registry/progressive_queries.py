"""Pseudo-stream evaluation: split, batches, dictionary versions, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions.tokens import with_tokens
from ..operators import lexicon as L
from ..operators import metrics as MT
from ..plans import progressive as PR
from ..session import new_folder
from ..sources import readers as IO
from . import register, views
from .lexicon_queries import cut_sql, scored_sql
from .sqltext import add, query


BATCH_ROWS = 50  # rows of a batch at every data size
# Top tokens per scope and minimum document frequency of the versions.
TOP, MIN_DF = 50, 3

add("ord", """SELECT *, (count(*) OVER () * 200) // 1000 AS warmup_size, count(*) OVER () AS n_rows,
  row_number() OVER (ORDER BY order_key, row_id) AS rn FROM (
  SELECT row_id, url, type, md5(row_id || '|' || url || '#42') AS order_key FROM urls)""", "urls")
add("bat", f"""SELECT *, CASE WHEN rn <= warmup_size THEN 0 ELSE (rn - warmup_size - 1) // size + 1 END AS batch_idx,
  (n_rows - warmup_size - 1) // size + 1 AS n_batches, ((n_rows - warmup_size - 1) // size + 1) // 3 AS last_version
  FROM (SELECT *, {BATCH_ROWS} AS size FROM ord)""", "ord")
# A batch teaches version v when 3v - 5 <= batch <= 3v; the warm-up teaches all.
add("ver", """SELECT v AS version, row_id, type FROM bat, (SELECT unnest(range(0, (SELECT max(last_version) + 1 FROM bat))) AS v)
  WHERE batch_idx = 0 OR batch_idx BETWEEN 3 * v - 5 AND 3 * v""", "bat")
_c = lambda p: ", ".join(f"count_if(type = '{c}') AS {p}_{c}" for c in K.CLASSES)
add("vdf", f"SELECT version, token, count(*) AS total_df, {_c('df')} FROM ver JOIN tok_ids USING (row_id) GROUP BY ALL",
    "ver", "tok_ids")
add("vtot", f"SELECT version AS tversion, count(*) AS n, {_c('n')} FROM ver GROUP BY version", "ver")
add("vall", "SELECT * FROM vdf JOIN vtot ON version = tversion", "vdf", "vtot")
add("one", "SELECT 1")
add("dver", cut_sql(scored_sql("vall", "one", str(MIN_DF), "version,"), TOP, TOP, "version, "), "vall", "one")


def stream_rows(spark, sf):
    return PR.batched(PR.ordered(views.urls(spark, sf)), F.lit(BATCH_ROWS))


def stream_tokens(spark, sf):
    return with_tokens(stream_rows(spark, sf))


def versions(spark, sf):
    return PR.dictionary_versions(stream_tokens(spark, sf), TOP, TOP, MIN_DF)


@register("prog_split", query(
    """SELECT row_id, rn, rn <= warmup_size AS warmup, ('0x' || substr(order_key, 1, 8))::BIGINT % 1000 < 200 AS warmup_hash
       FROM ord""", "ord"))
def prog_split(spark, sf):
    return PR.ordered(views.urls(spark, sf)).select("row_id", "rn", "warmup", "warmup_hash")


@register("prog_batches", query("SELECT row_id, batch_idx, n_batches FROM bat", "bat"))
def prog_batches(spark, sf):
    return stream_rows(spark, sf).select("row_id", "batch_idx", "n_batches")


@register("dict_versions", query(
    "SELECT version, scope, token, round(score, 6) AS score, rank::INTEGER AS rank FROM dver", "dver"))
def dict_versions(spark, sf):
    """The versions as a user finds them: stored a folder a version, then read."""
    path = new_folder(spark, "versions")
    IO.write_dictionary(versions(spark, sf), path)
    return IO.read_dictionary(spark, path).select(
        F.col("version").cast("long").alias("version"), "scope", "token", F.round("score", 6).alias("score"), "rank")


@register("dict_asof", query(
    """SELECT batch_idx, version, count(*) AS tokens, round(sum(score), 6) AS total_score
       FROM (SELECT DISTINCT batch_idx, (batch_idx - 1) // 3 AS version FROM bat WHERE batch_idx > 0)
       JOIN dver USING (version) GROUP BY ALL""", "bat", "dver"))
def dict_asof(spark, sf):
    d = stream_rows(spark, sf).filter("batch_idx > 0").select("batch_idx").distinct()
    d = d.withColumn("version", PR.version_in_force(F.col("batch_idx")))
    sums = versions(spark, sf).groupBy("version").agg(F.count("*").alias("tokens"), F.sum("score").alias("s"))
    return d.join(sums, "version").select("batch_idx", "version", "tokens", F.round("s", 6).alias("total_score"))


_sample = lambda ch: (f"array_to_string(list_sort(list(token) FILTER (change = '{ch}'))[1:10], ',') AS sample_{ch}")


@register("dict_diff", query(
    f"""SELECT version, scope, count_if(change = 'added')::BIGINT AS added, count_if(change = 'removed')::BIGINT AS removed,
       count_if(change = 'kept')::BIGINT AS kept, coalesce({_sample('added').split(' AS ')[0]}, '') AS sample_added,
       coalesce({_sample('removed').split(' AS ')[0]}, '') AS sample_removed FROM (
       SELECT coalesce(o.version, n.version) AS version, coalesce(o.scope, n.scope) AS scope, coalesce(o.token, n.token) AS token,
         CASE WHEN o.token IS NULL THEN 'added' WHEN n.token IS NULL THEN 'removed' ELSE 'kept' END AS change
       FROM (SELECT version + 1 AS version, scope, token FROM dver WHERE version < (SELECT max(version) FROM dver)) o
       FULL JOIN (SELECT * FROM dver WHERE version > 0) n
         ON o.version = n.version AND o.scope = n.scope AND o.token = n.token) GROUP BY version, scope""", "dver"))
def dict_diff(spark, sf):
    return L.version_diffs(versions(spark, sf))


add("pred", """SELECT row_id, type, batch_idx, version,
  CASE WHEN common_count < 2 THEN 'benign'
       WHEN s_d = greatest(s_d, s_m, s_p) THEN 'defacement' WHEN s_m = greatest(s_d, s_m, s_p) THEN 'malware'
       ELSE 'phishing' END AS prediction
  FROM (SELECT row_id, type, batch_idx, b.version, count(score) FILTER (scope = 'common') AS common_count,
          coalesce(sum(score) FILTER (scope = 'defacement'), 0e0) AS s_d,
          coalesce(sum(score) FILTER (scope = 'malware'), 0e0) AS s_m,
          coalesce(sum(score) FILTER (scope = 'phishing'), 0e0) AS s_p
        FROM (SELECT *, (batch_idx - 1) // 3 AS version FROM bat WHERE batch_idx > 0) b
        JOIN tok_ids USING (row_id) LEFT JOIN dver d ON d.version = b.version AND d.token = tok_ids.token
        GROUP BY ALL)""", "bat", "tok_ids", "dver")
_GRID = f"(SELECT unnest([{', '.join(repr(c) for c in K.CLASSES)}]) AS type), (SELECT unnest([{', '.join(repr(c) for c in K.CLASSES)}]) AS prediction)"
add("cell", f"""SELECT batch_idx, version, type, prediction, coalesce(n, 0)::BIGINT AS n
  FROM (SELECT * FROM (SELECT DISTINCT batch_idx, version FROM pred), {_GRID})
  LEFT JOIN (SELECT batch_idx, type, prediction, count(*) AS n FROM pred GROUP BY ALL) USING (batch_idx, type, prediction)""",
    "pred")
add("ccell", """SELECT batch_idx, version, type, prediction, sum(n) OVER (PARTITION BY type, prediction ORDER BY batch_idx
  ROWS UNBOUNDED PRECEDING)::BIGINT AS n FROM cell""", "cell")


def _class_sql(src, by):
    """Per-class rows of cells."""
    keys = "".join(f"{b}, " for b in by)
    return f"""SELECT {keys}class, sum(tp)::BIGINT AS tp, sum(s)::BIGINT AS support, sum(p)::BIGINT AS predicted,
      CASE WHEN sum(p) = 0 THEN 0e0 ELSE sum(tp) / sum(p) END AS precision,
      CASE WHEN sum(s) = 0 THEN 0e0 ELSE sum(tp) / sum(s) END AS recall,
      CASE WHEN sum(p) + sum(s) = 0 THEN 0e0 ELSE 2e0 * sum(tp) / (sum(p) + sum(s)) END AS f1
      FROM (SELECT {keys}type AS class, CASE WHEN type = prediction THEN n ELSE 0 END AS tp, n AS s, 0 AS p FROM {src}
            UNION ALL SELECT {keys}prediction, 0, 0, n FROM {src}) GROUP BY {keys}class"""


def _summary_sql(cls, by):
    keys = "".join(f"{b}, " for b in by)
    agg = ["sum(support)::BIGINT AS rows", "sum(tp) / sum(support) AS accuracy"]
    for m in ("precision", "recall", "f1"):
        agg += [f"coalesce(avg({m}) FILTER (support + predicted > 0), 0e0) AS macro_{m}",
                f"sum({m} * support) / sum(support) AS weighted_{m}",
                f"max({m}) FILTER (class = 'phishing') AS phishing_{m}"]
    group = f" GROUP BY {', '.join(by)}" if by else ""
    return f"SELECT {keys}{', '.join(agg)} FROM ({cls}){group}"


_SUMMED = ["accuracy", "macro_f1", "weighted_f1", "phishing_precision", "phishing_recall", "phishing_f1"]
METRICS = ["accuracy"] + [f"{a}_{m}" for m in ("precision", "recall", "f1") for a in ("macro", "weighted", "phishing")]
_round = ", ".join(f"round({m}, 6) AS {m}" for m in METRICS)


def predictions(spark, sf):
    d = stream_tokens(spark, sf)
    v = PR.dictionary_versions(d, TOP, TOP, MIN_DF)
    return PR.scored_stream(d, v)


def _rounded(d, *keys):
    return d.select(*keys, "rows", *[F.round(m, 6).alias(m) for m in METRICS])


@register("prog_batch_metrics", query(
    f"SELECT batch_idx, version, rows, {_round} FROM ({_summary_sql(_class_sql('cell', ['batch_idx', 'version']), ['batch_idx', 'version'])})",
    "cell"))
def prog_batch_metrics(spark, sf):
    by = ["batch_idx", "version"]
    return _rounded(MT.summary(MT.per_class(MT.cells(predictions(spark, sf), by), by), by), *by)


@register("prog_cumulative", query(
    f"SELECT batch_idx, rows, {_round} FROM ({_summary_sql(_class_sql('ccell', ['batch_idx']), ['batch_idx'])})", "ccell"))
def prog_cumulative(spark, sf):
    running = MT.cumulative(MT.cells(predictions(spark, sf), ["batch_idx"]))
    return _rounded(MT.summary(MT.per_class(running, ["batch_idx"]), ["batch_idx"]), "batch_idx")


add("acell", "SELECT type, prediction, sum(n)::BIGINT AS n FROM cell GROUP BY ALL", "cell")


@register("eval_confusion", query("SELECT type, prediction, n FROM acell", "acell"))
def eval_confusion(spark, sf):
    return MT.cells(predictions(spark, sf))


@register("eval_metrics", query(f"SELECT rows, {_round} FROM ({_summary_sql(_class_sql('acell', []), [])})", "acell"))
def eval_metrics(spark, sf):
    return _rounded(MT.summary(MT.per_class(MT.cells(predictions(spark, sf)))))


_CLS = _class_sql("acell", [])
_rep = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support"


@register("eval_report", query(
    f"""SELECT label, {_rep} FROM (SELECT class AS label, precision, recall, f1, support FROM ({_CLS})
      UNION ALL SELECT 'accuracy', accuracy, accuracy, accuracy, rows FROM ({_summary_sql(_CLS, [])})
      UNION ALL SELECT 'macro avg', macro_precision, macro_recall, macro_f1, rows FROM ({_summary_sql(_CLS, [])})
      UNION ALL SELECT 'weighted avg', weighted_precision, weighted_recall, weighted_f1, rows FROM ({_summary_sql(_CLS, [])}))""",
    "acell"))
def eval_report(spark, sf):
    d = MT.report(MT.per_class(MT.cells(predictions(spark, sf))))
    return d.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@register("run_summary", query(
    f"""SELECT warmup_size::BIGINT AS warmup_size, (n_rows - warmup_size)::BIGINT AS progressive_stream_size,
       n_batches::BIGINT AS batches, 2e-1 AS warmup_ratio, 3::BIGINT AS update_interval, 6::BIGINT AS sliding_window_batches,
       {', '.join(f'round({m}, 6) AS cumulative_{m}' for m in _SUMMED)},
       (SELECT sum(n) FROM acell WHERE type = 'benign' AND prediction = 'phishing')::BIGINT AS benign_to_phishing,
       (SELECT sum(n) FROM acell WHERE type = 'phishing' AND prediction = 'benign')::BIGINT AS phishing_to_benign
       FROM (SELECT DISTINCT warmup_size, n_rows, n_batches FROM bat), ({_summary_sql(_CLS, [])})""", "acell", "bat"))
def run_summary(spark, sf):
    """Summary of the run, written as JSON and read back."""
    path = new_folder(spark, "summary")
    sizes = stream_rows(spark, sf).groupBy("batch_idx").agg(F.count("*").alias("n"))
    IO.write_summary(PR.run_summary(MT.cells(predictions(spark, sf)), sizes), path)
    d = spark.read.json(path)
    return d.withColumns({f"cumulative_{m}": F.round(f"cumulative_{m}", 6) for m in _SUMMED})
