"""Streams give what the batch operators give."""

import random

import numpy as np
from pyspark.sql import functions as F

from urlsieve import constants as K
from urlsieve.functions.tokens import with_tokens
from urlsieve.operators import features as FE
from urlsieve.operators import metrics as MT
from urlsieve.operators import model as M
from urlsieve.operators import ratelimit as R
from urlsieve.plans import progressive as PR
from urlsieve.plans.scoring import decide_urls
from urlsieve.registry import views
from urlsieve.streaming import rates, scoring
from urlsieve.streaming.progressive import Progressive, running_cells

TOP, MIN_DF = 50, 3


def batches(spark, sf, tmp_path):
    """The pseudo-stream as one file per batch, in order, and all its rows."""
    rows = PR.batched(PR.ordered(views.urls(spark, sf)), 20).select("row_id", "url", "type", "batch_idx", "n_batches")
    rows = rows.persist()
    folder = str(tmp_path / "stream")
    last = rows.first().n_batches
    for b in range(1, last + 1):
        rows.filter(F.col("batch_idx") == b).select("row_id", "url", "type").coalesce(1).write.mode("append").parquet(folder)
    return rows, folder, last


def source(spark, folder):
    return (spark.readStream.schema("row_id long, url string, type string").option("maxFilesPerTrigger", 1).parquet(folder))


def table(d):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect())


def test_progressive_run_equals_batch(spark, sf, tmp_path):
    rows, folder, last = batches(spark, sf, tmp_path)
    run = Progressive(str(tmp_path / "state"), TOP, TOP, MIN_DF)
    run.warm_up(rows.filter("batch_idx = 0").select("row_id", "url", "type"))
    run.start(source(spark, folder), str(tmp_path / "check")).awaitTermination()

    tokens = with_tokens(rows)
    versions = PR.dictionary_versions(tokens, TOP, TOP, MIN_DF)
    cols = [F.col("version").cast("int").alias("version"), "scope", "token", F.round("score", 9).alias("score")]
    stored = spark.read.parquet(run._table("dictionary"))
    assert table(stored.select(*cols)) == table(versions.select(*cols))

    predicted = PR.scored_stream(tokens, versions)
    by = ["batch_idx"]
    want = MT.summary(MT.per_class(MT.cells(predicted, by), by), by)
    got = spark.read.parquet(run._table("metrics"))
    names = ["rows", "accuracy", "macro_f1", "weighted_f1", "phishing_f1"]
    assert table(got.select("batch_id", *names)) == table(want.select("batch_idx", *names))
    running = MT.summary(MT.per_class(MT.cumulative(MT.cells(predicted, by)), by), by)
    assert table(run.cumulative(spark).select("batch_id", *names)) == table(running.select("batch_idx", *names))

    # A replay of the last batch changes nothing.
    before = table(spark.read.parquet(run._table("predictions")))
    run.step(rows.filter(F.col("batch_idx") == last).select("row_id", "url", "type"), last - 1)
    assert table(spark.read.parquet(run._table("predictions"))) == before


def test_progressive_linear_model_learns(spark, sf, tmp_path):
    rows, _, _ = batches(spark, sf, tmp_path)
    run = Progressive(str(tmp_path / "state"), TOP, TOP, MIN_DF, linear_model=True)
    run.warm_up(rows.filter("batch_idx = 0").select("row_id", "url", "type"))
    for b in (1, 2):
        run.step(rows.filter(F.col("batch_idx") == b).select("row_id", "url", "type"), b - 1)
    weights = spark.read.parquet(run._table("weights"))
    assert {r.batch_id for r in weights.select("batch_id").distinct().collect()} == {0, 1, 2}
    assert weights.filter("weight <> 0").count() > 0
    accuracy = [r.accuracy for r in spark.read.parquet(run._table("metrics")).orderBy("batch_id").collect()]
    assert len(accuracy) == 2 and all(0 <= a <= 1 for a in accuracy)


def test_new_dictionary_refits_on_its_window(spark, sf, tmp_path):
    """After batch 3 the weights come from the batch and then from batches 1 to 3 under version 1; a replay gives the same."""
    rows, _, _ = batches(spark, sf, tmp_path)
    run = Progressive(str(tmp_path / "state"), TOP, TOP, MIN_DF, linear_model=True)
    run.warm_up(rows.filter("batch_idx = 0").select("row_id", "url", "type"))
    of = lambda b: rows.filter(F.col("batch_idx") == b).select("row_id", "url", "type")
    for b in (1, 2, 3):
        run.step(of(b), b - 1)
    final = run._weights(spark, 3).persist()
    window = with_tokens(rows.filter("batch_idx between 1 and 3").select("row_id", "url", "type"))
    first = run._trained(with_tokens(of(3)), run._weights(spark, 2), 0)
    assert table(run._trained(window, first, 1)) == table(final)
    assert table(first) != table(final)
    before = table(final)
    run.step(of(3), 2)
    assert table(run._weights(spark, 3)) == before
    run.run_summary(spark)
    got = spark.read.json(run._table("summary")).first()
    assert (got.batches, got.progressive_stream_size) == (3, window.count()) and 0 <= got.cumulative_accuracy <= 1
    assert got.warmup_size == rows.filter("batch_idx = 0").count()


def test_base_model_reads_the_assembled_features(spark, sf):
    """Margins from the long feature table and the model's weights give the model's probabilities."""
    rows = with_tokens(views.urls(spark, sf)).persist()
    from urlsieve.operators import lexicon as L
    dictionary = L.risk_dictionary(rows, (TOP, TOP, MIN_DF)).persist()
    vocabulary, train = FE.tfidf_vocabulary(rows), M.base_training(rows, dictionary).persist()
    fitted = FE.scaler(train)
    model = M.base_pipeline(vocabulary, fitted, 5).fit(train)
    weights = M.base_weights(spark, model)
    names = {r.feature for r in weights.select("feature").distinct().collect()}
    assert names == {f"tfidf:{r.token}" for r in vocabulary.collect()} | {f"dense:{c}" for c in FE.DENSE} | {"(intercept)"}
    long = FE.feature_table(FE.tfidf(rows, vocabulary), FE.scaled(FE.dense_features(rows, dictionary), fitted))
    long = long.unionByName(rows.select("row_id", F.lit("(intercept)").alias("feature"), F.lit(1.0).alias("value")))
    margins = long.join(weights, "feature").groupBy("row_id").pivot("class_id", [0, 1, 2, 3]).agg(F.sum(F.col("value") * F.col("weight")))
    index = {r.label_id: r.label for r in FE.label_index(rows).collect()}
    got = {r.row_id: [r["p_" + index[k]] for k in sorted(index)] for r in M.scored(model, train).collect()}
    want = {r.row_id: np.array([r[str(k)] for k in sorted(index)]) for r in margins.collect()}
    assert set(got) == set(want) and len(got) == rows.count()
    for key, m in want.items():
        e = np.exp(m - m.max())
        assert np.allclose(got[key], e / e.sum(), atol=1e-9)


def test_gradient_steps_lower_the_loss(spark, sf):
    rows = with_tokens(views.urls(spark, sf)).persist()
    vocab = FE.tfidf_vocabulary(rows)
    features = FE.tfidf(rows, vocab).withColumnRenamed("token", "feature").persist()
    balance = FE.class_weights(rows).select("type", F.col("weight").alias("sample_weight"))
    labels = rows.join(balance, "type").select("row_id", F.col("type").alias("label"), "sample_weight")
    weights = spark.createDataFrame([("tok:http", c, 0.0) for c in K.CLASSES], "feature string, class string, weight double")

    def loss(w):
        m = M.margins(features, w).join(labels, "row_id")
        sign = F.when(F.col("label") == F.col("class"), 1.0).otherwise(-1.0)
        return m.agg(F.sum(F.log1p(F.exp(-sign * F.col("margin"))) * F.col("sample_weight")) / F.sum("sample_weight")).first()[0]

    first = M.gradient_step(features, weights, labels, rate=0.5).persist()
    second = M.gradient_step(features, first, labels, rate=0.5)
    start = float(np.log(2))
    assert loss(second) < loss(first) < start


def test_scoring_stream_equals_batch(spark, sf, tmp_path):
    rows, folder, _ = batches(spark, sf, tmp_path)
    out = str(tmp_path / "out")
    scoring.start_scoring(source(spark, folder), out, str(tmp_path / "check")).awaitTermination()
    batch = decide_urls(rows.filter("batch_idx > 0").select("row_id", "url")).select("row_id", "prediction", "risk_score")
    assert table(spark.read.parquet(out).select("row_id", "prediction", "risk_score")) == table(batch)
    q = (scoring.score_stream(source(spark, folder)).select("row_id", "prediction", "risk_score").writeStream.format("memory")
         .queryName("scored").outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    assert table(spark.table("scored")) == table(batch)


def test_running_cells(spark, sf, tmp_path):
    _, folder, _ = batches(spark, sf, tmp_path)
    scored = source(spark, folder).select("type", F.when(F.contains("url", F.lit("login")), K.PHISHING).otherwise(
        K.BENIGN).alias("prediction"))
    q = (running_cells(scored).writeStream.format("memory").queryName("cells").outputMode("complete")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    static = spark.read.parquet(folder).select("type", F.when(F.contains("url", F.lit("login")), K.PHISHING).otherwise(
        K.BENIGN).alias("prediction"))
    assert table(spark.table("cells")) == table(static.groupBy("type", "prediction").count())


def events(spark, sf, tmp_path):
    """Events in time order, one file per third."""
    e = views.table(spark, sf, "events").select(F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("ts"))
    folder = str(tmp_path / "events")
    bounds = e.agg(F.expr("approx_percentile(unix_micros(ts), array(0.33, 0.66))")).first()[0]
    cut = F.when(F.unix_micros("ts") <= bounds[0], 0).when(F.unix_micros("ts") <= bounds[1], 1).otherwise(2)
    for i in range(3):
        e.filter(cut == i).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("client long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
    return e, stream


def admitted(spark, tmp_path, name, files, **options):
    """(query, decisions) of a stream that reads one file after another."""
    folder = tmp_path / name
    for i, rows in enumerate(files):
        d = spark.createDataFrame(rows, "client string, at long").select("client", F.timestamp_micros("at").alias("ts"))
        d.coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema("client string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = (rates.admission_stream(stream, **options).writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", str(tmp_path / f"{name}-check")).trigger(availableNow=True).start())
    q.awaitTermination()
    return q, spark.table(name)


SECOND = 1_000_000
COLUMNS = ["client", "t", "requests", "accepted", "rejected", "retry_after"]


def test_admission_stream_equals_batch(spark, tmp_path):
    """Equal times in different files, times out of order within the watermark, idle and busy clients."""
    rng = random.Random(4)
    rows = [(c, (1000 + i // 2) * SECOND + rng.choice([0, 1, 500_000])) for i in range(200) for c in ("a", "b")] + [("idle", 1005 * SECOND)]
    rows.sort(key=lambda r: r[1] + rng.randint(0, 8 * SECOND))
    files = [rows[i:i + 60] for i in range(0, len(rows), 60)]
    end = [("end", 10_000 * SECOND)]
    q, decided = admitted(spark, tmp_path, "admitted", [*files, end, [("end", 10_001 * SECOND)]], limit=4, window_seconds=10, watermark="30 seconds")
    e = spark.createDataFrame(rows, "client string, at long").select("client", F.timestamp_micros("at").alias("ts"))
    batch = R.admission(e, limit=4, window_seconds=10).withColumn("t", F.unix_micros("ts"))
    assert table(decided.filter("client <> 'end'").select(*COLUMNS)) == table(batch.select(*COLUMNS))
    assert decided.filter("late").count() == 0
    left = q.lastProgress["stateOperators"][0]["numRowsTotal"]  # what the last client still holds, timer included
    assert left <= 8


def test_late_requests_are_told_apart(spark, tmp_path):
    files = [[("a", 100 * SECOND)], [("a", 200 * SECOND)], [("a", 120 * SECOND), ("a", 195 * SECOND)], [("b", 1000 * SECOND)],
             [("b", 1001 * SECOND)]]
    _, decided = admitted(spark, tmp_path, "late", files, limit=1, window_seconds=10, watermark="20 seconds")
    assert [(r.client, r.t, r.requests) for r in decided.filter("late").collect()] == [("a", 120 * SECOND, 1)]
    assert [tuple(r) for r in decided.filter("client = 'a' and not late").select("t", "accepted").orderBy("t").collect()] == [
        (100 * SECOND, 1), (195 * SECOND, 1), (200 * SECOND, 0)]


def test_windowed_rate(spark, sf, tmp_path):
    e, stream = events(spark, sf, tmp_path)
    d = rates.windowed_rate(stream, window="6 hours", slide="1 hour", watermark="1 day")
    q = (d.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start())
    q.awaitTermination()
    want = e.groupBy(F.window("ts", "6 hours", "1 hour"), "client").agg(F.count("*").alias("requests"))
    pick = lambda x: x.select("window.start", "client", "requests")
    assert table(pick(spark.table("rates"))) == table(pick(want))
