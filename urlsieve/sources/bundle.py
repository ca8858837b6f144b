"""Model bundles: fitted stages, tables and settings stored together."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

REQUIRED_MODELS = ["base", "specialist"]
REQUIRED_TABLES = ["dictionary", "char_vocab", "lexicon"]
OPTIONAL_TABLES = ["meta_gate"]


def save_bundle(path: str, models: dict[str, PipelineModel], tables: dict[str, DataFrame], config: dict) -> None:
    """Write a bundle; the settings go last, so a bundle with settings is complete."""
    for name, model in models.items():
        model.write().overwrite().save(f"{path}/models/{name}")
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/tables/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(config),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def load_bundle(spark: SparkSession, path: str) -> tuple[dict[str, PipelineModel], dict[str, DataFrame], dict]:
    """Models, tables and settings; a missing required part is an error, a missing optional one is left out."""
    parts = [f"models/{m}" for m in REQUIRED_MODELS] + [f"tables/{t}" for t in REQUIRED_TABLES] + ["config"]
    missing = [p for p in parts if not _exists(spark, f"{path}/{p}")]
    if missing:
        raise FileNotFoundError(f"bundle {path} lacks {', '.join(missing)}")
    tables = REQUIRED_TABLES + [t for t in OPTIONAL_TABLES if _exists(spark, f"{path}/tables/{t}")]
    config = json.loads(spark.read.text(f"{path}/config").first()[0])
    return ({m: PipelineModel.load(f"{path}/models/{m}") for m in REQUIRED_MODELS},
            {t: spark.read.parquet(f"{path}/tables/{t}") for t in tables}, config)
