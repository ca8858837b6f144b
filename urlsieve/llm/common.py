"""Shared by the operators: tables, words, bounded batches of Arrow texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BATCH_BYTES = 1 << 21  # text handled at once by a numpy helper; a longer text is a batch of its own
BROADCAST_ROWS = 300_000  # counted rows of at most about 100 bytes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else untouched; texts of one byte a character take the fast way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def broadcast_counted(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a table whose rows were counted; beyond the bound Spark shuffles both sides."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else \
        np.zeros(1, np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), off


def text_runs(offsets: np.ndarray, most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts of at most `most` bytes together, or of one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def without(docs: DataFrame, rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` less the rows whose key and text hash stand in `rows` (key, text_hash)."""
    out = written(rows.select(F.col(key).alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "dropped")
    return docs.join(broadcast_counted(out, out.count()), F.col(key).eqNullSafe(F.col("__id")) & (
        F.xxhash64(text) == F.col("__hash")), "left_anti")


def unclashing(columns: list[str], own: list[str]) -> list[str]:
    """The columns whose names none of `own` takes."""
    taken = {c.lower() for c in own}
    return [c for c in columns if c.lower() not in taken]
