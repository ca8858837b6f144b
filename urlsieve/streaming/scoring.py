"""Streams of URLs: stateless scoring, and scoring with a learned dictionary per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import decide as D
from ..operators import evidence as E
from ..sources.readers import write_batch

RESULT = ["row_id", "url", "prediction", "is_malicious", "risk_score", "confidence", "url_reasons"]


def score_stream(urls: DataFrame) -> DataFrame:
    """Decisions by the fixed lexicon; row-local, so it works in append mode without state."""
    return D.decide(E.url_evidence(urls)).select(*RESULT)


def start_scoring(urls: DataFrame, path: str, checkpoint: str, dictionary: DataFrame | None = None,
                  available_now: bool = True) -> StreamingQuery:
    """Score a stream of (row_id, url) into `path`, one folder per micro-batch; a replay overwrites its folder."""
    def step(batch: DataFrame, batch_id: int) -> None:
        decided = D.decide(E.url_evidence(batch, dictionary)).select(*RESULT)
        write_batch(decided, path, batch_id)

    writer = urls.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
