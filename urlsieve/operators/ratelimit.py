"""Request rates per client: rolling counts and the sliding-log admission decision.

A client may send a third of all requests. Both operators therefore count equal timestamps together first
and split a client's time line; neither gathers a client in memory.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K

MICROS = 1_000_000


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp with or without time zone, whatever the session's zone."""
    fraction = (F.date_part(F.lit("SECOND"), ts) * MICROS).cast("long") % MICROS
    return F.unix_timestamp(ts) * MICROS + fraction


def _counted(df: DataFrame, client: str, ts: str) -> DataFrame:
    return df.groupBy(client, ts).agg(F.count("*").alias("requests")).withColumn("t", micros(ts))


def rolling_rate(df: DataFrame, client: str = "client", ts: str = "ts",
                 window_seconds: int = K.RATE_WINDOW_SECONDS) -> DataFrame:
    """(client, ts, requests, in_window): requests of the client in the trailing window, ends included.

    Time is cut into cells of one window. Every row also stands in the next cell, where it can only be
    looked back at; so each (client, cell) is a partition of its own.
    """
    w = window_seconds * MICROS
    d = _counted(df, client, ts).withColumn("_home", F.floor(F.col("t") / w))
    d = d.select("*", F.explode(F.array(F.col("_home"), F.col("_home") + 1)).alias("_cell"))
    frame = W.partitionBy(client, "_cell").orderBy("t").rangeBetween(-w, 0)
    d = d.withColumn("in_window", F.sum("requests").over(frame)).filter(F.col("_cell") == F.col("_home"))
    return d.select(client, ts, "requests", "in_window")


def runs(counted: DataFrame, client: str, window_seconds: int) -> DataFrame:
    """Add `run`: rows of one client in different runs lie more than a window apart.

    A run is a chain of neighbouring non-empty cells. The chain is found on the distinct cells of a
    client, not on its requests.
    """
    w = window_seconds * MICROS
    d = counted.withColumn("_cell", F.floor(F.col("t") / w))
    cells = d.select(client, "_cell").distinct()
    order = W.partitionBy(client).orderBy("_cell")
    starts = F.when(F.col("_cell") - F.lag("_cell").over(order) == 1, 0).otherwise(1)
    cells = cells.withColumn("_new", starts).withColumn("run", F.sum("_new").over(order)).drop("_new")
    return d.join(cells, [client, "_cell"]).drop("_cell")


def admit(live: deque, t: int, requests: int, limit: int, window: int) -> tuple[int, int]:
    """(accepted, retry after seconds) of equal-time requests; `live` holds (time, accepted) of the window."""
    while live and live[0][0] < t - window:
        live.popleft()
    room = limit - sum(n for _, n in live)
    accepted = max(0, min(requests, room))
    if accepted:
        live.append((t, accepted))
    if accepted == requests:
        return accepted, 0
    return accepted, max(1, int((window - (t - live[0][0])) / MICROS))


OUT = "requests long, accepted long, rejected long, retry_after long"


def admission(df: DataFrame, client: str = "client", ts: str = "ts", limit: int = K.RATE_MAX_REQUESTS,
              window_seconds: int = K.RATE_WINDOW_SECONDS) -> DataFrame:
    """(client, ts, requests, accepted, rejected, retry_after) of a sliding log of accepted requests.

    A request is accepted while fewer than `limit` accepted ones lie in the window; one exactly at its
    start still counts. Rejected requests are not logged. Runs more than a window apart do not touch each
    other, so they spread over tasks; a task reads its runs in time order and keeps at most `limit` times.
    """
    key_type, ts_type = (df.schema[c].dataType.simpleString() for c in (client, ts))
    window = window_seconds * MICROS
    d = runs(_counted(df, client, ts), client, window_seconds)
    d = d.repartition(client, "run").sortWithinPartitions(client, "run", "t").select(client, ts, "run", "t", "requests")

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, live = None, deque()
        for batch in batches:
            out = []
            for name, at, run, t, n in batch.itertuples(index=False, name=None):
                if (name, run) != current:
                    current, live = (name, run), deque()
                accepted, retry = admit(live, t, n, limit, window)
                out.append((name, at, n, accepted, n - accepted, retry))
            yield pd.DataFrame(out, columns=[client, ts, "requests", "accepted", "rejected", "retry_after"])

    return d.mapInPandas(decide, f"`{client}` {key_type}, `{ts}` {ts_type}, {OUT}")
