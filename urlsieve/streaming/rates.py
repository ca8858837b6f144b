"""Streaming request rates: sliding-window counts and stateful admission."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import constants as K
from ..operators.ratelimit import MICROS, admit, micros

# Requests later than this behind the newest one are dropped.
WATERMARK = "10 minutes"
COLUMNS = ["client", "t", "requests", "accepted", "rejected", "retry_after", "late"]


def windowed_rate(events: DataFrame, client: str = "client", ts: str = "ts", window: str = "60 seconds",
                  slide: str = "10 seconds", watermark: str = WATERMARK) -> DataFrame:
    """(window, client, requests) over sliding windows; state ends with the watermark."""
    counted = events.withWatermark(ts, watermark).groupBy(F.window(ts, window, slide), client)
    return counted.agg(F.count("*").alias("requests"))


class Admission(StatefulProcessor):
    """Decides on the requests of one client in time order.

    Requests wait until the watermark has passed their time; then no other of that time or before can come, so equal
    times are counted together and the order of arrival does not matter. State is the waiting times and the accepted
    ones of a window, at most `limit`. A timer stands at the earliest waiting time, or where the last accepted one
    leaves the window, so the state of an idle client goes.
    """

    def __init__(self, limit: int, window_seconds: int):
        self.limit, self.window = limit, window_seconds * MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        time, number = T.StructField("t", T.LongType()), T.StructField("n", T.LongType())
        self.handle = handle
        self.waiting = handle.getMapState("waiting", T.StructType([time]), T.StructType([number]))
        self.log = handle.getListState("accepted", T.StructType([time, number]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, passed = None, timerValues.getCurrentWatermarkInMs() * 1000
        for batch in rows:
            late = []
            for t, n in batch.groupby("t")["requests"].sum().items():
                t, n = int(t), int(n)
                if t <= passed:
                    late.append((key[0], t, n, 0, 0, 0, True))
                    continue
                held = self.waiting.getValue((t,))[0] if self.waiting.containsKey((t,)) else 0
                self.waiting.updateValue((t,), (held + n,))
                first = t if first is None else min(first, t)
            if late:
                yield pd.DataFrame(late, columns=COLUMNS)
        if first is not None:
            self._wake(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        times = [t for t, in self.waiting.keys()]
        live = deque((int(t), int(n)) for t, n in self.log.get())
        out = []
        for t in sorted(t for t in times if t <= now):
            n = self.waiting.getValue((t,))[0]
            accepted, retry = admit(live, t, n, self.limit, self.window)
            out.append((key[0], t, n, accepted, n - accepted, retry, False))
            self.waiting.removeKey((t,))
        while live and live[0][0] + self.window <= now:
            live.popleft()
        later = [t for t in times if t > now]
        if live:
            self.log.put([tuple(x) for x in live])
            later.append(live[-1][0] + self.window)
        else:
            self.log.clear()
        if later:
            self._wake(min(later))
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)

    def _wake(self, t: int) -> None:
        self.handle.registerTimer(t // 1000 + 1)

    def close(self) -> None:
        pass


def admission_stream(events: DataFrame, client: str = "client", ts: str = "ts", limit: int = K.RATE_MAX_REQUESTS,
                     window_seconds: int = K.RATE_WINDOW_SECONDS, watermark: str = WATERMARK) -> DataFrame:
    """Admission decisions over a stream; needs the RocksDB state store.

    A request is decided once the watermark has passed it. Requests that come later than that change nothing: they
    are neither accepted nor rejected, and their rows say `late`. Rows without a time are left out.
    """
    key_type = events.schema[client].dataType.simpleString()
    rows = events.filter(F.col(ts).isNotNull()).withWatermark(ts, watermark).select(
        F.col(client).alias("client"), F.col(ts).alias("ts"), micros(ts).alias("t"), F.lit(1).cast("long").alias("requests"))
    return rows.groupBy("client").transformWithStateInPandas(
        statefulProcessor=Admission(limit, window_seconds),
        outputStructType=f"client {key_type}, t long, requests long, accepted long, rejected long, retry_after long, "
                         "late boolean",
        outputMode="append", timeMode="EventTime")

