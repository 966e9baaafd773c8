"""A fixed-window limiter for each key: a window opens at the key's first event and lasts `seconds`; later events of it beyond `most` are refused."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "user_id long, event_id long, allowed boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _walk(at: np.ndarray, opened: int | None, count: int, most: int, span: int) -> tuple[np.ndarray, int | None, int]:
    """Sorted times of events -> which are allowed, the last window's start and its events so far: a search for each window, none for each event."""
    n, i = len(at), 0
    number = np.empty(n, np.int64)
    while i < n:
        if opened is None or at[i] > opened + span:
            opened, count = int(at[i]), 0
        j = int(np.searchsorted(at, opened + span, "right"))
        number[i:j] = np.arange(count + 1, count + j - i + 1)
        count, i = count + j - i, j
    return number <= most, opened, count


def limited(events: DataFrame, most: int = 20, seconds: float = 300) -> DataFrame:
    """Batch form. A key's events stream through in order, so a key of any size takes bounded memory; its windows follow one from another,
    so they are one task's."""
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = events.select("user_id", "event_id", "ts").filter(F.col("user_id").isNotNull() & F.col("ts").isNotNull())
    span = round(seconds * 1e6)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, opened, count = None, None, 0
        for part in parts:
            at, users = part["at"].to_numpy(), part["user_id"].to_numpy()
            edges = [0, *(np.flatnonzero(users[1:] != users[:-1]) + 1).tolist(), len(users)]
            allowed = np.empty(len(users), bool)
            for a, b in zip(edges, edges[1:], strict=False):
                if a < b:
                    if users[a] != key:
                        key, opened, count = users[a], None, 0
                    allowed[a:b], opened, count = _walk(at[a:b], opened, count, most, span)
            yield pd.DataFrame({"user_id": users, "event_id": part["event_id"], "allowed": allowed})

    micros = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    return rows.select("user_id", "event_id", micros).repartition(n, "user_id").sortWithinPartitions("user_id", "at", "event_id").mapInPandas(run, SCHEMA)


class _Limiter(StatefulProcessor):
    """A key's events wait in the state until the watermark has passed them, are walked in order of time, and leave. An open window stays
    until the watermark has passed its end; a timer then drops it, so a key without events keeps nothing."""

    def __init__(self, most: int, span: int):
        self.most, self.span = most, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event_id long")
        self.window = handle.getValueState("window", "opened long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        self.waiting.appendList(list(zip(new["at"].tolist(), new["event_id"].tolist(), strict=True)))
        self._wake(int(new["at"].min()), timerValues)
        return iter(())

    def _wake(self, micros: int, times) -> None:
        self.handle.registerTimer(max(-(-micros // 1000), times.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        due = [r for r in rows if r[0] <= now]
        rest = rows[len(due) :]
        opened, count = self.window.get() if self.window.exists() else (None, 0)
        if due:
            allowed, opened, count = _walk(np.array([r[0] for r in due]), opened, count, self.most, self.span)
            yield pd.DataFrame({"user_id": [key[0]] * len(due), "event_id": [r[1] for r in due], "allowed": allowed})
            self.waiting.put(rest) if rest else self.waiting.clear()
        if opened is not None and opened + self.span <= now:
            self.window.clear()  # whatever comes now is after its end
            opened = None
        elif due:
            self.window.update((opened, count))
        if rest:
            self._wake(rest[0][0], timerValues)
        elif opened is not None:
            self._wake(opened + self.span, timerValues)

    def close(self) -> None:
        pass


def limited_stream(events: DataFrame, most: int = 20, seconds: float = 300, delay: str = "10 minutes") -> DataFrame:
    """Streaming form: as limited() of all events that come at most `delay` after a later one, in whatever order; later ones are left out.
    Needs the RocksDB state store, which is set where the session has the default one."""
    conf = events.sparkSession.conf
    if "RocksDB" not in conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = events.select("user_id", "event_id", "ts").filter(F.col("user_id").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", delay)
    keyed = rows.select("user_id", "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).groupBy("user_id")
    return keyed.transformWithStateInPandas(_Limiter(most, round(seconds * 1e6)), SCHEMA, "Append", "EventTime")
