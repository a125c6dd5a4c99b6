"""Run events as a stream: live status and job timeouts, with late events given back.

Both operators keep their own state and event-time timers. The time column that
carries the watermark is not the one the processors read, so Spark removes no
row as late: a processor sees every event, compares it with the watermark and
gives a late one back as a row of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pixelloom.operators.runs import TERMINAL, TIMEOUT_SECONDS, latest_status, status_columns

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MICROS = 1_000_000
# The outputs of a stream of runs.
OUTCOME, LATE = "outcome", "late"

RESULT_SCHEMA = "kind string, run_id string, event_id long, at long, status string"
STATUS_SCHEMA = (
    "run_id string, event_id long, at long, status string, progress double, message string, error string"
)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State of several columns and timers need this store; the session's own choice comes back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class _Timed(StatefulProcessor):
    """One event-time timer per run; times are microseconds, timers whole milliseconds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", self.schema)

    def get(self) -> tuple | None:
        return tuple(self.state.get()) if self.state.exists() else None

    def wake(self, at: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(-(-at // 1000))

    def close(self) -> None:
        pass


class _Outcomes(_Timed):
    """submitted: first event; ended, tie, status: first terminal event; closed: the outcome is given."""

    schema = "submitted long, ended long, tie long, status string, closed boolean"

    def __init__(self, seconds: int, keep: int):
        self.span, self.keep = seconds * MICROS, keep * MICROS

    def handleInputRows(self, key, rows, timerValues):
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        submitted, ended, tie, status, closed = self.get() or (None, None, None, None, False)
        for frame in rows:
            late = frame["at"] <= watermark if watermark > 0 else pd.Series(False, frame.index)
            if late.any():
                yield frame[late].assign(kind=LATE)[["kind", "run_id", "event_id", "at", "status"]]
            frame = frame[~late]
            if closed or not len(frame):
                continue
            low = int(frame["at"].min())
            submitted = low if submitted is None else min(low, submitted)
            ends = frame[frame["status"].isin(TERMINAL)]
            if len(ends):
                first = ends.sort_values(["at", "event_id"]).iloc[0]
                end = (int(first["at"]), int(first["event_id"]), first["status"])
                if ended is None or end[:2] < (ended, tie):
                    ended, tie, status = end
        if submitted is not None and not closed:
            self.state.update((submitted, ended, tie, status, closed))
            self.wake(min(x for x in (ended, submitted + self.span) if x is not None))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        submitted, ended, tie, status, closed = self.get()
        if closed:  # nothing came for so long that the mark can go
            self.state.clear()
            return
        in_time = ended is not None and ended <= submitted + self.span
        self.state.update((submitted, ended, tie, status, True))
        self.wake(max(timerValues.getCurrentWatermarkInMs() * 1000, submitted) + self.keep)
        yield pd.DataFrame(
            {"kind": [OUTCOME], "run_id": [key[0]], "event_id": pd.array([tie if in_time else None], "Int64"),
             "at": [submitted], "status": [status if in_time else "timeout"]}
        )


def _marked(events: DataFrame, delay: str, columns: list[str]) -> DataFrame:
    """The watermark follows ts; the processors read `at`, microseconds, which carries no mark."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return stamped.select("run_id", F.unix_micros("ts").alias("at"), *columns)


def stream_timeouts(
    events: DataFrame, delay: str, seconds: int = TIMEOUT_SECONDS, keep: int = 30 * 24 * 3600
) -> DataFrame:
    """kind, run_id, event_id, at, status: one ``outcome`` per run, and every ``late`` event.

    ``events`` is (run_id, event_id, ts, status); a null ts or run_id is late.
    An outcome is given when the watermark (the newest time seen, less ``delay``)
    has passed the first terminal event or the deadline: no event that could
    change it is still to come. So files in any order give the outcomes of
    ``operators.runs.job_outcomes`` over the events that were not late. ``at`` is
    the submission of an outcome and the time of a late event, in microseconds.

    Only later events move the watermark, so runs at the end of the stream stay
    open. A closed run keeps a mark of one row until the watermark is ``keep``
    seconds further; ids must not come back after that. Events of one run reach
    one state task, in Arrow batches.

    Needs the RocksDB state store (``rocksdb``) where the query is started.
    """
    rows = _marked(events, delay, ["event_id", "status"])
    return rows.groupBy("run_id").transformWithStateInPandas(
        _Outcomes(seconds, keep), RESULT_SCHEMA, "append", "EventTime"
    )


def start_timeouts(
    events: DataFrame, path: str, checkpoint: str, delay: str, seconds: int = TIMEOUT_SECONDS,
    keep: int = 30 * 24 * 3600, trigger: dict[str, Any] | None = None,
) -> StreamingQuery:
    """Write the outcomes and the late events to ``path``, in folders by kind."""
    with rocksdb(events.sparkSession):
        return (
            stream_timeouts(events, delay, seconds, keep)
            .writeStream.outputMode("append").format("parquet").partitionBy("kind")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start()
        )


def written(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """run_id, event_id, at timestamp, status of one kind of output of ``start_timeouts``."""
    rows = spark.read.schema(RESULT_SCHEMA).parquet(path).filter(F.col("kind") == kind)
    return rows.select("run_id", "event_id", F.timestamp_micros("at").alias("at"), "status")


class _Status(_Timed):
    """The newest event of the run."""

    schema = "at long, tie long"

    def __init__(self, keep: int):
        self.keep = keep * MICROS

    def handleInputRows(self, key, rows, timerValues):
        known, newest = self.get(), None
        for frame in rows:
            row = frame.sort_values(["at", "event_id"]).iloc[-1]
            if newest is None or (row["at"], row["event_id"]) > (newest["at"], newest["event_id"]):
                newest = row
        if newest is None or (known and (newest["at"], newest["event_id"]) <= known):
            return
        self.state.update((int(newest["at"]), int(newest["event_id"])))
        self.wake(max(int(newest["at"]) + self.keep, timerValues.getCurrentWatermarkInMs() * 1000 + 1000))
        yield newest.to_frame().T

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        return iter(())


def _newest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The last event of each run in an Arrow batch: all that a hot run sends to its state task."""
    for frame in frames:
        yield frame.sort_values(["at", "event_id"]).drop_duplicates("run_id", keep="last")


def stream_status(events: DataFrame, delay: str | None = None, keep: int = 24 * 3600) -> DataFrame:
    """The newest status of each run, whenever it changes (update mode).

    Without ``delay`` it is the aggregate of ``operators.runs.latest_status``,
    which keeps a row of state per run for ever. With ``delay`` a run leaves the
    state when the watermark is ``keep`` seconds past its newest event; events of
    a run that come later than that begin it anew. Needs the RocksDB state store
    (``rocksdb``) then. Events may come in any order.
    """
    if delay is None:
        return latest_status(events)
    rows = status_columns(_marked(events, delay, ["event_id", "status", "progress", "message"])).select(
        "run_id", "event_id", "at", "status", "progress", "message", "error"
    )
    changed = rows.mapInPandas(_newest, STATUS_SCHEMA).groupBy("run_id").transformWithStateInPandas(
        _Status(keep), STATUS_SCHEMA, "update", "EventTime"
    )
    return changed.select(
        "run_id", F.timestamp_micros("at").alias("ts"), "status", "progress", "message", "error",
        F.col("status").isin(*TERMINAL).alias("terminal"),
    )
