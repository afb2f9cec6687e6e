"""Keeping targets current from streams: bootstrap, then changes; per-key state; readiness; refreshes."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from freshet.sources.topics import latest


def upsert_stream(changes: DataFrame, target, order: list[str], checkpoint: str, *, available_now: bool = True, interval: str | None = None) -> StreamingQuery:
    """Applies a stream of (keys, values, op) to a target: in each batch only the last change of a key counts.

    Repeating a batch after a failure is harmless as long as the target is idempotent. With
    `available_now` the query ends when all that was there at its start is applied: it is ready.
    """
    target.prepare()
    key = target.keys[0]

    def apply(batch: DataFrame, batch_id: int) -> None:
        last = latest(batch, order, key) if len(target.keys) == 1 else batch
        target.apply(last.withColumn("action", F.when(F.col("op") == "delete", "delete").otherwise("upsert")).select(*target.keys, *target.values, "action"))

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval or "5 seconds")
    return writer.start()


def bootstrap_then_changes(scan: DataFrame, events: DataFrame, cutoff: Column, time_column: str) -> tuple[DataFrame, DataFrame]:
    """(the scan, the events it does not cover): events before the cutoff, which is taken before the scan, are dropped; those without a time stay."""
    return scan, events.where(F.col(time_column).isNull() | (F.col(time_column) >= cutoff))


def running_counts(stream: DataFrame, key: str) -> DataFrame:
    """(key, n) after each batch: a counter per key that outlives batches and restarts."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = stream.schema[key].dataType.simpleString()

    def count(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = (state.get[0] if state.exists else 0) + sum(len(b) for b in batches)
        state.update((n,))
        yield pd.DataFrame({key: [k[0]], "n": [n]})

    return stream.groupBy(key).applyInPandasWithState(count, f"`{key}` {kind}, n long", "n long", "update", GroupStateTimeout.NoTimeout)


def use_state(events: DataFrame, state: DataFrame, key: str, initial: Column, change: Column, combine: Callable[[Column, Column], Column]) -> DataFrame:
    """(key, value) after a batch: `change` aggregates a key's events, `combine` adds it to the key's state or `initial`. Keys without an event keep their state.

    As an aggregate, `change` is formed before the shuffle, so a key may have any number of
    events; for the last event use max_by.
    """
    changed = events.groupBy(key).agg(change.alias("__change"))
    before = F.coalesce(F.col("value"), initial).cast(state.schema["value"].dataType)
    after = F.when(F.col("__change").isNull(), before).otherwise(combine(before, F.col("__change"))).cast(state.schema["value"].dataType)
    return state.join(changed, key, "full_outer").select(key, after.alias("value"))


class Refresher:
    """Runs a function again and again, `interval_s` after the end of each run. A first run that fails ends it; later failures are reported and the next run tries again."""

    def __init__(self, fn: Callable[[], None], interval_s: float, on_error: Callable[[Exception], None] | None = None):
        self._fn, self._interval, self._on_error = fn, interval_s, on_error
        self._stop, self.runs, self.ready = threading.Event(), 0, threading.Event()
        self._thread = threading.Thread(target=self._loop, daemon=True)

    def _loop(self) -> None:
        while not self._stop.is_set():
            try:
                self._fn()
                self.runs += 1
                self.ready.set()
            except Exception as error:  # noqa: BLE001
                if self._on_error:
                    self._on_error(error)
                if not self.ready.is_set():
                    return
            self._stop.wait(self._interval)

    def start(self) -> Refresher:
        self._thread.start()
        return self

    def stop(self, timeout_s: float = 30) -> None:
        self._stop.set()
        self._thread.join(timeout_s)


def wait_ready(query: StreamingQuery, timeout_s: float = 300) -> bool:
    """Whether the query has applied all it found at its start within the time."""
    end = time.monotonic() + timeout_s
    while query.isActive and time.monotonic() < end:
        query.processAllAvailable()
        return True
    return not query.isActive and query.exception() is None


def windowed_counts(events: DataFrame, time_column: str, size: str, slide: str | None = None, lateness: str = "10 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts per event-time window, for streams and tables; windows close `lateness` after the greatest time seen."""
    marked = events.withWatermark(time_column, lateness) if events.isStreaming else events
    w = F.window(time_column, size, slide) if slide else F.window(time_column, size)
    return marked.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")
