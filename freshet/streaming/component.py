"""A live component: a full pass first, then keyed updates and deletions, newest first where they overtake each other."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from freshet.operators.reconcile import diff_tables


class LiveComponent:
    """Keeps a target as `full()` says. update(key rows) and delete(keys) wait until flush(), which applies only the last of each key in one batch."""

    def __init__(self, spark: SparkSession, target, full: Callable[[], DataFrame], on_error: Callable[[Exception], None] | None = None):
        self._spark, self._target, self._full, self._on_error = spark, target, full, on_error
        self._pending: dict[tuple, tuple | None] = {}
        self._lock = threading.Lock()
        self.ready, self.superseded = threading.Event(), 0

    def update_full(self) -> dict[str, int]:
        """Writes the difference between full() and what the target holds."""
        self._target.prepare()
        actions = diff_tables(self._full(), self._target.read(), self._target.keys, self._target.values).where("action <> 'unchanged'")
        counts = {r["action"]: r["count"] for r in actions.groupBy("action").count().collect()}
        if counts:
            self._target.apply(actions)
        with self._lock:
            self._pending.clear()
        self.ready.set()
        return counts

    def _put(self, key: tuple, row: tuple | None) -> None:
        with self._lock:
            self.superseded += key in self._pending
            self._pending[key] = row

    def update(self, *row) -> None:
        """A row: keys, then values, in the target's order."""
        self._put(tuple(row[: len(self._target.keys)]), tuple(row))

    def delete(self, *key) -> None:
        self._put(tuple(key), None)

    def flush(self) -> int:
        with self._lock:
            pending, self._pending = self._pending, {}
        if not pending:
            return 0
        width = len(self._target.values)
        rows = [(*(r if r is not None else (*k, *[None] * width)), "delete" if r is None else "upsert") for k, r in pending.items()]
        names = [*self._target.keys, *self._target.values]
        kinds = ", ".join(f"`{n}` {self._target.schema[n].dataType.simpleString()}" for n in names)
        try:
            self._target.apply(self._spark.createDataFrame(rows, kinds + ", action string"))
        except Exception as error:
            with self._lock:  # newer updates of the same keys stay
                self._pending = pending | self._pending
            if not self._on_error:
                raise
            self._on_error(error)
            return 0
        return len(pending)


class Progress(StreamingQueryListener):
    """Rows and batches of streaming queries as they run; add with spark.streams.addListener."""

    def __init__(self, show: Callable[[str], None] = lambda s: None):
        self.batches, self.rows, self.failures, self._show = 0, 0, 0, show

    def onQueryStarted(self, event) -> None:
        self._show(f"started {event.name or event.id}")

    def onQueryProgress(self, event) -> None:
        self.batches += 1
        self.rows += event.progress.numInputRows
        self._show(f"batch {event.progress.batchId}: {event.progress.numInputRows} rows")

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None:
        self.failures += event.exception is not None
        self._show("ended" if event.exception is None else f"failed: {event.exception}")


def certified_apply(target, actions: DataFrame) -> DataFrame:
    """Applies actions, reads the target again and returns (keys, action, proven): whether each is there, or gone, as asked."""
    from pyspark.sql import functions as F

    actions = actions.where("action not in ('none', 'unchanged')")
    target.apply(actions)
    there = target.read().select(*target.keys, F.struct(*target.values).alias("__there"), F.lit(True).alias("__is"))
    joined = actions.join(there, target.keys, "left")
    same = F.struct(*[F.col(v) for v in target.values]).eqNullSafe(F.col("__there"))
    return joined.select(*target.keys, "action", F.when(F.col("action") == "delete", F.col("__is").isNull()).otherwise(F.col("__is").isNotNull() & same).alias("proven"))
