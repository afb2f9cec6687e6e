"""Sources that Spark has no reader for: paged listings and change logs behind a Python client, and object stores by name."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from freshet.sources.files import walk
from freshet.sources.match import MATCH_ALL, PatternMatcher

#: How stores are addressed.
SCHEMES = {"s3": "s3a://{bucket}", "azure": "abfss://{bucket}@{account}.dfs.core.windows.net", "oci": "oci://{bucket}@{account}", "gcs": "gs://{bucket}", "local": "file://{bucket}"}


def list_objects(spark: SparkSession, store: str, bucket: str, *, account: str = "", prefix: str = "", matcher: PatternMatcher = MATCH_ALL, max_file_size: int | None = None) -> DataFrame:
    """Objects of a bucket or container, keyed by their name; the prefix narrows the listing, the matcher and the size filter it."""
    return walk(spark, SCHEMES[store].format(bucket=bucket, account=account), recursive=True, prefix=prefix, matcher=matcher, max_file_size=max_file_size)


def needs_scan(committed_version: str | None, logic_version: str) -> bool:
    """Whether a source must be scanned whole: not if the same logic has scanned it before, as its events have kept it current."""
    return committed_version != logic_version


class _Shard(InputPartition):
    def __init__(self, value):
        self.value = value


def paged_source(name: str, ddl: str, shards: Callable[[dict], list], pages: Callable[[dict, object], Iterator[list[tuple]]]) -> type[DataSource]:
    """A reader for spark.dataSource.register: `shards(options)` are read side by side, `pages(options, shard)` yields lists of rows. Both must be picklable."""

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.options = dict(options)

        def partitions(self):
            return [_Shard(s) for s in shards(self.options)]

        def read(self, partition):
            for page in pages(self.options, partition.value):
                yield from page

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return ddl

        def reader(self, schema):
            return Reader(self.options)

    return Source


def change_log_source(name: str, ddl: str, end: Callable[[dict], int], changes: Callable[[dict, int, int], Iterator[tuple]]) -> type[DataSource]:
    """A stream over a numbered change log: `end(options)` is the number after the last change, `changes(options, a, b)` yields those from a to b - 1. Progress lives in the query's checkpoint, so a page is committed only when its batch is."""

    class Reader(DataSourceStreamReader):
        def __init__(self, options):
            self.options = dict(options)

        def initialOffset(self):
            return {"at": int(self.options.get("start", 0))}

        def latestOffset(self):
            return {"at": end(self.options)}

        def partitions(self, start, stop):
            step = int(self.options.get("perTask", 10_000))
            return [_Shard((a, min(a + step, stop["at"]))) for a in range(start["at"], stop["at"], step)]

        def read(self, partition):
            yield from changes(self.options, *partition.value)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return ddl

        def streamReader(self, schema):
            return Reader(self.options)

    return Source


def parse_change_page(page: str) -> tuple[list[dict], str | None, str | None]:
    """(changes, next page, new start) of a page of a drive's change log, as JSON; changes of other kinds than files and drives are an error."""
    data = json.loads(page)
    out = []
    for c in data.get("changes", []):
        kind = c.get("changeType")
        if kind not in ("file", "drive"):
            raise ValueError(f"unknown kind of change: {kind}")
        ident = c.get("fileId" if kind == "file" else "driveId")
        if not ident:
            raise ValueError("a change without an identity")
        out.append({"kind": kind, "id": ident, "removed": bool(c.get("removed", False)) or bool((c.get("file") or {}).get("trashed", False)), "name": (c.get("file") or {}).get("name"), "version": (c.get("file") or {}).get("version"), "time": c.get("time")})
    return out, data.get("nextPageToken"), data.get("newStartPageToken")


def classify_removals(removed: DataFrame, known: DataFrame, elsewhere: DataFrame) -> DataFrame:
    """(file, kind): moved if another corpus has it now, deleted if it was known, else ignored."""
    k, e = known.select("file", F.lit(True).alias("__known")).distinct(), elsewhere.select("file", F.lit(True).alias("__there")).distinct()
    kind = F.when(F.col("__there"), "moved").when(F.col("__known"), "deleted").otherwise("ignored")
    return removed.select("file").distinct().join(k, "file", "left").join(e, "file", "left").select("file", kind.alias("kind"))


def fresh_only(events: DataFrame, time_column: str, scan_started: Column) -> DataFrame:
    """Events that a scan which began at `scan_started` may have missed; those without a readable time stay."""
    return events.where(F.col(time_column).isNull() | (F.col(time_column) >= scan_started))
