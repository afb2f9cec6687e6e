"""What was written, remembered and numbered before: versioned tables with an atomic pointer, memo, stable ids."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Ledger:
    """Named tables and notes under a folder of any store. A commit writes new files, then makes one pointer; readers see all or nothing of it.

    Files of a commit have a folder of their own, and a pointer is never overwritten: of two
    writers at once one fails, and neither touches what the other wrote.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(conf)
        self._fs.mkdirs(self._path(self.folder))

    def _pointers(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        return sorted(int(n.removeprefix("commit-")) for n in names if n.startswith("commit-"))

    def _load(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.folder}/commit-{version}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _newest(self) -> tuple[int, dict]:
        for version in reversed(self._pointers()):
            try:
                return version, self._load(version)
            except ValueError:  # a pointer that is being written
                continue
        return 0, {"tables": {}, "notes": {}}

    @property
    def version(self) -> int:
        return self._newest()[0]

    def tables(self) -> dict[str, list[str]]:
        """The folders of each table."""
        return self._newest()[1]["tables"]

    def note(self, name: str) -> str | None:
        """What the last commit that had a note of this name said."""
        return self._newest()[1]["notes"].get(name)

    def read(self, name: str, schema: StructType | str) -> DataFrame:
        """The current rows of a table; an empty one if there is none."""
        found = self.tables().get(name)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{f}" for f in found]) if found else self.spark.createDataFrame([], schema)

    def commit(self, notes: dict[str, str] | None = None, add: dict[str, DataFrame] | None = None, **tables: DataFrame) -> int:
        """Writes tables (those in `add` beside the rows that are there) and makes them current together; fails if another commit came between."""
        base, now = self._newest()
        attempt = uuid.uuid4().hex
        every = dict(now["tables"])
        for name, df in (tables | (add or {})).items():
            df.write.parquet(f"{self.folder}/{name}/{attempt}")
            every[name] = [*(every.get(name, []) if name not in tables else []), f"{name}/{attempt}"]
        said = json.dumps({"tables": every, "notes": now["notes"] | (notes or {})})
        try:
            out = self._fs.create(self._path(f"{self.folder}/commit-{base + 1}"), False)
        except Exception as error:
            raise RuntimeError("another commit came between") from error
        out.write(bytearray(said.encode()))
        out.close()
        return base + 1

    def prune(self, keep: int = 2) -> None:
        """Deletes what only older commits refer to."""
        versions = self._pointers()
        live = {f for v in versions[-keep:] for fs in self._load(v)["tables"].values() for f in fs}
        for v in versions[:-keep]:
            for f in {f for fs in self._load(v)["tables"].values() for f in fs} - live:
                self._fs.delete(self._path(f"{self.folder}/{f}"), True)
            self._fs.delete(self._path(f"{self.folder}/commit-{v}"), False)

    def drop(self) -> None:
        self._fs.delete(self._path(self.folder), True)


def split_by_memo(items: DataFrame, memo: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hits with the remembered columns, misses) of items against a memo table."""
    return items.join(memo, on), items.join(memo.select(*on), on, "left_anti")


def memoize(items: DataFrame, memo: DataFrame, on: list[str], compute) -> tuple[DataFrame, DataFrame]:
    """(results of all items, the memo with only what was touched): compute(misses) returns `on` and the memo's columns.

    Equal items are computed once.
    """
    hits, misses = split_by_memo(items.select(*on).distinct(), memo, on)
    touched = hits.unionByName(compute(misses))
    return items.join(touched, on), touched


def reuse(now: DataFrame, before: DataFrame, key: str = "key") -> DataFrame:
    """(key, reuse, refresh): a result is reused if its item's time is the same, or else its content; refresh if only the time moved."""
    n, b = now.alias("n"), before.alias("b")
    same_time, same_content = F.coalesce(F.col("n.modified") == F.col("b.modified"), F.lit(False)), F.coalesce(F.col("n.fp") == F.col("b.fp"), F.lit(False))
    return n.join(b, F.col(f"n.{key}") == F.col(f"b.{key}"), "left").select(F.col(f"n.{key}").alias(key), (same_time | same_content).alias("reuse"), (~same_time & same_content).alias("refresh"))


def stable_ids(wanted: DataFrame, known: DataFrame, dep: str = "dep") -> DataFrame:
    """(dep, id): known ids stay, new deps get numbers after the greatest one. Numbers have gaps: each of 256 ranges counts by itself, so no task sees all deps."""
    new = wanted.select(dep).distinct().join(known.select(dep), dep, "left_anti").withColumn("__range", F.pmod(F.xxhash64(dep), F.lit(256)))
    top = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__top"))
    numbered = new.withColumn("__row", F.row_number().over(Window.partitionBy("__range").orderBy(dep)))
    fresh = numbered.join(F.broadcast(top)).select(dep, (F.col("__top") + 1 + (F.col("__row") - 1) * 256 + F.col("__range")).cast("bigint").alias("id"))
    return known.select(dep, "id").unionByName(fresh)


def id_sequence(calls: DataFrame, dep: str, order: str) -> DataFrame:
    """`calls` with `ordinal`: the how-manieth call with this dep, so that (dep, ordinal) is a key for stable_ids."""
    return calls.withColumn("ordinal", F.row_number().over(Window.partitionBy(dep).orderBy(order)))


def stable_uuid(*parts: Column) -> Column:
    """A name-based UUID (version 5 layout) of the parts."""
    h = F.sha1(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts]))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8))), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def retain(versions: DataFrame, key: str, version: str, keep: int) -> tuple[DataFrame, DataFrame]:
    """(the newest `keep` versions of each key, the others)."""
    ranked = versions.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version))))
    return ranked.where(F.col("__r") <= keep).drop("__r"), ranked.where(F.col("__r") > keep).drop("__r")
