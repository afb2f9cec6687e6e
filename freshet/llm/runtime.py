"""Shared folder, written tables, joins that split hot keys, and remote files for the operators of this folder."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_PLACES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_CHUNK = 1 << 15  # bits of a bitmap of bitmap_construct_agg
MOST_BITS = 1 << 29  # 64 MB, the most that a filter of `maybe_in` takes


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where it is unset, one of this process, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="freshet-")
    return _OWN[app]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/freshet/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again: lineage ends here, and a lost executor costs nothing."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PLACES[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of what `table` gave, once all that came of it is written itself; other frames are left alone."""
    for df in tables:
        path = _PLACES.pop(df, None)
        if path:  # by the file system that Spark wrote with
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """`rows` joined with `groups`, which has each key once and in column `size` how many of the `total` rows have it.

    A key with more rows than a partition has on average is hot. There are fewer of those than
    partitions, so they are sent to all tasks, and no hot key's rows meet in one.
    """
    limit = max(1, total // partitions(rows.sparkSession))
    hot = F.broadcast(groups.where(F.col(size) > limit))
    cold = rows.join(hot.select(*on), on, "left_anti").join(groups.where(F.col(size) <= limit), on)
    return rows.join(hot, on).unionByName(cold)


def maybe_in(rows: DataFrame, key: Column, members: DataFrame, count: int, name: str) -> DataFrame:
    """`rows` with a boolean column `name`: false only if `key` (a 64-bit hash) is not among the `count` values of the only column of `members`.

    A bitmap of 16 bits a member, 64 MB at most, goes to all tasks; beyond that size more
    rows pass, and the exact join that follows has more to do, but none is lost.
    """
    bits = _CHUNK
    while bits < min(16 * count, MOST_BITS):
        bits *= 2
    spot = F.pmod(F.col(members.columns[0]), F.lit(bits))
    maps = members.select(spot.alias("spot")).groupBy(F.floor(F.col("spot") / _CHUNK).cast("long").alias("__chunk")).agg(F.bitmap_construct_agg(F.col("spot") % _CHUNK).alias("__bits"))
    own = F.pmod(key, F.lit(bits))
    placed = rows.withColumn("__spot", own).withColumn("__chunk", F.floor(F.col("__spot") / _CHUNK).cast("long"))
    inner = F.col("__spot") % _CHUNK
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(inner / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.expr("shiftleft(1, cast(__spot % 8 as int))")) != 0
    return placed.join(F.broadcast(maps), "__chunk", "left").withColumn(name, F.coalesce(bit, F.lit(False))).drop("__spot", "__chunk", "__bits")


def open_fs(uri: str):
    """(pyarrow file system, path) of a folder of any scheme that Arrow can write: file, hdfs, s3, gs."""
    from pyarrow import fs

    if "://" not in uri:
        uri = ("file://" if uri.startswith("/") else "file:") + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)
