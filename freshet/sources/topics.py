"""Message topics: as streams, and as keyed tables of what is current."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def topic_stream(spark: SparkSession, servers: str, topics: list[str], *, starting: str = "earliest", max_per_trigger: int | None = None, streaming: bool = True) -> DataFrame:
    """Messages (topic, partition, offset, key, value, timestamp) of a broker; offsets live in the query's checkpoint, so nothing commits by itself."""
    reader = (spark.readStream if streaming else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("startingOffsets", starting)
    if max_per_trigger and streaming:
        reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
    return reader.load().select("topic", "partition", "offset", "key", "value", "timestamp")


def payloads(messages: DataFrame) -> DataFrame:
    """Values of messages that have one."""
    return messages.where("value is not null").select("value")


def changes(messages: DataFrame, is_deletion: Column | None = None) -> DataFrame:
    """Messages with a key, and `op`: delete if the value is null or is_deletion holds, else upsert."""
    gone = F.col("value").isNull() if is_deletion is None else F.col("value").isNull() | F.coalesce(is_deletion, F.lit(False))
    return messages.where("key is not null").withColumn("op", F.when(gone, "delete").otherwise("upsert"))


def latest(changed: DataFrame, order: list[str], key: str = "key") -> DataFrame:
    """The last change of each key."""
    rest = [c for c in changed.columns if c != key]
    last = changed.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last"))
    return last.select(key, *[F.col(f"__last.{c}").alias(c) for c in rest])


def topic_as_map(messages: DataFrame, is_deletion: Column | None = None, order: tuple[str, ...] = ("offset",)) -> DataFrame:
    """(key, value) of the keys that are there after all messages; keys keep to one partition, so their offsets are in order."""
    return latest(changes(messages, is_deletion), list(order)).where("op = 'upsert'").select("key", "value")


def committed_frontier(done: DataFrame) -> DataFrame:
    """(partition, next_offset): how far each partition is done without a gap, from (partition, offset) of messages done; counted from the least offset.

    It is the least offset that follows one that is done and is not done itself.
    """
    each = done.select("partition", "offset").distinct()
    after = each.select("partition", (F.col("offset") + 1).alias("offset"))
    return after.join(each, ["partition", "offset"], "left_anti").groupBy("partition").agg(F.min("offset").alias("next_offset"))


def coalesce_changes(changed: DataFrame) -> DataFrame:
    """One change per file from (file, corpus, ordinal, removed, version, name): the last of each corpus, of these the newest version that is there; removed if it is gone from any corpus.

    Without any live one, the last change stays.
    """
    per = changed.groupBy("file", "corpus").agg(F.max_by(F.struct("ordinal", "removed", "version", "name"), "ordinal").alias("c")).select("file", "corpus", "c.*")
    rank = F.struct((~F.col("removed")).alias("live"), (~F.col("removed") & F.col("version").isNotNull()).alias("known"), F.when(~F.col("removed"), F.coalesce("version", F.lit(-1))).otherwise(-1).alias("version"), F.col("ordinal").alias("ordinal"))
    return per.groupBy("file").agg(F.max_by(F.struct("corpus", "ordinal", "version", "name"), rank).alias("c"), F.max("removed").alias("removed")).select("file", "c.*", "removed")


def normalize_permissions(grants: DataFrame, now: Column) -> DataFrame:
    """(file, principals, groups) from (file, kind, name, expires, inherited): lower-cased, without repetitions or what has expired, sorted."""
    live = grants.where(F.col("expires").isNull() | (F.col("expires") > now)).withColumn("name", F.lower(F.trim("name")))
    pick = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("name"))))
    return live.groupBy("file").agg(pick("user").alias("principals"), pick("group").alias("groups"))
