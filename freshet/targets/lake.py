"""Tables in a folder of any store, merged by key into new versions; vector, document, edge and index tables are such tables with declarations."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from freshet.functions.text import ascii_words
from freshet.operators.ledger import Ledger
from freshet.targets.base import Capabilities, ManagedBy


@dataclass(frozen=True)
class VectorIndex:
    """Declaration of a nearest-neighbour index on a column."""

    column: str
    metric: str = "cosine"
    method: str = "hnsw"
    options: tuple[tuple[str, int], ...] = ()


@dataclass(frozen=True)
class FieldIndex:
    """Declaration of an index on a field: text, tag or numeric; sortable or not."""

    column: str
    kind: str = "text"
    sortable: bool = False


class LakeTable:
    """A keyed table. apply() commits the rows of its actions beside the others, as changes; when those are many they are merged into the rows. Readers never see half of an apply().

    A row is a change if its key was touched since the last merge; the newest change stands
    for the key, a deletion too. Null keys meet each other.
    """

    capabilities = Capabilities(idempotent=True, ordered=True, atomic=True)
    merge_at = 0.2  # of the rows, the changes that make apply() merge

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, keys: list[str], *, managed_by: ManagedBy = ManagedBy.SYSTEM, indexes: tuple = ()):
        self.schema, self.keys, self.managed_by, self.indexes = schema, keys, managed_by, indexes
        self.values = [n for n in schema.names if n not in keys]
        self._ledger = Ledger(spark, folder)
        self._changed = StructType([*schema.fields, StructField("__gone", BooleanType())])

    def prepare(self) -> None:
        if not self._ledger.version and self.managed_by is ManagedBy.SYSTEM:
            self._ledger.commit(rows=self._ledger.spark.createDataFrame([], self.schema), notes={"rows": "0", "changes": "0"})

    def _without(self, rows: DataFrame, touched: DataFrame) -> DataFrame:
        a, b = rows.alias("a"), touched.select(*self.keys).alias("b")
        return a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in self.keys], "left_anti")

    def read(self) -> DataFrame:
        rows = self._ledger.read("rows", self.schema)
        if not int(self._ledger.note("changes") or 0):
            return rows
        changes = self._ledger.read("changes", self._changed)
        return self._without(rows, changes).unionByName(changes.where("not __gone").drop("__gone"))

    def apply(self, actions: DataFrame) -> None:
        led = self._ledger
        touched = actions.where("action <> 'none'").select(*self.schema.names, (F.col("action") == "delete").alias("__gone"))
        if int(led.note("changes") or 0):
            touched = self._without(led.read("changes", self._changed), touched).unionByName(touched)
        many, had = touched.count(), int(led.note("rows") or 0)
        if many > self.merge_at * had:
            led.commit(rows=self._without(led.read("rows", self.schema), touched).unionByName(touched.where("not __gone").drop("__gone")), changes=led.spark.createDataFrame([], self._changed), notes={"changes": "0"})
            led.commit(notes={"rows": str(led.read("rows", self.schema).count())})
        else:
            led.commit(changes=touched, notes={"changes": str(many)})
        led.prune()

    def drop(self) -> None:
        if self.managed_by is ManagedBy.SYSTEM:
            self._ledger.drop()

    def inverted_index(self, column: str) -> DataFrame:
        """(token, keys, tf) of a text column: what a full-text index would hold."""
        return self.read().select(*self.keys, F.explode(ascii_words(F.col(column))).alias("token")).groupBy("token", *self.keys).agg(F.count("*").alias("tf"))


class NodeTable(LakeTable):
    """Nodes of a graph, by their key."""


class RelationTable(LakeTable):
    """Edges of a graph, by their ends unless they have a key of their own."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, keys: list[str] | None = None, **options):
        super().__init__(spark, folder, schema, keys or ["from_id", "to_id"], **options)


@dataclass
class LiveMap:
    """A keyed table in memory that tells its subscribers what changes; equal values change nothing."""

    entries: dict = field(default_factory=dict)
    watchers: list = field(default_factory=list)

    def declare_entry(self, key, value) -> bool:
        if key in self.entries and self.entries[key] == value:
            return False
        self.entries[key] = value
        for w in self.watchers:
            w("upsert", key, value)
        return True

    def delete(self, key) -> bool:
        if key not in self.entries:
            return False
        del self.entries[key]
        for w in self.watchers:
            w("delete", key, None)
        return True

    def watch(self, watcher) -> None:
        self.watchers.append(watcher)
        for k, v in self.entries.items():
            watcher("upsert", k, v)

    def frame(self, spark: SparkSession, schema: str) -> DataFrame:
        return spark.createDataFrame(list(self.entries.items()), schema)
