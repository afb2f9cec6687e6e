"""Audit events, items set aside and revocation cases, as tables of any size: changes come as DataFrames, a batch at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from freshet.functions.hashing import canonical, tree_digest
from freshet.operators.governance import redact_metadata
from freshet.operators.ledger import Ledger
from freshet.targets.lake import LakeTable


def _strings(*names: str, **more) -> StructType:
    return StructType([*[StructField(n, StringType()) for n in names], *[StructField(n, t) for n, t in more.items()]])


class AuditTable:
    """Batches of events without secrets, each with a digest that contains the one before: a changed, missing or added event shows."""

    schema = "batch bigint, kind string, at timestamp, details map<string,string>"

    def __init__(self, spark: SparkSession, folder: str):
        self._ledger = Ledger(spark, folder)

    def events(self) -> DataFrame:
        return self._ledger.read("events", self.schema)

    def _last(self) -> tuple[int, str]:
        number, _, digest = (self._ledger.note("last") or "0:").partition(":")
        return int(number), digest

    @staticmethod
    def _digests(events: DataFrame) -> DataFrame:
        pairs = F.array_sort(F.map_entries("details"))
        return tree_digest(events.select("batch", F.sha2(canonical(F.col("kind"), F.unix_micros("at"), pairs), 256).alias("d")), ["batch"], "d")

    def append(self, events: DataFrame) -> int:
        """Adds a batch (kind, at, details) and returns its number; an empty one adds nothing."""
        number, before = self._last()
        rows = events.select(F.lit(number + 1).cast("bigint").alias("batch"), "kind", F.col("at").cast("timestamp").alias("at"), redact_metadata(F.col("details")).alias("details"))
        own = self._digests(rows).withColumn("chain", F.sha2(F.concat(F.lit(before), F.lit("\n"), F.col("digest")), 256)).first()
        if own is None:
            return number
        self._ledger.commit(add={"events": rows}, notes={"last": f"{number + 1}:{own['chain']}", f"batch-{number + 1:012d}": own["chain"]})
        return number + 1

    def verify(self) -> bool:
        """Whether all batches are there as they were written."""
        number, _ = self._last()
        said = [(n, self._ledger.note(f"batch-{n:012d}"), self._ledger.note(f"batch-{n - 1:012d}") or "") for n in range(1, number + 1)]  # one for each batch, as in the pointer itself
        known = self._ledger.spark.createDataFrame(said, "batch bigint, chain string, before string")
        both = known.join(self._digests(self.events()), "batch", "full_outer")
        good = F.coalesce(F.col("chain") == F.sha2(F.concat("before", F.lit("\n"), "digest"), 256), F.lit(False))
        return both.where(~good).limit(1).count() == 0


class QuarantineTable:
    """Items set aside, once each, with a reason and a status: open, released or discarded."""

    def __init__(self, spark: SparkSession, folder: str):
        self._table = LakeTable(spark, folder, _strings("id", "item", "reason", "status"), ["id"])
        self._table.prepare()

    def add(self, rows: DataFrame, reason: str | Column) -> None:
        """Sets rows aside as JSON; an item that is known already stays as it is."""
        why = F.lit(reason) if isinstance(reason, str) else reason
        item = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"})
        new = rows.select(item.alias("item"), why.alias("reason")).groupBy(F.substring(F.sha2("item", 256), 1, 32).alias("id"), "item").agg(F.min("reason").alias("reason"))
        new = new.join(self._table.read().select("id"), "id", "left_anti")
        self._table.apply(new.select("id", "item", "reason", F.lit("open").alias("status"), F.lit("insert").alias("action")))

    def items(self, status: str | None = None) -> DataFrame:
        found = self._table.read()
        return found.where(F.col("status") == status) if status else found

    def _set(self, ids: DataFrame, status: str) -> DataFrame:
        wanted = ids.select("id").distinct().join(self._table.read(), "id", "left")
        done = wanted.where("status = 'open'").select("id", "item", "reason", F.lit(status).alias("status"), F.lit("replace").alias("action"))
        refused = wanted.where("status is null or status <> 'open'").select("id", "status")
        out = self._table._ledger.spark.createDataFrame(refused.collect(), refused.schema) if refused.limit(1).count() else refused.limit(0)
        self._table.apply(done)
        return out

    def release(self, ids: DataFrame) -> DataFrame:
        """Releases open items; returns (id, status) of those that were not open (status null: unknown)."""
        return self._set(ids, "released")

    def discard(self, ids: DataFrame) -> DataFrame:
        """Discards open items; returns what release() returns."""
        return self._set(ids, "discarded")


#: Stage -> stages that may follow: fixed values.
STAGES = {
    "received": ("suppressing", "rejected", "cancelled"), "suppressing": ("suppressed", "expired"), "suppressed": ("deleting", "restored", "expired"), "deleting": ("deleted", "expired"), "deleted": ("verifying",),
    "verifying": ("verified", "deleting", "expired"), "verified": (), "restored": (), "rejected": (), "expired": (), "cancelled": (),
}


def advance(cases: DataFrame, requests: DataFrame) -> DataFrame:
    """All columns of `cases` that `requests` (case_id, to) ask for, with `to` and `refused`: null if the stage may follow, else why not.

    A case is verified only with a receipt of every target that was expected. Of several
    requests for a case the least stage by name counts; unknown cases are refused.
    """
    asked = requests.groupBy("case_id").agg(F.min("to").alias("to"))
    may = F.create_map(*[F.lit(x) for k, v in STAGES.items() for x in (k, ",".join(v))])
    follows = F.array_contains(F.split(F.try_element_at(may, F.col("stage")), ","), F.col("to"))
    unproven = F.array_except("expected", F.map_keys("receipts"))
    refused = (
        F.when(F.col("stage").isNull(), "unknown case")
        .when(~F.coalesce(follows, F.lit(False)), F.concat(F.col("stage"), F.lit(" cannot become "), F.col("to")))
        .when((F.col("to") == "verified") & (F.size(unproven) > 0), F.concat(F.lit("targets without a receipt: "), F.array_join(F.array_sort(unproven), ", ")))
    )
    return asked.join(cases, "case_id", "left").withColumn("refused", refused)


class CaseTable:
    """Requests to make sources vanish: their stages, and a receipt of every target that proved it."""

    def __init__(self, spark: SparkSession, folder: str):
        schema = _strings("case_id", "source", "stage", expected=ArrayType(StringType()), receipts=MapType(StringType(), StringType()))
        self._table = LakeTable(spark, folder, schema, ["case_id"])
        self._table.prepare()

    def cases(self) -> DataFrame:
        return self._table.read()

    def open(self, cases: DataFrame) -> None:
        """New cases (case_id, source, expected) as received; known ones stay as they are."""
        new = cases.dropDuplicates(["case_id"]).join(self.cases().select("case_id"), "case_id", "left_anti")
        self._table.apply(new.select("case_id", "source", F.lit("received").alias("stage"), F.coalesce("expected", F.array().cast("array<string>")).alias("expected"), F.create_map().cast("map<string,string>").alias("receipts"), F.lit("insert").alias("action")))

    def advance(self, requests: DataFrame) -> list[tuple[str, str]]:
        """Moves cases on; (case_id, why) of the first hundred requests that were refused."""
        asked = advance(self.cases(), requests)
        refused = [(r["case_id"], r["refused"]) for r in asked.where("refused is not null").orderBy("case_id").limit(100).collect()]
        self._table.apply(asked.where("refused is null").select("case_id", "source", F.col("to").alias("stage"), "expected", "receipts", F.lit("replace").alias("action")))
        return refused

    def receive(self, receipts: DataFrame) -> None:
        """Adds receipts (case_id, target, proof); a newer proof of a target replaces the older one, unknown cases are ignored."""
        each = receipts.groupBy("case_id", "target").agg(F.max("proof").alias("proof")).groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("target", "proof"))).alias("new"))
        old = F.map_filter("receipts", lambda k, v: ~F.map_contains_key(F.col("new"), k))
        self._table.apply(self.cases().join(each, "case_id").select("case_id", "source", "stage", "expected", F.map_concat(old, "new").alias("receipts"), F.lit("replace").alias("action")))
