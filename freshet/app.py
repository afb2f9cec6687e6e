"""A named pipeline: declares desired tables, writes only what changed, and can be previewed, reprocessed and dropped."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions.hashing import canonical, fingerprint
from freshet.operators.ledger import Ledger
from freshet.operators.reconcile import decide

#: What was to be written (settled: was written) to a key in a run; no fingerprint: the key was deleted.
_EVENT = "key string, fp string, settled boolean, generation bigint, payload string"
_MOST_PARTS = 24  # of a target's events, before they are settled into one


def states(events: DataFrame) -> DataFrame:
    """(key, candidates, settled_fp, doubtful, payload) of every key: the fingerprints that its row may have, from what was settled last and what was begun since."""
    g = F.when(F.col("settled"), F.col("generation"))
    last = events.groupBy("key").agg(F.coalesce(F.max(g), F.lit(0)).alias("g"), F.max_by("fp", g).alias("settled_fp"), F.max("payload").alias("payload"), F.collect_list(F.when(~F.col("settled"), F.struct("generation", "fp"))).alias("begun"))
    since = last.withColumn("begun", F.filter("begun", lambda b: b["generation"] > F.col("g")))
    candidates = F.array_compact(F.array_append(F.transform("begun", lambda b: b["fp"]), F.col("settled_fp")))
    return since.select("key", candidates.alias("candidates"), "settled_fp", (F.size("begun") > 0).alias("doubtful"), "payload").where("doubtful or settled_fp is not null")


@dataclass
class UpdateResult:
    """Numbers of actions by target and kind of one run, and the ledger's version after it."""

    counts: dict[str, dict[str, int]]
    version: int

    def total(self) -> int:
        return sum(n for c in self.counts.values() for n in c.values())


@dataclass
class App:
    """`pipeline(spark)` returns the desired table of every target by name; `targets` are sinks with keys and values.

    The ledger remembers what was written, as events by target: before a batch is applied it
    notes what is begun, after it what is settled. A run that dies in between leaves keys in
    doubt, and the next run writes them again. A run adds events of the keys that it changes
    only, and one whose desired rows have the digest of the last settled run reads nothing
    else. The digest is 128 bits and a count, of keys and values in any order.
    """

    spark: SparkSession
    name: str
    folder: str
    pipeline: Callable[[SparkSession], dict[str, DataFrame]]
    targets: dict[str, object]
    on_error: Callable[[str, Exception], None] | None = None
    _context: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.ledger = Ledger(self.spark, f"{self.folder.rstrip('/')}/{self.name}")

    def provide(self, key: str, value) -> None:
        """A value that pipelines read by use(); changing it is no change of theirs."""
        self._context[key] = value

    def use(self, key: str):
        return self._context[key]

    def _own(self, name: str, desired: DataFrame) -> DataFrame:
        target = self.targets[name]
        return desired.select(canonical(*target.keys).alias("key"), fingerprint(*target.values).alias("fp"), F.struct(*target.keys, *target.values).alias("row"))

    def _digest(self, name: str, desired: DataFrame) -> str:
        target = self.targets[name]
        each = canonical(*target.keys, *target.values)
        found = desired.select(F.xxhash64(each).alias("a"), F.xxhash64(F.lit("digest"), each).alias("b")).agg(F.count("*"), F.bit_xor("a"), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        return ":".join(map(str, found))

    def _actions(self, name: str, desired: DataFrame, full: bool) -> DataFrame:
        """What is to be done: (__key, __fp, action, keys, values), nothing for rows that are as they should be."""
        target = self.targets[name]
        own = self._own(name, desired)
        before = states(self.ledger.read(f"tracked-{name}", _EVENT))
        joined = own.join(before, "key", "full_outer").withColumn("__old", F.from_json("payload", desired.select(*target.keys).schema))
        n = F.coalesce(F.size("candidates"), F.lit(0))
        equal = F.coalesce(F.forall("candidates", lambda c: c == F.col("fp")), F.lit(True))
        action = decide(F.col("row").isNotNull(), n, equal, F.coalesce("doubtful", F.lit(True)) | F.lit(full))
        cols = [F.coalesce(F.col(f"row.{k}"), F.col(f"__old.{k}")).alias(k) for k in target.keys] + [F.col(f"row.{v}").alias(v) for v in target.values]
        return joined.select(F.col("key").alias("__key"), F.col("fp").alias("__fp"), action.alias("action"), *cols).where("action <> 'none'")

    def preview(self, full_reprocess: bool = False) -> dict[str, DataFrame]:
        """The actions that update() would apply, by target."""
        return {n: self._actions(n, d, full_reprocess).drop("__key", "__fp") for n, d in self.pipeline(self.spark).items()}

    def update(self, full_reprocess: bool = False) -> UpdateResult:
        """One run. Targets that the pipeline no longer returns lose all their rows."""
        desired = self.pipeline(self.spark)
        counts: dict[str, dict[str, int]] = {}
        for name in self._tracked():
            if name not in desired and name in self.targets:
                desired[name] = self.spark.createDataFrame([], desired_schema(self.targets[name]))
        for name, frame in desired.items():
            target = self.targets[name]
            target.prepare()
            digest = self._digest(name, frame)
            counts[name] = {}
            if not full_reprocess and self.ledger.note(f"digest-{name}") == digest:
                continue
            found = self._actions(name, frame, full_reprocess)
            version = self.ledger.commit(notes={f"digest-{name}": ""}, **{f"pending-{name}": found})
            actions = self.ledger.read(f"pending-{name}", found.schema)
            counts[name] = {r["action"]: r["count"] for r in actions.groupBy("action").count().collect()}
            if not counts[name]:
                self.ledger.commit(notes={f"digest-{name}": digest})
                continue
            payload = F.to_json(F.struct(*target.keys), {"ignoreNullFields": "false"})
            fp = F.when(F.col("action") != "delete", F.col("__fp"))
            events = actions.select(F.col("__key").alias("key"), fp.alias("fp"), F.lit(False).alias("settled"), F.lit(version).cast("bigint").alias("generation"), payload.alias("payload"))
            self.ledger.commit(add={f"tracked-{name}": events})
            try:
                target.apply(actions.drop("__key", "__fp"))
            except Exception as error:
                if self.on_error:
                    self.on_error(name, error)
                    continue
                raise
            self.ledger.commit(notes={f"digest-{name}": digest}, add={f"tracked-{name}": events.withColumn("settled", F.lit(True))})
            self._settle(name)
        self.ledger.prune(3)
        return UpdateResult(counts, self.ledger.version)

    def live(self, changes: DataFrame, checkpoint: str, trigger: str | None = None):
        """A streaming query that makes a run whenever `changes`, a stream of any kind, brings rows: at once, or at most every `trigger` ("10 seconds").

        The pipeline reads its sources itself; the stream says when. A run that fails is made
        again when the query is started again with the same checkpoint.
        """

        def run(batch: DataFrame, _: int) -> None:
            if batch.limit(1).count():
                self.update()

        writer = changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()

    def _tracked(self) -> list[str]:
        return [t.removeprefix("tracked-") for t in self.ledger.tables() if t.startswith("tracked-")]

    def _settle(self, name: str) -> None:
        """Makes one part of a target's events when there are many."""
        if len(self.ledger.tables()[f"tracked-{name}"]) < _MOST_PARTS:
            return
        events = self.ledger.read(f"tracked-{name}", _EVENT)
        now = states(events).where("not doubtful").select("key", F.col("settled_fp").alias("fp"), F.lit(True).alias("settled"), F.lit(self.ledger.version).cast("bigint").alias("generation"), "payload")
        self.ledger.commit(**{f"tracked-{name}": now})

    def drop(self) -> None:
        """Removes what all targets hold, and the ledger."""
        for target in self.targets.values():
            target.drop()
        self.ledger.drop()

    def stats(self) -> DataFrame:
        """(target, rows) that the ledger tracks."""
        out = self.spark.createDataFrame([], "target string, rows bigint")
        for name in self._tracked():
            out = out.unionByName(states(self.ledger.read(f"tracked-{name}", _EVENT)).agg(F.lit(name).alias("target"), F.count("*").alias("rows")).where("rows > 0"))
        return out


def desired_schema(target) -> str:
    schema = getattr(target, "schema", None)
    return schema if schema is not None else ", ".join(f"`{c}` string" for c in target.keys + target.values)
