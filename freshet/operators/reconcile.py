"""What to write so that a target becomes as desired: comparisons of desired and previous states.

All of them are full outer joins on the key in disguise; none gathers a key's neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions.hashing import fingerprint

ACTIONS = ("insert", "upsert", "replace", "delete", "none")


def decide(present: Column, candidates: Column, equal: Column, missing: Column) -> Column:
    """The action for a key, from whether it is desired, how many possible previous states it has, whether all equal the desired one, and whether it may be missing."""
    return (
        F.when(~present & (candidates == 0), F.lit("none"))
        .when(~present, F.lit("delete"))
        .when(~equal, F.lit("replace"))
        .when(~missing, F.lit("none"))
        .when(candidates == 0, F.lit("insert"))
        .otherwise(F.lit("upsert"))
    )


def diff(desired: DataFrame, previous: DataFrame, keys: list[str], full_reprocess: bool = False) -> DataFrame:
    """(keys, action, fp): `desired` has keys and fp, once a key; `previous` has keys, fp and may_be_missing, a row for each possible state.

    A key without any previous row counts as missing: a new key is an insert. Null keys meet
    each other.
    """
    prev = previous.groupBy(*keys).agg(F.count("fp").alias("__n"), F.min("fp").alias("__lo"), F.max("fp").alias("__hi"), F.max("may_be_missing").alias("__missing"))
    d, p = desired.select(*keys, "fp", F.lit(True).alias("__in")).alias("d"), prev.alias("p")
    on = [F.col(f"d.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys]
    joined = d.join(p, on, "full_outer")
    n = F.coalesce("p.__n", F.lit(0))
    equal = (n == 0) | ((F.col("p.__lo") == F.col("d.fp")) & (F.col("p.__hi") == F.col("d.fp")))
    missing = F.coalesce("p.__missing", F.lit(True)) | F.lit(full_reprocess)
    action = decide(F.coalesce("d.__in", F.lit(False)), n, F.coalesce(equal, F.lit(False)), missing)
    return joined.select(*[F.coalesce(f"d.{k}", f"p.{k}").alias(k) for k in keys], action.alias("action"), F.col("d.fp").alias("fp"))


def diff_tables(desired: DataFrame, current: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """All desired columns and `action` (create, update, unchanged or delete) of two plain tables with a row per key."""
    d = desired.select(*keys, *values, fingerprint(*values).alias("__fp")).alias("d")
    c = current.select(*keys, fingerprint(*values).alias("__fp"), F.lit(True).alias("__in")).alias("c")
    joined = d.join(c, [F.col(f"d.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys], "full_outer")
    action = F.when(F.col("c.__in").isNull(), "create").when(F.col("d.__fp").isNull(), "delete").when(F.col("d.__fp") == F.col("c.__fp"), "unchanged").otherwise("update")
    return joined.select(*[F.coalesce(f"d.{k}", f"c.{k}").alias(k) for k in keys], *[f"d.{v}" for v in values], action.alias("action"))


def diff_composite(main: DataFrame, sub_desired: DataFrame, sub_previous: DataFrame, keys: list[str], sub_key: str) -> DataFrame:
    """(keys, sub_key, action): transitions of the parts of composite records.

    `main` has keys, action, candidates (number of possible previous records) and missing;
    `sub_desired` has keys, sub_key and fp; `sub_previous` the same, a row per candidate that
    has the part. A part may be missing if its record may be, if the record is replaced or
    deleted, or if fewer candidates have the part than there are. A deleted record's parts
    go with it: no row.
    """
    every = [*keys, sub_key]
    prev = sub_previous.groupBy(*every).agg(F.count("*").alias("__n"), F.min("fp").alias("__lo"), F.max("fp").alias("__hi"))
    both = sub_desired.select(*every, "fp").join(prev, every, "full_outer").join(main.select(*keys, F.col("action").alias("__main"), "candidates", "missing"), keys)
    n = F.coalesce("__n", F.lit(0))
    missing = F.col("missing") | F.col("__main").isin("replace", "delete") | (n < F.col("candidates"))
    equal = (n == 0) | ((F.col("__lo") == F.col("fp")) & (F.col("__hi") == F.col("fp")))
    action = decide(F.col("fp").isNotNull(), n, F.coalesce(equal, F.lit(False)), missing)
    return both.where("__main <> 'delete'").select(*every, action.alias("action"))


def system_managed(desired: DataFrame, previous: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides without what users manage: desired rows of theirs, keys that only they had, and their previous rows. Both have managed_by."""
    theirs = desired.where("managed_by = 'user'").select(*keys).distinct()
    had = previous.where("managed_by = 'user'").select(*keys).join(desired.select(*keys), keys, "left_anti").distinct()
    prev = previous.where("managed_by = 'system'").join(theirs, keys, "left_anti").join(had, keys, "left_anti")
    return desired.where("managed_by = 'system'"), prev


def transfer_ownership(ledger: DataFrame, declared: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, old_owner, owner, transferred): the last declarer (greatest seq, then greatest owner) owns a key; a key that only changes owner is not written anew."""
    last = declared.groupBy(*keys).agg(F.max_by("owner", F.struct("seq", "owner")).alias("owner"))
    old = ledger.select(*keys, F.col("owner").alias("old_owner"))
    return last.join(old, keys, "left").select(*keys, "old_owner", "owner", (F.col("old_owner").isNotNull() & (F.col("old_owner") != F.col("owner"))).alias("transferred"))


def orphans(ledger: DataFrame, alive: DataFrame, owner: str = "owner") -> DataFrame:
    """Ledger rows of owners that are not alive in this run."""
    return ledger.join(alive.select(owner).distinct(), owner, "left_anti")


def invalidate_children(children: DataFrame, containers: DataFrame, container: str) -> DataFrame:
    """Children with `stale`: whether their container was made anew (another generation) since they were written, so that they count as missing."""
    now = containers.select(container, F.col("generation").alias("__now"))
    return children.join(now, container, "left").withColumn("stale", ~F.col("generation").eqNullSafe(F.col("__now"))).drop("__now")


def apply_actions(current: DataFrame, actions: DataFrame, keys: list[str], values: list[str], action: str = "action") -> DataFrame:
    """The table after the actions: rows untouched, and those created, updated, inserted, upserted or replaced."""
    touched = actions.where(~F.col(action).isin("none", "unchanged"))
    kept = current.join(touched.select(*keys), keys, "left_anti").select(*keys, *values)
    return kept.unionByName(touched.where(F.col(action) != "delete").select(*keys, *values))


def preview(actions: DataFrame, *by: str) -> DataFrame:
    """Numbers of actions, without applying any."""
    return actions.groupBy(*by, "action").agg(F.count("*").alias("n"))
