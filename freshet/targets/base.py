"""The contract of targets: a container that is made ready, rows that are reconciled, actions that are applied in batches."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum
from typing import Protocol

from pyspark.sql import DataFrame


class ManagedBy(Enum):
    """Whether this library makes and removes a container, or its user does."""

    SYSTEM = "system"
    USER = "user"


@dataclass(frozen=True)
class Capabilities:
    """What a sink promises: that repeating a batch changes nothing, that batches keep their order, that a batch is applied whole."""

    idempotent: bool = True
    ordered: bool = False
    atomic: bool = False


class Target(Protocol):
    """`keys` and `values` name the columns; actions have those and `action` (insert, upsert, replace, update, create or delete)."""

    keys: list[str]
    values: list[str]
    capabilities: Capabilities

    def prepare(self) -> None: ...

    def apply(self, actions: DataFrame) -> None: ...

    def drop(self) -> None: ...


WRITES = ("insert", "upsert", "replace", "update", "create")


def certify(target, first: DataFrame, read) -> dict[str, bool]:
    """Runs a batch twice and then deletes it; which promises held. `read()` returns the target's rows."""
    from pyspark.sql import functions as F

    target.prepare()
    rows = lambda: sorted(map(tuple, read().select(*target.keys, *target.values).collect()), key=repr)
    target.apply(first)
    once = rows()
    target.apply(first)
    twice = rows()
    target.apply(first.withColumn("action", F.lit("delete")))
    return {"written": len(once) == first.count(), "idempotent": once == twice, "deleted": rows() == []}
