"""Rows of databases: statements by dialect, and batched writes from the executors."""

from __future__ import annotations

import sqlite3
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from freshet.schema import evolve, require_identifier, store_type
from freshet.targets.base import WRITES, Capabilities, ManagedBy

_QUOTE = {"postgres": '"', "sqlite": '"', "snowflake": '"', "bigquery": "`", "doris": "`"}
_BIND_LIMIT = {"postgres": 32_767, "sqlite": 32_766, "snowflake": 16_384, "bigquery": 10_000, "doris": 65_535}


@dataclass(frozen=True)
class Dialect:
    """How a store writes names, types and statements."""

    name: str

    def quoted(self, identifier: str) -> str:
        q = _QUOTE[self.name]
        return ".".join(f"{q}{require_identifier(p)}{q}" for p in identifier.split("."))

    def create_table(self, table: str, schema: StructType, keys: list[str]) -> str:
        cols = [f"{self.quoted(f.name)} {store_type(f, self.name)}{' NOT NULL' if f.name in keys else ''}" for f in schema.fields]
        names = ", ".join(map(self.quoted, keys))
        if self.name == "doris":
            return f"CREATE TABLE IF NOT EXISTS {self.quoted(table)} ({', '.join(cols)}) UNIQUE KEY ({names}) DISTRIBUTED BY HASH ({names})"
        if self.name == "bigquery":
            return f"CREATE TABLE IF NOT EXISTS {self.quoted(table)} ({', '.join(cols)}, PRIMARY KEY ({names}) NOT ENFORCED)"
        return f"CREATE TABLE IF NOT EXISTS {self.quoted(table)} ({', '.join(cols)}, PRIMARY KEY ({names}))"

    def alter_table(self, table: str, old: StructType, new: StructType, keys: list[str]) -> list[str]:
        """Statements that bring a table to a new schema; a new primary key makes it anew."""
        change = evolve(old, new)
        if change["recreate"]:
            return [f"DROP TABLE IF EXISTS {self.quoted(table)}", self.create_table(table, new, keys)]
        out = [f"ALTER TABLE {self.quoted(table)} DROP COLUMN {self.quoted(c)}" for c in change["dropped"] + change["altered"]]
        return out + [f"ALTER TABLE {self.quoted(table)} ADD COLUMN {self.quoted(c)} {store_type(new[c], self.name)}" for c in change["added"] + change["altered"]]

    def upsert(self, table: str, keys: list[str], values: list[str], rows: int = 1, mark: str = "?") -> str:
        names = ", ".join(map(self.quoted, keys + values))
        tuples = ", ".join("(" + ", ".join([mark] * (len(keys) + len(values))) + ")" for _ in range(rows))
        if self.name in ("postgres", "sqlite"):
            sets = ", ".join(f"{self.quoted(v)} = excluded.{self.quoted(v)}" for v in values)
            return f"INSERT INTO {self.quoted(table)} ({names}) VALUES {tuples} ON CONFLICT ({', '.join(map(self.quoted, keys))}) DO " + (f"UPDATE SET {sets}" if values else "NOTHING")
        if self.name == "doris":  # a unique-key table replaces by itself
            return f"INSERT INTO {self.quoted(table)} ({names}) VALUES {tuples}"
        source = " UNION ALL ".join("SELECT " + ", ".join(f"{mark} AS {self.quoted(c)}" for c in keys + values) for _ in range(rows))
        on = " AND ".join(f"t.{self.quoted(k)} = s.{self.quoted(k)}" for k in keys)
        matched = f" WHEN MATCHED THEN UPDATE SET {', '.join(f'{self.quoted(v)} = s.{self.quoted(v)}' for v in values)}" if values else ""
        return f"MERGE INTO {self.quoted(table)} t USING ({source}) s ON {on}{matched} WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({', '.join(f's.{self.quoted(c)}' for c in keys + values)})"

    def delete(self, table: str, keys: list[str], mark: str = "?") -> str:
        return f"DELETE FROM {self.quoted(table)} WHERE " + " AND ".join(f"{self.quoted(k)} = {mark}" for k in keys)

    def vector_index(self, table: str, column: str, metric: str = "cosine", method: str = "hnsw", **options: int) -> str:
        """An index for nearest neighbours in postgres: ivfflat (lists) or hnsw (m, ef_construction)."""
        ops = {"cosine": "vector_cosine_ops", "l2": "vector_l2_ops", "ip": "vector_ip_ops"}[metric]
        extra = f" WITH ({', '.join(f'{k} = {int(v)}' for k, v in sorted(options.items()))})" if options else ""
        return f"CREATE INDEX IF NOT EXISTS {self.quoted(f'{table}_{column}_{metric}')} ON {self.quoted(table)} USING {require_identifier(method)} ({self.quoted(column)} {ops}){extra}"


def vector_search_sql(table: str, column: str, vector: list[float], metric: str, limit: int, select: list[str], where: str | None = None) -> str:
    """A top-k query for a store: distances ascending, inner product descending, other names ascending if they say distance."""
    call = {"l2": "l2_distance", "inner_product": "inner_product", "cosine": "cosine_distance"}.get(metric, metric)
    order = "DESC" if metric == "inner_product" or (metric not in ("l2", "cosine") and "distance" not in metric) else "ASC"
    shown = ", ".join(require_identifier(c) for c in select)
    return f"SELECT {shown}, {call}({require_identifier(column)}, [{', '.join(repr(float(x)) for x in vector)}]) AS score FROM {require_identifier(table)}" + (f" WHERE {where}" if where else "") + f" ORDER BY score {order} LIMIT {int(limit)}"


class DatabaseTable:
    """A table behind a Python database driver. `connect` is called in each task; a task is one transaction, and chunks keep to the store's number of parameters."""

    capabilities = Capabilities(idempotent=True, ordered=False, atomic=False)

    def __init__(self, connect: Callable[[], object], dialect: str, table: str, schema: StructType, keys: list[str], *, managed_by: ManagedBy = ManagedBy.SYSTEM, attachments: tuple[tuple[str, str], ...] = ()):
        self.connect, self.dialect, self.table, self.schema, self.keys, self.managed_by, self.attachments = connect, Dialect(dialect), table, schema, keys, managed_by, attachments
        self.values = [n for n in schema.names if n not in keys]

    def _run(self, *statements: str) -> None:
        db = self.connect()
        try:
            for s in statements:
                db.cursor().execute(s)
            db.commit()
        finally:
            db.close()

    def prepare(self) -> None:
        """Makes the table, then the attachments' (setup, teardown) statements, which must be repeatable."""
        if self.managed_by is ManagedBy.SYSTEM:
            self._run(self.dialect.create_table(self.table, self.schema, self.keys), *[setup for setup, _ in self.attachments])

    def drop(self) -> None:
        if self.managed_by is ManagedBy.SYSTEM:
            self._run(*[teardown for _, teardown in self.attachments if teardown], f"DROP TABLE IF EXISTS {self.dialect.quoted(self.table)}")

    def apply(self, actions: DataFrame) -> None:
        connect, dialect, table, keys, values = self.connect, self.dialect, self.table, self.keys, self.values
        most = max(1, _BIND_LIMIT[dialect.name] // len(keys + values))

        def write(rows: Iterator) -> None:
            rows, db = iter(rows), None
            try:
                while chunk := list(islice(rows, min(most, 500))):
                    db = db or connect()
                    cursor = db.cursor()
                    puts = [[r[c].replace("\0", "") if isinstance(r[c], str) else r[c] for c in keys + values] for r in chunk if r["action"] in WRITES]
                    if puts:
                        cursor.execute(dialect.upsert(table, keys, values, len(puts)), [v for p in puts for v in p])
                    for r in chunk:
                        if r["action"] == "delete":
                            cursor.execute(dialect.delete(table, keys), [r[k] for k in keys])
                if db:
                    db.commit()
            finally:
                if db:
                    db.close()

        actions.where("action not in ('none', 'unchanged')").select(*keys, *values, "action").foreachPartition(write)


def sqlite_connector(path: str) -> Callable[[], sqlite3.Connection]:
    return lambda: sqlite3.connect(path, timeout=60)
