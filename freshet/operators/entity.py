"""Names that mean the same: similarity, components, and a greedy choice of canonical names in each.

Pairs of similar names come from blocks of vectors multiplied with blocks, each pair of
blocks in one task; a task returns the pairs above the threshold only. Each component is
then resolved in order of names by a function that decides which candidate a name matches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.operators.graph import connected

PINNED, PREFERRED = "pinned", "preferred"
BLOCK_ROWS = 8_192  # vectors of a block
_TILE = 256  # rows of a block compared at once


def similar_pairs(vectors: DataFrame, max_distance: float = 0.3, name: str = "name", vector: str = "embedding", blocks: int | None = None) -> DataFrame:
    """(a, b, similarity) of names a < b whose cosine is 1 - max_distance or more; rows with a null or zero vector have none. A task holds two blocks, of BLOCK_ROWS rows on average unless `blocks` is given."""
    if blocks is None:
        blocks = max(4, -(-vectors.count() // BLOCK_ROWS))
    own = vectors.select(F.col(name).alias("name"), F.col(vector).alias("v"), F.pmod(F.xxhash64(name), F.lit(blocks)).cast("int").alias("block")).where("v is not null")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = own.withColumn("other", other).select("name", "v", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    kind = own.schema["name"].dataType.simpleString()

    def compare(key, table):
        bi, bj = (k.as_py() for k in key)
        names, block = table["name"].to_numpy(), table["block"].to_numpy()
        v = table["v"].combine_chunks()
        if pc.count_distinct(pc.list_value_length(v)).as_py() != 1:
            raise ValueError("vectors of different lengths")
        m = v.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(v), -1)  # no Python object a number
        size = np.linalg.norm(m, axis=1, keepdims=True)
        m = np.divide(m, size, out=np.zeros_like(m), where=size > 0)
        left, right = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
        found = []
        for lo in range(0, len(left), _TILE):
            sim = m[left[lo : lo + _TILE]] @ m[right].T
            i, j = np.nonzero(sim >= np.float32(1 - max_distance))
            found.append((left[lo + i], right[j], sim[i, j]))
        i, j, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (left, left, np.zeros(0, np.float32))
        a, b = names[i], names[j]
        keep = a < b if bi == bj else a != b
        a, b, s = a[keep], b[keep], s[keep]
        return pa.table({"a": pa.array(np.where(a < b, a, b), table.schema.field("name").type), "b": pa.array(np.where(a < b, b, a), table.schema.field("name").type), "similarity": pa.array(s.astype(np.float64))})

    return dealt.groupBy("bi", "bj").applyInArrow(compare, f"a {kind}, b {kind}, similarity double")


@dataclass(frozen=True)
class Resolution:
    """Which candidate a name matches (None: none of them), and whether the new name becomes the canonical one."""

    matched: str | None
    new_wins: bool = False


def resolve_component(names: list[str], vectors: np.ndarray, existing: set[str], resolve: Callable[[str, list[str]], Resolution], policy: str = PINNED, max_distance: float = 0.3, top_n: int = 5) -> dict[str, str | None]:
    """Name -> parent (None: canonical) of one component, names in order; under PINNED existing names come first and stay canonical."""
    at = {n: i for i, n in enumerate(names)}
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)
    parent: dict[str, str | None] = {}

    def root(n: str) -> str:
        while parent[n] is not None:
            n = parent[n]
        return n

    order = sorted(names) if policy != PINNED else sorted(names, key=lambda n: (n not in existing, n))
    for n in order:
        if policy == PINNED and n in existing:
            parent[n] = None
            continue
        seen = list(parent)
        sims = unit[[at[s] for s in seen]] @ unit[at[n]] if seen else np.zeros(0, np.float32)
        candidates: list[str] = []
        for k in sorted(range(len(seen)), key=lambda k: (-float(sims[k]), seen[k])):
            if sims[k] < np.float32(1 - max_distance) or len(candidates) == top_n:
                break
            if (r := root(seen[k])) not in candidates:
                candidates.append(r)
        parent[n] = None
        if not candidates:
            continue
        answer = resolve(n, candidates)
        if answer.matched is None:
            continue
        if answer.matched not in candidates:
            raise ValueError(f"{answer.matched!r} is no candidate for {n!r}")
        wins = answer.new_wins and not (policy == PINNED and answer.matched in existing)
        if policy == PREFERRED and (n in existing) != (answer.matched in existing):
            wins = n in existing
        if wins:
            parent[answer.matched] = n
        else:
            parent[n] = answer.matched
    return parent


def resolve_entities(entities: DataFrame, resolve: Callable[[str, list[str]], Resolution], *, name: str = "name", vector: str = "embedding", existing: str | None = None, policy: str = PINNED, max_distance: float = 0.3, top_n: int = 5, blocks: int | None = None) -> DataFrame:
    """(name, parent, canonical) of every distinct name; a component of similar names is one task's work, as the choice depends on the order.

    `existing` is a boolean column of names that are canonical already.
    """
    flag = F.lit(False) if existing is None else F.coalesce(F.col(existing), F.lit(False))
    own = entities.select(F.col(name).alias("name"), F.col(vector).alias("v"), flag.alias("existing")).where("name is not null").groupBy("name").agg(F.first("v").alias("v"), F.max("existing").alias("existing"))
    pairs = similar_pairs(own, max_distance, "name", "v", blocks)
    roots = connected(pairs.select("a", "b"))
    grouped = own.join(roots, own.name == roots.node, "left").select("name", "v", "existing", F.coalesce("root", "name").alias("component"))
    kind = own.schema["name"].dataType.simpleString()

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        names = pdf["name"].tolist()
        vectors = np.array([np.zeros(1) if v is None else v for v in pdf["v"]], np.float32) if len(names) > 1 else np.zeros((1, 1), np.float32)
        parent = resolve_component(names, vectors, set(pdf.loc[pdf["existing"], "name"]), resolve, policy, max_distance, top_n)

        def root(n):
            while parent[n] is not None:
                n = parent[n]
            return n

        return pd.DataFrame({"name": names, "parent": [parent[n] for n in names], "canonical": [root(n) for n in names]})

    return grouped.groupBy("component").applyInPandas(work, f"name {kind}, parent {kind}, canonical {kind}")


def groups(resolved: DataFrame) -> DataFrame:
    """(canonical, names) of every group."""
    return resolved.groupBy("canonical").agg(F.array_sort(F.collect_set("name")).alias("names"))


def canonicals(resolved: DataFrame) -> DataFrame:
    return resolved.where("parent is null").select("name")


def first_candidate(name: str, candidates: list[str]) -> Resolution:
    """The nearest candidate is the match: for vectors that are to be trusted."""
    return Resolution(candidates[0])


def hash_embedder(dimensions: int = 64, n: int = 3) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
    """A pandas UDF body that embeds texts by hashed character n-grams: deterministic, no model."""

    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import zlib

        for texts in batches:
            out = []
            for t in texts:
                v = np.zeros(dimensions, np.float32)
                padded = f" {(t or '').lower()} "
                for i in range(max(0, len(padded) - n + 1)):
                    h = zlib.crc32(padded[i : i + n].encode())
                    v[h % dimensions] += 1 if h & 0x80000000 else -1
                size = np.linalg.norm(v)
                out.append((v / size if size else v).tolist())
            yield pd.Series(out)

    return embed
