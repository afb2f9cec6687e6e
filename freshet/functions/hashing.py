"""Fingerprints and digests of rows and sets of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(*cols: str | Column) -> Column:
    """A row's columns as JSON, named by position, nulls kept: equal rows, equal text."""
    return F.to_json(F.struct(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(f"c{i}") for i, c in enumerate(cols)]), {"ignoreNullFields": "false"})


def fingerprint(*cols: str | Column) -> Column:
    """256 bits of a row's columns, as hexadecimal text."""
    return F.sha2(canonical(*cols), 256)


def fingerprint_text(text: str | Column) -> Column:
    return F.sha2(text, 256)


def fingerprint_bytes(data: str | Column) -> Column:
    return F.sha2(data, 256)


def stable_key(*parts: Column | str, kinds: list[str]) -> Column:
    """A composite key as typed text: 1, "1" and true never meet. kinds: s, i, b, y (bytes), u (uuid), n (null) for each part."""
    shown = []
    for p, kind in zip(parts, kinds, strict=True):
        c = F.col(p) if isinstance(p, str) else p
        shown.append(F.coalesce(F.concat(F.lit(kind + ":"), F.hex(c) if kind == "y" else c.cast("string")), F.lit("n:")))
    return F.to_json(F.array(*shown))


def set_digest(digest: str | Column) -> Column:
    """Aggregate: one digest of a group's digests, whatever their order. A row per member is gathered; use tree_digest for large groups."""
    return F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(digest))), 256)


def tree_digest(df, group: list[str], digest: str, digits: int = 3, levels: int = 1):
    """Digest per group of any size: members are dealt by the first hexadecimal digits of their own digests, each deal is digested, then the deals' digests in order.

    With more `levels` members are first dealt by that many times `digits`, and deals are
    digested together by `digits` fewer each time: two levels of 3 digits hold a deal of a
    group of 10^12 members to some 60,000. The digest depends on digits and levels, not on
    what else is in the table.
    """
    leaves = df.groupBy(*group, F.substring(digest, 1, digits * levels).alias("__deal")).agg(set_digest(digest).alias("__leaf"))
    for left in reversed(range(levels)):
        ordered = F.array_sort(F.collect_list(F.struct("__deal", "__leaf")))
        folded = F.sha2(F.concat_ws("\n", F.transform(ordered, lambda x: x["__leaf"])), 256).alias("__leaf")
        leaves = leaves.groupBy(*group, F.substring("__deal", 1, digits * left).alias("__deal")).agg(folded) if left else leaves.groupBy(*group).agg(folded)
    return leaves.withColumnRenamed("__leaf", "digest")


def fnv1a64(data: bytes) -> int:
    """The 64-bit FNV-1a hash."""
    h = 0xCBF29CE484222325  # fixed values of the published hash
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h
