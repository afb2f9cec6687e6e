"""Comparison of an index with its source: which items are missing, orphaned, stale, doubled or cannot be judged.

Facts are rows of (identity, item, part, revision, content); a side's snapshot may be
consistent or not. Everything is counted by one aggregation a side and one join on the
identity; hot identities are counted, not gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _sides(source: DataFrame, target: DataFrame, minimum_targets: int) -> DataFrame:
    s = source.groupBy("identity").agg(F.count("*").alias("s_n"), F.max("revision").alias("s_rev"), F.max("content").alias("s_content"))
    one = source.groupBy("identity").agg(F.max("revision").alias("__rev"), F.max("content").alias("__content"))
    t = target.join(one, "identity", "left").groupBy("identity").agg(
        F.count("*").alias("t_n"),
        F.count_if((F.col("revision") != F.col("__rev")) | (F.col("content") != F.col("__content"))).alias("differ"),
        F.count_if((F.col("revision").isNull() & F.col("__rev").isNotNull()) | (F.col("content").isNull() & F.col("__content").isNotNull())).alias("unknown"),
    )
    parts = target.where("part is not null").groupBy("identity", "part").agg(F.count("*").alias("n")).where("n > 1").groupBy("identity").agg(F.count("*").alias("dup_parts"))
    return s.join(t, "identity", "full_outer").join(parts, "identity", "left").fillna(0, ["s_n", "t_n", "differ", "unknown", "dup_parts"]).withColumn("minimum", F.lit(minimum_targets))


def findings(source: DataFrame, target: DataFrame, minimum_targets: int = 1) -> DataFrame:
    """(identity, finding, side), one row for each rule that an identity breaks.

    duplicate: a source identity, or a target part of it, more than once; ambiguous: a
    doubled source, or a revision or content that cannot be compared; orphan: in the target
    without a source; missing: fewer target rows than the minimum; stale: a target revision
    or content that differs from its one source.
    """
    both = _sides(source, target, minimum_targets)
    single = F.col("s_n") == 1
    rules = F.array_compact(
        F.array(
            F.when(F.col("s_n") > 1, F.struct(F.lit("duplicate").alias("finding"), F.lit("source").alias("side"))),
            F.when(F.col("s_n") > 1, F.struct(F.lit("ambiguous").alias("finding"), F.lit("source").alias("side"))),
            F.when(F.col("dup_parts") > 0, F.struct(F.lit("duplicate").alias("finding"), F.lit("target").alias("side"))),
            F.when(F.col("s_n") == 0, F.struct(F.lit("orphan").alias("finding"), F.lit("target").alias("side"))),
            F.when((F.col("s_n") > 0) & (F.col("t_n") < F.col("minimum")), F.struct(F.lit("missing").alias("finding"), F.lit("source").alias("side"))),
            F.when(single & (F.col("differ") > 0), F.struct(F.lit("stale").alias("finding"), F.lit("target").alias("side"))),
            F.when(single & (F.col("differ") == 0) & (F.col("unknown") > 0), F.struct(F.lit("ambiguous").alias("finding"), F.lit("target").alias("side"))),
        )
    )
    return both.select("identity", F.explode(rules).alias("r")).select("identity", "r.finding", "r.side")


def healthy(source: DataFrame, target: DataFrame, minimum_targets: int = 1) -> DataFrame:
    """(source_items, target_items, healthy_sources): sources without any finding."""
    both = _sides(source, target, minimum_targets)
    good = (F.col("s_n") == 1) & (F.col("t_n") >= F.col("minimum")) & (F.col("differ") == 0) & (F.col("unknown") == 0) & (F.col("dup_parts") == 0)
    return both.agg(F.coalesce(F.sum("s_n"), F.lit(0)).alias("source_items"), F.coalesce(F.sum("t_n"), F.lit(0)).alias("target_items"), F.count_if(good).alias("healthy_sources"))


def summary(source: DataFrame, target: DataFrame, minimum_targets: int = 1) -> dict[str, int]:
    """Numbers of findings of each kind and of healthy sources."""
    out = dict.fromkeys(("healthy", "missing", "orphan", "stale", "duplicate", "ambiguous"), 0)
    out |= {r["finding"]: r["count"] for r in findings(source, target, minimum_targets).groupBy("finding").count().collect()}
    first = healthy(source, target, minimum_targets).first()
    return out | {"source": first["source_items"], "target": first["target_items"], "healthy": first["healthy_sources"]}


def confidence(source_consistent: bool | None, target_consistent: bool | None, issues: int = 0) -> str:
    """proven if both snapshots are consistent and nothing went wrong, unknown if neither is known, else heuristic."""
    if source_consistent and target_consistent and not issues:
        return "proven"
    return "unknown" if source_consistent is None and target_consistent is None else "heuristic"
