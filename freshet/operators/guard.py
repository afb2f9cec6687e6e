"""Which candidates a principal may see: tenant, suppression and access policy, closed on doubt."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AUTHORIZED = "authorized"


@dataclass(frozen=True)
class AccessContext:
    """Who asks, for which tenant, and the revisions that are in force."""

    tenant: str
    principal: str
    groups: tuple[str, ...] = ()
    group_graph_revision: int = 0
    lookup_failed: bool = False


@dataclass
class GuardTables:
    """Suppressed sources and policies, by their keys; `suppression_known` False means the index cannot be read."""

    policies: DataFrame
    suppressed: DataFrame
    suppression_known: bool = True
    extra: dict = field(default_factory=dict)


def allowed(ctx: AccessContext, row: str = "p") -> Column:
    """Not denied by name or group, and allowed by name or group; deny wins."""
    groups = F.array(*[F.lit(g) for g in ctx.groups]) if ctx.groups else F.array().cast("array<string>")
    hit = lambda name, group: F.coalesce(F.array_contains(f"{row}.{name}", ctx.principal), F.lit(False)) | F.coalesce(F.arrays_overlap(f"{row}.{group}", groups), F.lit(False))
    return ~hit("denied_principals", "denied_groups") & hit("allowed_principals", "allowed_groups")


def reasons(candidates: DataFrame, tables: GuardTables, ctx: AccessContext) -> DataFrame:
    """`candidates` with `reason`: the first that holds of tenant_mismatch, suppressed or suppression_unavailable, policy_missing, policy_corrupt, policy_tenant_mismatch, policy_stale, group_graph_stale, access_denied; else authorized.

    candidates: source_digest, tenant_id, policy_id, policy_revision, group_graph_revision.
    """
    gone = tables.suppressed.where("suppressed").select(F.col("source_digest").alias("__gone"), F.col("tenant_id").alias("__gone_tenant")).distinct()
    c = candidates.join(gone, (F.col("source_digest") == F.col("__gone")) & (F.col("tenant_id") == F.col("__gone_tenant")), "left").alias("c")
    p = tables.policies.alias("p")
    joined = c.join(p, F.col("c.policy_id") == F.col("p.policy_id"), "left")
    if ctx.lookup_failed:
        reason = F.lit("policy_missing")
    else:
        reason = (
            F.when(F.col("p.policy_id").isNull(), "policy_missing")
            .when(F.col("p.corrupt"), "policy_corrupt")
            .when(F.col("p.tenant_id") != F.col("c.tenant_id"), "policy_tenant_mismatch")
            .when(~F.col("p.policy_revision").eqNullSafe(F.col("c.policy_revision")), "policy_stale")
            .when(~F.col("c.group_graph_revision").eqNullSafe(F.lit(ctx.group_graph_revision)), "group_graph_stale")
            .when(~allowed(ctx), "access_denied")
            .otherwise(AUTHORIZED)
        )
    suppressed = F.lit("suppression_unavailable") if not tables.suppression_known else None
    out = F.when(~F.col("c.tenant_id").eqNullSafe(F.lit(ctx.tenant)), "tenant_mismatch")
    out = out.otherwise(suppressed if suppressed is not None else F.when(F.col("c.__gone").isNotNull(), "suppressed").otherwise(reason))
    return joined.select(*[F.col(f"c.{x}").alias(x) for x in candidates.columns], out.alias("reason"))


def filter_candidates(candidates: DataFrame, tables: GuardTables, ctx: AccessContext) -> DataFrame:
    return reasons(candidates, tables, ctx).where(F.col("reason") == AUTHORIZED).drop("reason")


def denials(candidates: DataFrame, tables: GuardTables, ctx: AccessContext) -> DataFrame:
    """(reason, n) of what is not authorized."""
    return reasons(candidates, tables, ctx).where(F.col("reason") != AUTHORIZED).groupBy("reason").agg(F.count("*").alias("n"))


def guarded_search(candidates: DataFrame, tables: GuardTables, ctx: AccessContext, score: Column, limit: int, key: str = "candidate_id") -> DataFrame:
    """The best authorized candidates: authorize, score, authorize again, then sort; a score that is not finite is an error of the candidate and drops it."""
    scored = filter_candidates(candidates, tables, ctx).withColumn("score", score).where(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf")))
    return filter_candidates(scored, tables, ctx).orderBy(F.desc("score"), key).limit(limit)
