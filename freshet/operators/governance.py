"""Policies and their records: egress, quarantine, suppression, revocation, run statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EgressPolicy:
    """Where data may go. An empty set allows all; denied places and labels win; more than max_bytes is denied."""

    destinations: frozenset[str] = frozenset()
    denied_destinations: frozenset[str] = frozenset()
    classifications: frozenset[str] = frozenset()
    purposes: frozenset[str] = frozenset()
    max_bytes: int | None = None

    def decide(self, destination: Column, classification: Column, purpose: Column, size: Column) -> Column:
        """allow, or the first reason to deny."""
        out = F.lit("allow")
        some = lambda c, values: c.isin(sorted(values)) if values else F.lit(True)
        if self.max_bytes is not None:
            out = F.when(size > self.max_bytes, "too_large").otherwise(out)
        out = F.when(~F.coalesce(some(purpose, self.purposes), F.lit(False)), "purpose").otherwise(out)
        out = F.when(~F.coalesce(some(classification, self.classifications), F.lit(False)), "classification").otherwise(out)
        out = F.when(~F.coalesce(some(destination, self.destinations), F.lit(False)), "destination").otherwise(out)
        return F.when(destination.isin(sorted(self.denied_destinations)), "denied_destination").otherwise(out) if self.denied_destinations else out


OPEN_STAGES = ("received", "suppressing", "suppressed", "deleting", "deleted", "verifying")
CLOSED_STAGES = ("verified", "restored", "rejected", "expired", "cancelled")


def revocation_summary(cases: DataFrame, now: Column) -> DataFrame:
    """One row: cases by stage bucket (they do not overlap), overdue ones (which may be in any open bucket), and open ones in all.

    cases: stage, suppress_by, verify_by.
    """
    stage = F.col("stage")
    late = stage.isin(*OPEN_STAGES) & ((F.col("suppress_by") < now) & stage.isin("received", "suppressing") | (F.col("verify_by") < now))
    is_open = stage.isin(*OPEN_STAGES)
    return cases.agg(
        F.count("*").alias("total"),
        F.count_if(stage.isin("received", "suppressing")).alias("pending"),
        F.count_if(stage == "suppressed").alias("suppressed"),
        F.count_if(stage.isin("deleting", "deleted", "verifying")).alias("deleting"),
        F.count_if(stage == "verified").alias("verified"),
        F.count_if(stage.isin("restored", "rejected", "expired", "cancelled")).alias("closed"),
        F.count_if(F.coalesce(late, F.lit(False))).alias("overdue"),
        F.count_if(is_open).alias("open"),
    )


def suppression_index(records: DataFrame) -> DataFrame:
    """The newest generation of each (source_digest, tenant_id): older records never undo a newer one."""
    return records.groupBy("source_digest", "tenant_id").agg(F.max_by(F.struct("suppressed", "reason", "observed_at"), "generation").alias("r"), F.max("generation").alias("generation")).select("source_digest", "tenant_id", "generation", "r.*")


def verify_deleted(wanted: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """(key, proven): whether each key that was to be deleted is gone, by reading the target again."""
    left = target.select(key, F.lit(True).alias("__there")).distinct()
    return wanted.select(key).distinct().join(left, key, "left").select(key, F.col("__there").isNull().alias("proven"))


def quarantine(rows: DataFrame, reason: Column, now: Column) -> DataFrame:
    """Rows as quarantine records: item, reason, status and time; null reasons are left out."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("item"), reason.alias("reason"), F.lit("open").alias("status"), now.alias("at")).where("reason is not null")


def set_status(records: DataFrame, which: Column, status: str) -> DataFrame:
    return records.withColumn("status", F.when(which, status).otherwise(F.col("status")))


def run_statistics(events: DataFrame) -> DataFrame:
    """Counters per processor, and in all (processor null), of (processor, outcome)."""
    counted = [F.count_if(F.col("outcome") == o).alias(o) for o in ("added", "updated", "unchanged", "deleted", "error")]
    return events.rollup("processor").agg(F.count("*").alias("starts"), *counted)


SECRET_NAME = r"(?i)(password|passwd|secret|token|api[_-]?key|authorization|credential|private[_-]?key)"


def redact_metadata(values: Column) -> Column:
    """A map of text without the values of names that sound secret."""
    return F.transform_values(values, lambda k, v: F.when(k.rlike(SECRET_NAME), "[REDACTED]").otherwise(v))


def hmac_sha256(key: bytes, text: Column) -> Column:
    """HMAC-SHA-256 of a text, in hexadecimal, from the sha2 builtin alone."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    first = F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(text, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(bytearray(outer)), first), 256)
