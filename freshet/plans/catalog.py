"""Every named query of the library and the SQL that gives the same rows."""

from __future__ import annotations

from freshet.plans import histories, reconciling, relational, streams, texts, workloads  # noqa: F401  (they register themselves)
from freshet.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
