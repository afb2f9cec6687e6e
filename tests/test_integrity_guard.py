from pyspark.sql import functions as F

from freshet.operators import governance, guard, integrity


def test_one_of_each_finding(spark):
    source = spark.createDataFrame([("ok", "1", "c"), ("gone", "1", "c"), ("old", "2", "c")], "identity string, revision string, content string")
    target = spark.createDataFrame([("ok", "p", "1", "c"), ("old", "p", "1", "c"), ("extra", "p", "1", "c")], "identity string, part string, revision string, content string")
    got = integrity.summary(source, target)
    assert got == {"healthy": 1, "missing": 1, "orphan": 1, "stale": 1, "duplicate": 0, "ambiguous": 0, "source": 3, "target": 3}
    twice = source.unionByName(source.where("identity = 'ok'"))
    assert integrity.summary(twice, target)["duplicate"] == 1 and integrity.summary(twice, target)["ambiguous"] == 1
    assert integrity.summary(source.limit(0), target.limit(0))["healthy"] == 0
    assert integrity.confidence(True, True) == "proven" and integrity.confidence(None, None) == "unknown" and integrity.confidence(True, True, 1) == "heuristic"


POLICY = "policy_id string, tenant_id string, policy_revision int, corrupt boolean, allowed_principals array<string>, allowed_groups array<string>, denied_principals array<string>, denied_groups array<string>"
CANDIDATE = "candidate_id string, source_digest string, tenant_id string, policy_id string, policy_revision int, group_graph_revision int, score double"


def test_reasons_in_order(spark):
    policies = spark.createDataFrame(
        [("p", "t", 1, False, ["me"], [], [], []), ("bad", "t", 1, True, ["me"], [], [], []), ("far", "u", 1, False, ["me"], [], [], []), ("deny", "t", 1, False, ["me"], ["g"], [], ["g"]), ("group", "t", 1, False, [], ["g"], [], [])], POLICY
    )
    rows = [("a", "s", "t", "p", 1, 1, 1.0), ("b", "s", "x", "p", 1, 1, 1.0), ("c", "gone", "t", "p", 1, 1, 1.0), ("d", "s", "t", "none", 1, 1, 1.0), ("e", "s", "t", "bad", 1, 1, 1.0), ("f", "s", "t", "far", 1, 1, 1.0), ("g", "s", "t", "p", 0, 1, 1.0), ("h", "s", "t", "p", 1, 0, 1.0), ("i", "s", "t", "deny", 1, 1, 1.0), ("j", "s", "t", "group", 1, 1, float("nan"))]
    c = spark.createDataFrame(rows, CANDIDATE)
    tables = guard.GuardTables(policies, spark.createDataFrame([("gone", "t", True)], "source_digest string, tenant_id string, suppressed boolean"))
    ctx = guard.AccessContext("t", "me", ("g",), 1)
    got = {r["candidate_id"]: r["reason"] for r in guard.reasons(c, tables, ctx).collect()}
    assert got == {"a": "authorized", "b": "tenant_mismatch", "c": "suppressed", "d": "policy_missing", "e": "policy_corrupt", "f": "policy_tenant_mismatch", "g": "policy_stale", "h": "group_graph_stale", "i": "access_denied", "j": "authorized"}
    assert [r["candidate_id"] for r in guard.guarded_search(c, tables, ctx, F.col("score"), 5).collect()] == ["a"]
    closed = guard.GuardTables(policies, tables.suppressed, suppression_known=False)
    assert guard.filter_candidates(c, closed, ctx).count() == 0
    assert guard.filter_candidates(c, tables, guard.AccessContext("t", "me", ("g",), 1, lookup_failed=True)).count() == 0


def test_governance(spark):
    df = spark.createDataFrame([("shop", "public", "ads", 5), ("leak", "public", "ads", 5), ("shop", "secret", "ads", 5), ("shop", "public", "ads", 50), ("shop", None, "ads", 5)], "d string, c string, p string, n int")
    policy = governance.EgressPolicy(frozenset({"shop", "leak"}), frozenset({"leak"}), frozenset({"public"}), frozenset({"ads"}), 10)
    assert [r[0] for r in df.select(policy.decide(F.col("d"), F.col("c"), F.col("p"), F.col("n"))).collect()] == ["allow", "denied_destination", "classification", "too_large", "classification"]
    import hashlib
    import hmac

    got = spark.range(1).select(governance.hmac_sha256(b"key", F.lit("text"))).first()[0]
    assert got == hmac.new(b"key", b"text", hashlib.sha256).hexdigest()
    m = spark.range(1).select(governance.redact_metadata(F.create_map(F.lit("api_key"), F.lit("x"), F.lit("name"), F.lit("y"))).alias("m")).first()["m"]
    assert m == {"api_key": "[REDACTED]", "name": "y"}
