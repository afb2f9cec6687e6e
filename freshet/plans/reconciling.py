"""Reconciliation, integrity, access and governance."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.functions.hashing import fingerprint
from freshet.operators import governance, guard, integrity, ledger, reconcile
from freshet.plans.registry import query

_RUN1 = "r1 AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderkey % 10 <> 0)"
_RUN2 = "r2 AS (SELECT o_orderkey AS k, o_orderstatus AS status, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price FROM orders WHERE o_orderkey % 10 <> 1)"


def _runs(t):
    """The same orders as two runs of a source see them: some keys vanish, some are new, some prices differ."""
    o = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    moved = o.withColumn("price", F.when(F.col("k") % 7 == 0, F.col("price") + 1).otherwise(F.col("price")))
    return o.where("k % 10 <> 0"), moved.where("k % 10 <> 1")


@query(f"""WITH {_RUN1}, {_RUN2}
SELECT coalesce(r2.k, r1.k) AS k, CASE WHEN r1.k IS NULL THEN 'create' WHEN r2.k IS NULL THEN 'delete' WHEN r1.status = r2.status AND r1.price = r2.price THEN 'unchanged' ELSE 'update' END AS action
FROM r2 FULL JOIN r1 ON r1.k = r2.k""")
def reconcile_diff(spark, t):
    first, second = _runs(t)
    return reconcile.diff_tables(second, first, ["k"], ["status", "price"]).select("k", "action")


_PREV = """
d AS (SELECT o_orderkey AS k, o_orderkey % 3 AS v FROM orders WHERE o_orderkey % 5 <> 0),
p AS (SELECT o_orderkey AS k, (o_orderkey + c) % 3 AS v, o_orderkey % 4 = 0 AS missing FROM orders, (VALUES (0), (1)) x(c)
      WHERE (c = 0 AND o_orderkey % 6 <> 0) OR (c = 1 AND o_orderkey % 8 = 0))"""


@query(f"""WITH {_PREV}, q AS (SELECT k, count(*) AS n, min(v) AS lo, max(v) AS hi, bool_or(missing) AS missing FROM p GROUP BY k)
SELECT coalesce(d.k, q.k) AS k, CASE WHEN d.k IS NULL THEN 'delete' WHEN n IS NOT NULL AND (lo <> v OR hi <> v) THEN 'replace'
       WHEN NOT coalesce(missing, true) THEN 'none' WHEN n IS NULL THEN 'insert' ELSE 'upsert' END AS action FROM d FULL JOIN q ON d.k = q.k""")
def reconcile_incomplete_prev(spark, t):
    o = t.orders.select(F.col("o_orderkey").alias("k"))
    desired = o.where("k % 5 <> 0").select("k", (F.col("k") % 3).cast("string").alias("fp"))
    state = lambda c, where: o.where(where).select("k", ((F.col("k") + c) % 3).cast("string").alias("fp"), (F.col("k") % 4 == 0).alias("may_be_missing"))
    return reconcile.diff(desired, state(0, "k % 6 <> 0").unionByName(state(1, "k % 8 = 0")), ["k"]).select("k", "action")


@query("""
WITH m AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'upsert' WHEN 2 THEN 'replace' ELSE 'delete' END AS main, 1 AS candidates, p_partkey % 4 = 1 AS missing FROM part),
d AS (SELECT p_partkey AS k, sub, length(p_name) % 5 + s AS v FROM part, (VALUES ('name', 0), ('brand', 1), ('size', 2)) x(sub, s) WHERE p_partkey % 4 <> 3 AND (p_partkey + s) % 5 <> 0),
q AS (SELECT p_partkey AS k, sub, length(p_name) % 5 + s + CASE WHEN (p_partkey + s) % 3 = 0 THEN 1 ELSE 0 END AS v FROM part, (VALUES ('name', 0), ('brand', 1), ('old', 3)) x(sub, s))
SELECT k, sub, CASE WHEN d.v IS NULL THEN 'delete' WHEN q.v IS NOT NULL AND q.v <> d.v THEN 'replace'
       WHEN NOT (missing OR main IN ('replace', 'delete') OR (q.v IS NULL)) THEN 'none' WHEN q.v IS NULL THEN 'insert' ELSE 'upsert' END AS action
FROM (d FULL JOIN q USING (k, sub)) JOIN m USING (k) WHERE main <> 'delete'""")
def reconcile_composite(spark, t):
    p = t.part.select(F.col("p_partkey").alias("k"), (F.length("p_name") % 5).alias("b"))
    main = p.select("k", F.expr("CASE k % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'upsert' WHEN 2 THEN 'replace' ELSE 'delete' END").alias("action"), F.lit(1).alias("candidates"), (F.col("k") % 4 == 1).alias("missing"))
    subs = lambda names: F.explode(F.array(*[F.struct(F.lit(n).alias("sub"), F.lit(s).alias("s")) for n, s in names]))
    desired = p.withColumn("x", subs((("name", 0), ("brand", 1), ("size", 2)))).where("k % 4 <> 3 and (k + x.s) % 5 <> 0").select("k", "x.sub", (F.col("b") + F.col("x.s")).cast("string").alias("fp"))
    prev = p.withColumn("x", subs((("name", 0), ("brand", 1), ("old", 3)))).select("k", "x.sub", (F.col("b") + F.col("x.s") + F.when((F.col("k") + F.col("x.s")) % 3 == 0, 1).otherwise(0)).cast("string").alias("fp"))
    return reconcile.diff_composite(main, desired, prev, ["k"], "sub")


@query(f"""WITH {_RUN1}, {_RUN2}, d AS (SELECT * FROM r2 WHERE k % 4 <> 0), p AS (SELECT * FROM r1 WHERE k % 4 <> 0)
SELECT coalesce(d.k, p.k) AS k, CASE WHEN p.k IS NULL THEN 'create' WHEN d.k IS NULL THEN 'delete' WHEN d.status = p.status AND d.price = p.price THEN 'unchanged' ELSE 'update' END AS action
FROM d FULL JOIN p ON d.k = p.k""")
def reconcile_managed_by(spark, t):
    first, second = _runs(t)
    mark = lambda df: df.withColumn("managed_by", F.when(F.col("k") % 4 == 0, "user").otherwise("system"))
    desired, previous = reconcile.system_managed(mark(second), mark(first), ["k"])
    return reconcile.diff_tables(desired, previous, ["k"], ["status", "price"]).select("k", "action")


@query("""
WITH dec AS (SELECT l_orderkey AS k, max_by(l_suppkey, l_linenumber::BIGINT * 1000000000 + l_suppkey) AS owner FROM lineitem GROUP BY 1), led AS (SELECT o_orderkey AS k, o_orderkey % 10 + 1 AS old_owner FROM orders WHERE o_orderkey % 3 <> 0)
SELECT k, old_owner, owner, old_owner IS NOT NULL AND old_owner <> owner AS transferred FROM dec LEFT JOIN led USING (k)""")
def ownership_transfer(spark, t):
    led = t.orders.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 10 + 1).alias("owner"))
    declared = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("owner"), F.col("l_linenumber").alias("seq"))
    return reconcile.transfer_ownership(led, declared, ["k"])


@query("SELECT o_custkey AS owner, o_orderkey AS k FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def orphan_gc(spark, t):
    led = t.orders.select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("k"))
    return reconcile.orphans(led, t.customer.where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("owner")))


@query(f"WITH {_RUN2} SELECT k, status, price FROM r2")
def apply_actions(spark, t):
    first, second = _runs(t)
    return reconcile.apply_actions(first, reconcile.diff_tables(second, first, ["k"], ["status", "price"]), ["k"], ["status", "price"])


@query("""SELECT c_custkey AS k, c_nationkey AS container, c_custkey % 3 AS generation, n_regionkey IS NULL OR c_custkey % 3 <> n_regionkey % 3 AS stale
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey <> 5""")
def child_invalidation(spark, t):
    children = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("container"), (F.col("c_custkey") % 3).alias("generation"))
    containers = t.nation.where("n_nationkey <> 5").select(F.col("n_nationkey").alias("container"), (F.col("n_regionkey") % 3).cast("bigint").alias("generation"))
    return reconcile.invalidate_children(children, containers, "container")


@query(f"""WITH {_RUN1}, {_RUN2}
SELECT 'orders_' || coalesce(r2.status, r1.status) AS target, CASE WHEN r1.k IS NULL THEN 'create' WHEN r2.k IS NULL THEN 'delete' WHEN r1.status = r2.status AND r1.price = r2.price THEN 'unchanged' ELSE 'update' END AS action, count(*) AS n
FROM r2 FULL JOIN r1 ON r1.k = r2.k GROUP BY 1, 2""")
def preview_counts(spark, t):
    first, second = _runs(t)
    acts = reconcile.diff_tables(second, first, ["k"], ["status", "price"]).withColumnRenamed("status", "now")
    named = acts.join(first.select("k", F.col("status").alias("was")), "k", "left").withColumn("target", F.concat(F.lit("orders_"), F.coalesce("now", "was")))
    return reconcile.preview(named, "target")


_FACTS = """
src AS (SELECT o_orderkey AS identity, o_orderstatus AS revision, o_custkey::VARCHAR AS content FROM orders WHERE o_orderkey % 11 <> 0
        UNION ALL SELECT o_orderkey, o_orderstatus, o_custkey::VARCHAR FROM orders WHERE o_orderkey % 50 = 1),
tgt AS (SELECT l_orderkey AS identity, (l_linenumber - CASE WHEN l_orderkey % 40 = 2 AND l_linenumber = 2 THEN 1 ELSE 0 END)::VARCHAR AS part,
               CASE WHEN l_orderkey % 13 = 0 THEN 'old' WHEN l_orderkey % 17 = 0 THEN NULL ELSE o_orderstatus END AS revision, o_custkey::VARCHAR AS content
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey % 9 <> 0),
s AS (SELECT identity, count(*) AS s_n, max(revision) AS rev, max(content) AS con FROM src GROUP BY 1),
t AS (SELECT identity, count(*) AS t_n, count(*) FILTER (tgt.revision <> rev OR tgt.content <> con) AS differ,
             count(*) FILTER ((tgt.revision IS NULL AND rev IS NOT NULL) OR (tgt.content IS NULL AND con IS NOT NULL)) AS unknown FROM tgt LEFT JOIN s USING (identity) GROUP BY 1),
p AS (SELECT DISTINCT identity FROM (SELECT identity, part FROM tgt WHERE part IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1)),
b AS (SELECT identity, coalesce(s_n, 0) AS s_n, coalesce(t_n, 0) AS t_n, coalesce(differ, 0) AS differ, coalesce(unknown, 0) AS unknown, p.identity IS NOT NULL AS dup
      FROM s FULL JOIN t USING (identity) LEFT JOIN p USING (identity))"""


def _facts(t):
    o = t.orders.select(F.col("o_orderkey").alias("identity"), F.col("o_orderstatus").alias("revision"), F.col("o_custkey").cast("string").alias("content"))
    source = o.where("identity % 11 <> 0").unionByName(o.where("identity % 50 = 1"))
    part = (F.col("l_linenumber") - F.when((F.col("l_orderkey") % 40 == 2) & (F.col("l_linenumber") == 2), 1).otherwise(0)).cast("string")
    rev = F.expr("CASE WHEN identity % 13 = 0 THEN 'old' WHEN identity % 17 = 0 THEN NULL ELSE revision END")
    target = t.lineitem.where("l_orderkey % 9 <> 0").select(F.col("l_orderkey").alias("identity"), part.alias("part")).join(o, "identity").select("identity", "part", rev.alias("revision"), "content")
    return source, target


@query(f"""WITH {_FACTS}
SELECT identity, 'duplicate' AS finding, 'source' AS side FROM b WHERE s_n > 1 UNION ALL SELECT identity, 'ambiguous', 'source' FROM b WHERE s_n > 1
UNION ALL SELECT identity, 'duplicate', 'target' FROM b WHERE dup UNION ALL SELECT identity, 'orphan', 'target' FROM b WHERE s_n = 0
UNION ALL SELECT identity, 'missing', 'source' FROM b WHERE s_n > 0 AND t_n < 1 UNION ALL SELECT identity, 'stale', 'target' FROM b WHERE s_n = 1 AND differ > 0
UNION ALL SELECT identity, 'ambiguous', 'target' FROM b WHERE s_n = 1 AND differ = 0 AND unknown > 0""")
def integrity_findings(spark, t):
    return integrity.findings(*_facts(t))


@query(f"""WITH {_FACTS}
SELECT sum(s_n)::BIGINT AS source_items, sum(t_n)::BIGINT AS target_items, count(*) FILTER (s_n = 1 AND t_n >= 1 AND differ = 0 AND unknown = 0 AND NOT dup) AS healthy_sources FROM b""")
def integrity_healthy(spark, t):
    return integrity.healthy(*_facts(t))


_CANDIDATES = """
c AS (SELECT vec_id AS candidate_id, vec_id % 50 AS source_digest, CASE WHEN vec_id % 7 = 0 THEN 'other' ELSE 'acme' END AS tenant_id, label AS policy_id,
             CASE WHEN vec_id % 9 = 0 THEN 1 ELSE 2 END AS policy_revision, CASE WHEN vec_id % 10 = 3 THEN 4 ELSE 5 END AS graph, embedding FROM embeddings),
r AS (SELECT *, CASE WHEN tenant_id <> 'acme' THEN 'tenant_mismatch' WHEN source_digest % 12 = 0 THEN 'suppressed' WHEN policy_id = 9 THEN 'policy_missing' WHEN policy_id = 8 THEN 'policy_corrupt'
      WHEN policy_id = 7 THEN 'policy_tenant_mismatch' WHEN policy_revision <> 2 THEN 'policy_stale' WHEN graph <> 5 THEN 'group_graph_stale' WHEN policy_id IN (0, 1) THEN 'access_denied' ELSE 'authorized' END AS reason FROM c)"""


def _guarded(spark, t):
    e = t.embeddings
    c = e.select(
        F.col("vec_id").alias("candidate_id"), (F.col("vec_id") % 50).alias("source_digest"), F.when(F.col("vec_id") % 7 == 0, "other").otherwise("acme").alias("tenant_id"), F.col("label").alias("policy_id"),
        F.when(F.col("vec_id") % 9 == 0, 1).otherwise(2).alias("policy_revision"), F.when(F.col("vec_id") % 10 == 3, 4).otherwise(5).alias("group_graph_revision"), "embedding",
    )
    rows = [(i, "elsewhere" if i == 7 else "acme", 2, i == 8, ["ann"] if i % 2 else [], [] if i % 2 else ["staff"], ["ann"] if i == 1 else [], ["staff"] if i == 0 else []) for i in range(9)]
    policies = spark.createDataFrame(rows, "policy_id int, tenant_id string, policy_revision int, corrupt boolean, allowed_principals array<string>, allowed_groups array<string>, denied_principals array<string>, denied_groups array<string>")
    suppressed = c.select("source_digest").distinct().select("source_digest", F.lit("acme").alias("tenant_id"), (F.col("source_digest") % 12 == 0).alias("suppressed"))
    return c, guard.GuardTables(policies, suppressed), guard.AccessContext("acme", "ann", ("staff",), 5)


@query(f"WITH {_CANDIDATES} SELECT candidate_id, reason FROM r")
def guard_reasons(spark, t):
    c, tables, ctx = _guarded(spark, t)
    return guard.reasons(c, tables, ctx).select("candidate_id", "reason")


@query(f"WITH {_CANDIDATES} SELECT reason, count(*) AS n FROM r WHERE reason <> 'authorized' GROUP BY 1")
def guard_denials(spark, t):
    return guard.denials(*_guarded(spark, t))


@query(f"""WITH {_CANDIDATES}, q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 1), x AS (SELECT candidate_id, list_inner_product(embedding::DOUBLE[], v) AS s FROM r, q WHERE reason = 'authorized')
SELECT candidate_id, round(s, 5) AS score FROM x ORDER BY s DESC, candidate_id LIMIT 10""")
def guarded_topk(spark, t):
    from freshet.functions.vectors import dot

    c, tables, ctx = _guarded(spark, t)
    probe = [float(x) for x in t.embeddings.orderBy("vec_id").limit(1).first()["embedding"]]
    found = guard.guarded_search(c, tables, ctx, dot(F.col("embedding"), F.array(*[F.lit(x) for x in probe])), 10)
    return found.select("candidate_id", F.round("score", 5).alias("score"))


_STAGES = "['received', 'suppressing', 'suppressed', 'deleting', 'deleted', 'verifying', 'verified', 'restored', 'rejected', 'expired', 'cancelled']"


@query(f"""
WITH c AS (SELECT {_STAGES}[(o_orderkey % 11)::INT + 1] AS stage, o_orderdate + INTERVAL 2 DAY AS suppress_by, o_orderdate + INTERVAL 30 DAY AS verify_by FROM orders),
m AS (SELECT *, stage IN ('received', 'suppressing', 'suppressed', 'deleting', 'deleted', 'verifying') AS is_open FROM c)
SELECT count(*) AS total, count(*) FILTER (stage IN ('received', 'suppressing')) AS pending, count(*) FILTER (stage = 'suppressed') AS suppressed, count(*) FILTER (stage IN ('deleting', 'deleted', 'verifying')) AS deleting,
       count(*) FILTER (stage = 'verified') AS verified, count(*) FILTER (stage IN ('restored', 'rejected', 'expired', 'cancelled')) AS closed,
       count(*) FILTER (is_open AND ((suppress_by < TIMESTAMP '1995-06-01' AND stage IN ('received', 'suppressing')) OR verify_by < TIMESTAMP '1995-06-01')) AS overdue, count(*) FILTER (is_open) AS open FROM m""")
def revocation_summary(spark, t):
    stages = F.array(*[F.lit(s) for s in governance.OPEN_STAGES + governance.CLOSED_STAGES])
    c = t.orders.select(F.element_at(stages, (F.col("o_orderkey") % 11 + 1).cast("int")).alias("stage"), (F.col("o_orderdate") + F.expr("INTERVAL 2 DAY")).alias("suppress_by"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAY")).alias("verify_by"))
    return governance.revocation_summary(c, F.lit("1995-06-01 00:00:00").cast("timestamp_ntz"))


@query("""
SELECT event_id, CASE WHEN event_type = 'error' THEN 'denied_destination' WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'destination'
  WHEN user_id % 4 = 0 THEN 'classification' WHEN user_id % 3 = 0 THEN 'purpose' WHEN event_id % 100 > 90 THEN 'too_large' ELSE 'allow' END AS decision FROM events""")
def egress_policy(spark, t):
    policy = governance.EgressPolicy(frozenset({"click", "view", "purchase"}), frozenset({"error"}), frozenset({"public"}), frozenset({"search"}), 90)
    kind, purpose = F.when(F.col("user_id") % 4 == 0, "secret").otherwise("public"), F.when(F.col("user_id") % 3 == 0, "ads").otherwise("search")
    return t.events.select("event_id", policy.decide(F.col("event_type"), kind, purpose, F.col("event_id") % 100).alias("decision"))


@query("""
WITH m AS (SELECT DISTINCT sha256(text) AS fp FROM documents WHERE doc_id % 3 = 0)
SELECT doc_id, sha256(text) IN (SELECT fp FROM m) AS hit FROM documents""")
def memo_hits(spark, t):
    items = t.documents.select("doc_id", F.sha2("text", 256).alias("fp"))
    memo = items.where("doc_id % 3 = 0").select("fp", F.lit(1).alias("result")).distinct()
    hits, misses = ledger.split_by_memo(items, memo, ["fp"])
    return hits.select("doc_id", F.lit(True).alias("hit")).unionByName(misses.select("doc_id", F.lit(False).alias("hit")))


@query("""
WITH known AS (SELECT DISTINCT p_brand AS dep FROM part WHERE p_partkey <= 20), want AS (SELECT DISTINCT p_brand AS dep FROM part)
SELECT (SELECT count(*) FROM want) AS ids, true AS all_distinct, (SELECT count(*) FROM known) AS kept, true AS all_positive""")
def stable_ids(spark, t):
    from pyspark.sql import Window

    known = t.part.where("p_partkey <= 20").select(F.col("p_brand").alias("dep")).distinct().withColumn("id", F.row_number().over(Window.orderBy("dep")).cast("bigint"))
    after = ledger.stable_ids(t.part.select(F.col("p_brand").alias("dep")), known)
    j = after.join(known.select("dep", F.col("id").alias("old")), "dep", "left")
    return j.agg(F.count("*").alias("ids"), (F.count_distinct("id") == F.count("*")).alias("all_distinct"), F.count_if(F.col("id") == F.col("old")).alias("kept"), (F.min("id") >= 1).alias("all_positive"))


@query("""
WITH e AS (SELECT event_type AS processor, CASE event_id % 5 WHEN 0 THEN 'added' WHEN 1 THEN 'updated' WHEN 2 THEN 'unchanged' WHEN 3 THEN 'deleted' ELSE 'error' END AS outcome FROM events)
SELECT processor, count(*) AS starts, count(*) FILTER (outcome = 'added') AS added, count(*) FILTER (outcome = 'updated') AS updated, count(*) FILTER (outcome = 'unchanged') AS unchanged,
       count(*) FILTER (outcome = 'deleted') AS deleted, count(*) FILTER (outcome = 'error') AS error FROM e GROUP BY ROLLUP (processor)""")
def stats_rollup(spark, t):
    outcome = F.expr("CASE event_id % 5 WHEN 0 THEN 'added' WHEN 1 THEN 'updated' WHEN 2 THEN 'unchanged' WHEN 3 THEN 'deleted' ELSE 'error' END")
    return governance.run_statistics(t.events.select(F.col("event_type").alias("processor"), outcome.alias("outcome")))


@query("SELECT sha256(text) AS fp, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def content_fingerprint_dedup(spark, t):
    return t.documents.groupBy(F.sha2("text", 256).alias("fp")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))


@query("""
WITH l AS (SELECT source, substr(sha256(text), 1, 3) AS deal, sha256(array_to_string(list_sort(list(sha256(text))), chr(10))) AS leaf FROM documents WHERE text IS NOT NULL GROUP BY 1, 2)
SELECT source, sha256(array_to_string(list(leaf ORDER BY deal), chr(10))) AS digest FROM l GROUP BY 1""")
def manifest_digest(spark, t):
    from freshet.functions.hashing import tree_digest

    return tree_digest(t.documents.where("text is not null").select("source", F.sha2("text", 256).alias("fp")), ["source"], "fp")


@query("""
WITH g AS (SELECT source_digest, tenant_id, max_by(suppressed, generation) AS suppressed, max(generation) AS generation FROM
  (SELECT doc_id % 97 AS source_digest, lang AS tenant_id, doc_id % 3 = 0 AS suppressed, doc_id AS generation FROM documents) GROUP BY 1, 2)
SELECT source_digest, tenant_id, generation, suppressed FROM g""")
def suppression_latest(spark, t):
    d = t.documents.select((F.col("doc_id") % 97).alias("source_digest"), F.col("lang").alias("tenant_id"), (F.col("doc_id") % 3 == 0).alias("suppressed"), F.col("doc_id").alias("generation"), F.lit("request").alias("reason"), F.lit(None).cast("timestamp").alias("observed_at"))
    return governance.suppression_index(d).select("source_digest", "tenant_id", "generation", "suppressed")


@query("SELECT o_orderkey AS k, o_orderkey % 10 = 0 AS proven FROM orders WHERE o_orderkey % 5 = 0")
def verified_deletes(spark, t):
    first, _ = _runs(t)
    return governance.verify_deleted(t.orders.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("k")), first, "k")


@query("SELECT k, reuse, refresh FROM (SELECT doc_id AS k, doc_id % 2 = 0 OR doc_id % 3 = 0 AS reuse, doc_id % 2 = 1 AND doc_id % 3 = 0 AS refresh FROM documents)")
def memo_states(spark, t):
    before = t.documents.select(F.col("doc_id").alias("k"), F.lit(1).alias("modified"), fingerprint("text").alias("fp"))
    now = t.documents.select(F.col("doc_id").alias("k"), F.when(F.col("doc_id") % 2 == 0, 1).otherwise(2).alias("modified"), fingerprint(F.concat("text", F.when(F.col("doc_id") % 3 == 0, "").otherwise("!"))).alias("fp"))
    return ledger.reuse(now, before, "k")
