"""Topics, changes, offsets, state and event time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from freshet.plans.registry import query
from freshet.sources import topics
from freshet.streaming import live


def _messages(t):
    """Events as messages: keyed by user, a deletion where the type is error."""
    return t.events.select((F.col("user_id") % 4).alias("partition"), F.col("event_id").alias("offset"), F.col("user_id").alias("key"), F.when(F.col("event_type") != "error", F.col("value")).alias("value"), "event_type")


@query("""
WITH l AS (SELECT user_id AS key, max_by(event_type, event_id) AS ty, max_by(value, event_id) AS value FROM events GROUP BY 1)
SELECT key, value FROM l WHERE ty <> 'error'""")
def topic_as_map_state(spark, t):
    return topics.topic_as_map(_messages(t))


@query("SELECT count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_type <> 'error'")
def topic_payloads(spark, t):
    return topics.payloads(_messages(t)).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""
WITH c AS (SELECT user_id AS file, event_type AS corpus, event_id AS ordinal, event_id % 7 = 0 AS removed, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 20 END AS version FROM events),
p AS (SELECT file, corpus, max(ordinal) AS ordinal, max_by(removed, ordinal) AS removed, arg_max_null(version, ordinal) AS version FROM c GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY NOT removed DESC, (NOT removed AND version IS NOT NULL) DESC, CASE WHEN removed THEN -1 ELSE coalesce(version, -1) END DESC, ordinal DESC) AS r,
             bool_or(removed) OVER (PARTITION BY file) AS gone FROM p)
SELECT file, corpus, ordinal, version, gone AS removed FROM k WHERE r = 1""")
def coalesce_changes(spark, t):
    e = t.events.select(F.col("user_id").alias("file"), F.col("event_type").alias("corpus"), F.col("event_id").alias("ordinal"), (F.col("event_id") % 7 == 0).alias("removed"), F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 20).alias("version"), F.lit("f").alias("name"))
    return topics.coalesce_changes(e).select("file", "corpus", "ordinal", "version", "removed")


@query("""
WITH d AS (SELECT user_id % 4 AS p, (row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id)) AS o FROM events),
x AS (SELECT p, o FROM d WHERE o % 37 <> 0), i AS (SELECT p, o, o - row_number() OVER (PARTITION BY p ORDER BY o) AS island FROM x),
f AS (SELECT p, min(island) AS island FROM i GROUP BY 1)
SELECT p AS "partition", max(o) + 1 AS next_offset FROM i JOIN f USING (p, island) GROUP BY 1""")
def offset_frontier(spark, t):
    d = t.events.select((F.col("user_id") % 4).alias("partition"), F.row_number().over(Window.partitionBy(F.col("user_id") % 4).orderBy("event_id")).cast("bigint").alias("offset"))
    return topics.committed_frontier(d.where("offset % 37 <> 0"))


@query("SELECT user_id AS key, event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events")
def use_state_running(spark, t):
    return t.events.select(F.col("user_id").alias("key"), "event_id", F.count("*").over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)).alias("n"))


@query("""
WITH s AS (SELECT DISTINCT user_id AS key, 10::BIGINT AS value FROM events WHERE user_id % 2 = 0), e AS (SELECT user_id AS key, count(*) AS n FROM events WHERE event_id % 3 = 0 GROUP BY 1)
SELECT key, (coalesce(value, 0) + coalesce(n, 0))::BIGINT AS value FROM s FULL JOIN e USING (key)""")
def use_state_batch(spark, t):
    state = t.events.where("user_id % 2 = 0").select(F.col("user_id").alias("key"), F.lit(10).cast("bigint").alias("value")).distinct()
    fresh = t.events.where("event_id % 3 = 0").select(F.col("user_id").alias("key"))
    return live.use_state(fresh, state, "key", F.lit(0), F.count("*"), lambda before, n: before + n)


@query("SELECT event_id FROM events WHERE ts IS NULL OR ts >= (SELECT min(ts) + INTERVAL 1 DAY FROM events)")
def scan_then_events(spark, t):
    first = t.events.agg(F.min("ts").alias("first"))
    e = t.events.join(F.broadcast(first))
    _, fresh = live.bootstrap_then_changes(t.events, e, F.col("first") + F.expr("INTERVAL 1 DAY"), "ts")
    return fresh.select("event_id")


@query("""
SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') + INTERVAL 1 DAY AS end, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3""")
def windowed_counts(spark, t):
    return live.windowed_counts(t.events, "ts", "1 day", by=("event_type",))


@query("""
WITH g AS (SELECT user_id AS file, CASE WHEN event_id % 2 = 0 THEN 'user' ELSE 'group' END AS kind, ' ' || upper(event_type) AS name, CASE WHEN event_id % 5 = 0 THEN 1 WHEN event_id % 5 = 1 THEN 100 END AS expires FROM events),
l AS (SELECT file, kind, lower(trim(name)) AS name FROM g WHERE expires IS NULL OR expires > 50)
SELECT file, coalesce(list_sort(list(DISTINCT name) FILTER (kind = 'user')), []) AS principals, coalesce(list_sort(list(DISTINCT name) FILTER (kind = 'group')), []) AS groups FROM l GROUP BY 1""")
def normalize_permissions(spark, t):
    e = t.events.select(F.col("user_id").alias("file"), F.when(F.col("event_id") % 2 == 0, "user").otherwise("group").alias("kind"), F.concat(F.lit(" "), F.upper("event_type")).alias("name"), F.expr("CASE WHEN event_id % 5 = 0 THEN 1 WHEN event_id % 5 = 1 THEN 100 END").alias("expires"))
    return topics.normalize_permissions(e, F.lit(50))
