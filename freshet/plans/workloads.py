"""Whole small pipelines: catalogs, sessions, filings, knowledge graphs, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.functions import models, text
from freshet.operators import graph
from freshet.plans.registry import query


@query("SELECT doc_id::VARCHAR || '.json' AS key, doc_id, len(regexp_split_to_array(trim(text), '\\s+')) AS words, length(text) AS characters FROM documents WHERE text IS NOT NULL AND trim(text) <> ''")
def workload_note_catalog(spark, t):
    d = t.documents.where("text is not null and trim(text) <> ''")
    return d.select(F.concat(F.col("doc_id").cast("string"), F.lit(".json")).alias("key"), "doc_id", F.size(F.split(F.trim("text"), r"\s+")).cast("bigint").alias("words"), F.length("text").cast("bigint").alias("characters"))


@query("""
SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS user_turns, max(turn) AS last_turn, sum(length(text))::BIGINT AS characters, min_by(text, turn)[1:40] AS title
FROM conversations GROUP BY 1""")
def workload_session_metadata(spark, t):
    c = t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.max("turn").alias("last_turn"), F.sum(F.length("text")).alias("characters"), F.min_by("text", "turn").alias("t"))
    return c.withColumn("title", F.substring("t", 1, 40)).drop("t")


@query("""
WITH l AS (SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS line FROM conversations)
SELECT role, count(*) AS chunks, count(DISTINCT conv_id) AS sessions, sum(length(trim(line)))::BIGINT AS characters FROM l WHERE trim(line) <> '' GROUP BY 1""")
def workload_session_chunks(spark, t):
    c = t.conversations.select(F.struct("conv_id", "turn", "role").alias("id"), "text")
    return text.split_lines(c, "id", "text").groupBy("id.role").agg(F.count("*").alias("chunks"), F.count_distinct("id.conv_id").alias("sessions"), F.sum(F.length("text")).alias("characters"))


@query("""
WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\\d{3}-\\d{2}-\\d{4}', '[ID]', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', '[MAIL]', 'g') AS text FROM documents),
l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM s)
SELECT CASE WHEN contains(lower(line), 'license') THEN 'license' WHEN contains(line, '[MAIL]') THEN 'contact' ELSE 'other' END AS topic, count(*) AS chunks, sum(length(line))::BIGINT AS characters FROM l WHERE line <> '' GROUP BY 1""")
def workload_filings(spark, t):
    scrubbed = F.regexp_replace(F.regexp_replace("text", r"\d{3}-\d{2}-\d{4}", "[ID]"), r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "[MAIL]")
    chunks = text.split_lines(t.documents.select("doc_id", scrubbed.alias("text")), "doc_id", "text")
    topic = F.when(F.contains(F.lower("text"), F.lit("license")), "license").when(F.contains("text", F.lit("[MAIL]")), "contact").otherwise("other")
    return chunks.groupBy(topic.alias("topic")).agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("characters"))


@query("""
SELECT DISTINCT p_brand AS from_id, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS predicate, s_name AS to_id
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity > 49""")
def workload_knowledge_graph(spark, t):
    j = t.lineitem.where("l_quantity > 49").join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return graph.edge_table(j, "p_brand", "s_name", F.when(F.col("p_size") > 25, "large").otherwise("small"))


@query("""
SELECT p_brand AS product_category, p_name AS product_name, p_retailprice AS price, sum(l_quantity) AS amount, round(p_retailprice * sum(l_quantity), 2) AS total_value
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_partkey, 1, 2, 3""")
def workload_products(spark, t):
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_partkey", F.col("p_brand").alias("product_category"), F.col("p_name").alias("product_name"), F.col("p_retailprice").alias("price")).agg(F.sum("l_quantity").alias("amount"))
    return j.select("product_category", "product_name", "price", "amount", F.round(F.col("price") * F.col("amount"), 2).alias("total_value"))


@query("SELECT count(*) AS rows, 32 AS dimension, count(DISTINCT text) AS distinct_texts FROM documents")
def workload_text_embedding(spark, t):
    """Every text embedded by the hash embedder; equal texts get equal vectors."""
    distinct = t.documents.groupBy("text").agg(F.count("*").alias("n"))
    per = distinct.select("text", "n", F.size(models.embed(F.col("text"), lambda: models.HashEmbedder(32))).alias("size"))
    return per.agg(F.sum("n").alias("rows"), F.max("size").alias("dimension"), F.count("text").alias("distinct_texts"))


@query("""
WITH s AS (SELECT source, lang, text, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: length(w) >= 2) AS ws FROM documents),
c AS (SELECT source, unnest(ws) AS token FROM s), n AS (SELECT source, token, count(*) AS n FROM c GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, token) AS rank FROM n)
SELECT source, rank, token, n FROM r WHERE rank <= 6""")
def workload_collection_tokens(spark, t):
    from pyspark.sql import Window

    counted = t.documents.select("source", F.explode(text.ascii_words(F.col("text"))).alias("token")).groupBy("source", "token").agg(F.count("*").alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "token")).cast("bigint")).where("rank <= 6")
