"""Sources, projections, joins, aggregates, searches and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.functions import vectors as V
from freshet.functions.text import ascii_words
from freshet.operators import graph
from freshet.plans.registry import query
from freshet.sources import tables as S
from freshet.sources.match import PatternMatcher


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def source_table_columns(spark, t):
    return t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT [l_orderkey::VARCHAR, l_linenumber::VARCHAR] AS key, l_partkey, l_quantity FROM lineitem")
def source_keyed_items(spark, t):
    return S.keyed(t.lineitem, ["l_orderkey", "l_linenumber"]).select("key", "l_partkey", "l_quantity")


_PATH = "regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/', ''), '[?#].*$', '')"


@query(f"""
SELECT page_id, path FROM (SELECT page_id, {_PATH} AS path FROM pages)
WHERE (regexp_matches(path, '^en/.*$') OR regexp_matches(path, '^de/.*$') OR regexp_matches(path, '^.*\\.html$'))
  AND NOT (regexp_matches(path, '^.*\\.html$') AND NOT regexp_matches(path, '^fr/.*$'))""")
def source_path_matcher(spark, t):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*/", ""), "[?#].*$", "")
    matcher = PatternMatcher(("{en,de}/*", "*.html"), ("*.html", "!fr/*"))
    return t.pages.select("page_id", path.alias("path")).where(matcher.column(F.col("path")))


@query("""
SELECT l_orderkey, l_linenumber, round(l_quantity * p_retailprice, 2) AS total_value, p_brand || ' ' || p_name AS full_description
FROM lineitem JOIN part ON l_partkey = p_partkey""")
def computed_row(spark, t):
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return j.select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") * F.col("p_retailprice"), 2).alias("total_value"), F.concat_ws(" ", "p_brand", "p_name").alias("full_description"))


@query("SELECT o_orderkey::VARCHAR AS key, o_orderstatus AS status, o_orderpriority AS priority FROM orders")
def csv_to_kv(spark, t):
    kv = S.pairs(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"))
    return kv.select("key", F.get_json_object("value", "$.o_orderstatus").alias("status"), F.get_json_object("value", "$.o_orderpriority").alias("priority"))


@query("SELECT event_id, k, CASE WHEN k < 50 THEN 'product' ELSE 'employee' END AS routed FROM (SELECT event_id, (props->>'$.k')::INT AS k FROM events) WHERE k IS NOT NULL")
def json_routing(spark, t):
    has, _ = S.route(t.events, "props", "k")
    k = F.get_json_object("props", "$.k").cast("int")
    return has.select("event_id", k.alias("k"), F.when(k < 50, "product").otherwise("employee").alias("routed"))


_TOPICS = {"license": ("license", "licence"), "motion": ("tion", "ing"), "german": ("und", "der"), "contact": ("@",)}


@query("""
SELECT doc_id, topic FROM documents, (VALUES ('license', ['license', 'licence']), ('motion', ['tion', 'ing']), ('german', ['und', 'der']), ('contact', ['@'])) v(topic, words)
WHERE len(list_filter(words, lambda w: contains(lower(text), w))) > 0""")
def topic_tagging(spark, t):
    low = F.lower("text")
    tags = F.array_compact(F.array(*[F.when(F.greatest(*[F.contains(low, F.lit(w)) for w in ws], F.lit(False)), F.lit(k)) for k, ws in _TOPICS.items()]))
    return t.documents.select("doc_id", F.explode(tags).alias("topic"))


@query("""
SELECT user_id AS topic, SUM(CASE WHEN event_type = 'purchase' THEN 5 ELSE 1 END)::BIGINT AS score,
       MAX(ts) AS latest_mention, COUNT(DISTINCT event_id % 100)::BIGINT AS thread_count
FROM events GROUP BY user_id ORDER BY score DESC, latest_mention DESC LIMIT 20""")
def trending_topics(spark, t):
    score = F.sum(F.when(F.col("event_type") == "purchase", 5).otherwise(1)).cast("bigint")
    found = t.events.groupBy(F.col("user_id").alias("topic")).agg(score.alias("score"), F.max("ts").alias("latest_mention"), F.count_distinct(F.col("event_id") % 100).alias("thread_count"))
    return found.orderBy(F.desc("score"), F.desc("latest_mention")).limit(20)


@query("""
SELECT o_orderkey, c_name, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey
WHERE lower(c_mktsegment) LIKE lower('%Auto%') ORDER BY o_orderdate DESC, o_orderkey LIMIT 50""")
def search_by_topic(spark, t):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).where(F.lower("c_mktsegment").like("%auto%"))
    return j.select("o_orderkey", "c_name", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50)


def _probe(t) -> list[float]:
    """The query vector: a parameter of fixed size, of the row with the least id."""
    return [float(x) for x in t.embeddings.orderBy("vec_id").limit(1).first()["embedding"]]


_Q = "q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 1)"


def _knn_sql(expression: str, order: str) -> str:
    return f"""WITH {_Q}, d AS (SELECT vec_id, {expression} AS x FROM embeddings, q)
SELECT vec_id, round(x, 5) AS distance FROM d ORDER BY x {order}, vec_id LIMIT 10"""


@query(_knn_sql("1 - list_cosine_similarity(embedding::DOUBLE[], v)", "ASC"))
def vector_knn_cosine(spark, t):
    return V.knn(t.embeddings, _probe(t), 10, key="vec_id", by="cosine").select("vec_id", F.round("distance", 5).alias("distance"))


@query(_knn_sql("list_distance(embedding::DOUBLE[], v)", "ASC"))
def vector_knn_l2(spark, t):
    return V.knn(t.embeddings, _probe(t), 10, key="vec_id", by="l2").select("vec_id", F.round("distance", 5).alias("distance"))


@query(_knn_sql("list_inner_product(embedding::DOUBLE[], v)", "DESC"))
def vector_knn_ip(spark, t):
    return V.knn(t.embeddings, _probe(t), 10, key="vec_id", by="inner_product").select("vec_id", F.round("distance", 5).alias("distance"))


@query(f"""WITH {_Q}, d AS (SELECT vec_id, label, list_distance(embedding::DOUBLE[], v) AS x FROM embeddings, q WHERE label < 5),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY x, vec_id) AS rank FROM d)
SELECT label, vec_id, rank, round(x, 5) AS distance FROM r WHERE rank <= 3""")
def vector_knn_filtered(spark, t):
    found = V.knn_per_group(t.embeddings.where("label < 5"), _probe(t), 3, "label", key="vec_id", by="l2")
    return found.select("label", "vec_id", F.col("rank").cast("bigint").alias("rank"), F.round("distance", 5).alias("distance"))


@query("""
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 4),
s AS (SELECT label, query_id, max(list_cosine_similarity(embedding::DOUBLE[], v)) AS x FROM embeddings, q GROUP BY 1, 2)
SELECT label, round(sum(x), 5) AS score FROM s GROUP BY label""")
def multivector_maxsim(spark, t):
    q = t.embeddings.orderBy("vec_id").limit(4).select(F.col("vec_id").alias("query_id"), "embedding")
    return V.max_sim(t.embeddings, q, "label").select("label", F.round("score", 5).alias("score"))


_TERMS = ["license", "the", "und", "les", "thing"]


@query("""
WITH tok AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: length(w) >= 2)) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term IN ('license', 'the', 'und', 'les', 'thing') GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
SELECT doc_id, round(sum(tf * ln((SELECT count(*) FROM documents) / df)), 5) AS score FROM tf JOIN df USING (term) GROUP BY 1""")
def sparse_idf_dot(spark, t):
    docs = t.documents.select("doc_id", ascii_words(F.col("text")).alias("tokens"))
    return V.sparse_idf_scores(docs, _TERMS, "doc_id", "tokens").select("doc_id", F.round("score", 5).alias("score"))


@query(f"""
WITH {_Q}, c AS (SELECT vec_id, label, list_distance(embedding::DOUBLE[], v) AS x, text FROM embeddings JOIN documents ON vec_id = doc_id, q),
r AS (SELECT vec_id, row_number() OVER (ORDER BY x, vec_id) AS a,
             row_number() OVER (ORDER BY CASE WHEN contains(lower(text), 'license') THEN 0 ELSE 1 END, vec_id) AS b FROM c)
SELECT vec_id, round(1.0 / (60 + a) + 1.0 / (60 + b), 8) AS score FROM r ORDER BY 1.0 / (60 + a) + 1.0 / (60 + b) DESC, vec_id LIMIT 10""")
def hybrid_rrf(spark, t):
    c = t.embeddings.join(t.documents.select(F.col("doc_id").alias("vec_id"), "text"), "vec_id")
    far = V.euclidean(F.col("embedding"), F.array(*[F.lit(x) for x in _probe(t)]))
    no_hit = F.when(F.contains(F.lower("text"), F.lit("license")), 0).otherwise(1)
    return V.fused_top_k(c, "vec_id", [far, no_hit]).select("vec_id", F.round("score", 8).alias("score"))


@query("""
WITH e AS (SELECT DISTINCT l_partkey AS p, l_orderkey AS o FROM lineitem)
SELECT DISTINCT a.p AS start, b.p AS node FROM e a JOIN e b ON a.o = b.o WHERE a.p <= 10 AND a.p <> b.p""")
def graph_hop2_recommend(spark, t):
    edges = graph.edge_table(t.lineitem, "l_partkey", "l_orderkey")
    return graph.two_hop(edges, t.part.where("p_partkey <= 10").select(F.col("p_partkey").alias("start")))


@query("""
WITH e AS (SELECT DISTINCT l_partkey AS p, l_orderkey AS o FROM lineitem)
SELECT DISTINCT a.p AS start, b.p AS node FROM e a JOIN e b ON a.o = b.o WHERE a.p <> b.p""")
def graph_hop2_recommend_all(spark, t):
    """graph_hop2_recommend from every part."""
    edges = graph.edge_table(t.lineitem, "l_partkey", "l_orderkey")
    return graph.two_hop(edges, t.part.select(F.col("p_partkey").alias("start")))


@query("SELECT l_suppkey AS entity, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, entity LIMIT 10")
def graph_docs_per_entity(spark, t):
    return graph.per_entity(t.lineitem.select(F.col("l_partkey").alias("from_id"), F.col("l_suppkey").alias("to_id"))).orderBy(F.desc("n"), "entity").limit(10)


@query("""
WITH RECURSIVE e AS (
  SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
w AS (SELECT 'r1' AS node, 0 AS depth UNION ALL SELECT e.child, w.depth + 1 FROM w JOIN e ON e.parent = w.node)
SELECT node, depth FROM w""")
def graph_reachability(spark, t):
    n = t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("child"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent"))
    s = t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("child"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("parent"))
    return graph.descendants(spark, n.unionByName(s), "r1")


@query("SELECT DISTINCT unnest(regexp_split_to_array(p_type, '\\s+')) AS label FROM part")
def distinct_label_union(spark, t):
    return t.part.select(F.explode(F.split("p_type", r"\s+")).alias("label")).distinct()


@query("""
WITH e AS (SELECT DISTINCT o_custkey AS customer, l_partkey AS part FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey <= 50)
SELECT customer, part FROM e""")
def graph_edges_distinct(spark, t):
    j = t.orders.where("o_custkey <= 50").join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    return graph.edge_table(j, "o_custkey", "l_partkey").select(F.col("from_id").alias("customer"), F.col("to_id").alias("part"))


@query("SELECT DISTINCT o_custkey AS customer, l_partkey AS part FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey IS NOT NULL AND l_partkey IS NOT NULL")
def graph_edges_distinct_all(spark, t):
    """graph_edges_distinct of every customer."""
    j = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    return graph.edge_table(j, "o_custkey", "l_partkey").select(F.col("from_id").alias("customer"), F.col("to_id").alias("part"))


@query("""
SELECT n_name AS project, count(*) AS files, list_sort(list(c_name))[1:3] AS first_names FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def project_summary(spark, t):
    """A collection per project; the three first names come from a running minimum of three, not from a list of all."""
    from pyspark.sql import Window

    j = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    counts = j.groupBy(F.col("n_name").alias("project")).agg(F.count("*").alias("files"))
    first = j.withColumn("r", F.row_number().over(Window.partitionBy("n_name").orderBy("c_name", "c_custkey"))).where("r <= 3")
    names = first.groupBy(F.col("n_name").alias("project")).agg(F.array_sort(F.collect_list("c_name")).alias("first_names"))
    return counts.join(names, "project")
