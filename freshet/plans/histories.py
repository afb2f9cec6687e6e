"""What is remembered, kept, numbered and grouped: memo, versions, ordinals, removals, listings, sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.functions import encoding, text
from freshet.operators import entity, ledger
from freshet.plans.registry import query
from freshet.sources import custom, files


@query("SELECT doc_id, length(text)::BIGINT AS n FROM documents WHERE text IS NOT NULL")
def memoized_lengths(spark, t):
    """A third of the results are remembered, the others are computed once for each text."""
    docs = t.documents.where("text is not null").select("doc_id", "text")
    size = lambda df: df.select("text", F.length("text").cast("bigint").alias("n"))
    out, _ = ledger.memoize(docs, size(docs.where("doc_id % 3 = 0").select("text").distinct()), ["text"], size)
    return out.select("doc_id", "n")


@query("""
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) <= 2 AS kept FROM orders""")
def versions_retained(spark, t):
    """The newest two of each customer's orders stay."""
    kept, gone = ledger.retain(t.orders.select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 2)
    return kept.withColumn("kept", F.lit(True)).unionByName(gone.withColumn("kept", F.lit(False)))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ordinal FROM orders")
def id_ordinals(spark, t):
    return ledger.id_sequence(t.orders.select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey").withColumn("ordinal", F.col("ordinal").cast("bigint"))


@query("""
SELECT DISTINCT 'f' || o_custkey AS file, CASE WHEN o_custkey % 7 = 0 THEN 'moved' WHEN o_custkey % 3 = 0 THEN 'deleted' ELSE 'ignored' END AS kind
FROM orders WHERE o_custkey % 2 = 0""")
def removals_classified(spark, t):
    named = t.orders.select("o_custkey", F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("file"))
    return custom.classify_removals(named.where("o_custkey % 2 = 0"), named.where("o_custkey % 3 = 0"), named.where("o_custkey % 7 = 0"))


@query("""
SELECT key, change FROM (SELECT 'c' || c_custkey AS key, CASE WHEN c_custkey % 11 = 0 THEN 'added' WHEN c_custkey % 13 = 0 THEN 'removed'
    WHEN c_custkey % 5 <> 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'modified' ELSE 'touched' END AS change FROM customer) WHERE change IS NOT NULL""")
def listing_changes(spark, t):
    """What changed between two listings: some keys are new, some are gone, every fifth has another time, every fifteenth other content."""
    key = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    moved = F.col("c_custkey") % 5 == 0
    before = t.customer.where("c_custkey % 11 <> 0").select(key.alias("key"), F.lit(1).alias("modified"), F.md5("c_name").alias("fp"))
    content = F.when(moved & (F.col("c_custkey") % 3 == 0), F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name"))
    now = t.customer.where("c_custkey % 13 <> 0 or c_custkey % 11 = 0").select(key.alias("key"), F.when(moved, 2).otherwise(1).alias("modified"), F.md5(content).alias("fp"))
    return files.changed(now, before)


@query("SELECT r_name AS canonical, list_sort(list(DISTINCT n_name)) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def entity_groups(spark, t):
    both = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return entity.groups(both.select(F.col("n_name").alias("name"), F.col("r_name").alias("canonical")))


@query("""
SELECT doc_id, (1 + (length(text) - length(replace(text, '. ', ''))) // 2)::BIGINT AS sections FROM documents WHERE text IS NOT NULL""")
def heading_sections(spark, t):
    """Sentences become headings; a section goes from one to the next."""
    marked = F.concat(F.lit("# "), F.replace("text", F.lit(". "), F.lit(".\n## ")))
    return t.documents.where("text is not null").select("doc_id", F.size(text.sections(marked)).cast("bigint").alias("sections"))


@query("""
SELECT o_orderkey, strftime(t, '%Y-%m-%dT%H:%M:%S') AS iso, epoch_ms(t)::BIGINT AS ms, (epoch_us(t) - epoch_us(TIMESTAMP '1992-01-01')) / 1e6 AS seconds, o_totalprice AS price, o_orderstatus AS status
FROM (SELECT *, o_orderdate::TIMESTAMP AS t FROM orders)""")
def rows_encoded(spark, t):
    """Orders through text and back, and the encodings of their times."""
    o = t.orders.select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("t"), "o_totalprice", "o_orderstatus")
    sent = o.select("o_orderkey", "t", encoding.serialize("o_totalprice", "o_orderstatus").alias("data"))
    back = sent.withColumn("row", encoding.deserialize("data", o.select("o_totalprice", "o_orderstatus").schema))
    utc = F.to_utc_timestamp(F.col("t").cast("timestamp"), "UTC")
    return back.select("o_orderkey", encoding.iso_time(utc).alias("iso"), encoding.milliseconds(F.to_timestamp(F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'"))).alias("ms"), encoding.total_seconds(F.lit("1992-01-01").cast("timestamp"), utc).alias("seconds"), F.col("row.o_totalprice").alias("price"), F.col("row.o_orderstatus").alias("status"))
