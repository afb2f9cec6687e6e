"""Node and edge tables: upserts, hops, reachability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


PAIRS_AT_ONCE = 1 << 20  # that a task of two_hop has on average


def edge_table(df: DataFrame, src: str, dst: str, predicate: str | Column | None = None, *, from_table: str | None = None, to_table: str | None = None) -> DataFrame:
    """Distinct edges (from_id, to_id[, predicate][, from_table, to_table]) without null ends; the key is what the edge has."""
    cols = [F.col(src).alias("from_id"), F.col(dst).alias("to_id")]
    if predicate is not None:
        cols.append((F.col(predicate) if isinstance(predicate, str) else predicate).alias("predicate"))
    if from_table or to_table:
        cols += [F.lit(from_table).alias("from_table"), F.lit(to_table).alias("to_table")]
    return df.select(*cols).where("from_id is not null and to_id is not null").distinct()


def hop(edges: DataFrame, nodes: DataFrame, *, reverse: bool = False) -> DataFrame:
    """(start, node): one step along the edges from (start, node); backwards if `reverse`."""
    a, b = ("to_id", "from_id") if reverse else ("from_id", "to_id")
    return nodes.join(edges.select(F.col(a).alias("node"), F.col(b).alias("next")), "node").select("start", F.col("next").alias("node")).distinct()


def two_hop(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node): other nodes on the near side that share a neighbour with a start; starts has `start`."""
    # as many parts as the pairs need, so that a task's share stays the same when the edges grow
    pairs = edges.groupBy("to_id").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0
    parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(pairs) // PAIRS_AT_ONCE))
    first = hop(edges, starts.select("start", F.col("start").alias("node")))
    back = edges.select(F.col("to_id").alias("node"), F.col("from_id").alias("next")).repartition(parts, "node")
    found = first.repartition(parts, "node").join(back.hint("shuffle_merge"), "node").where("start <> next").select("start", F.col("next").alias("node"))
    return found.repartition(parts, "start", "node").distinct()


def per_entity(edges: DataFrame) -> DataFrame:
    """(entity, n): distinct sources of the edges to each entity."""
    return edges.groupBy(F.col("to_id").alias("entity")).agg(F.count_distinct("from_id").alias("n"))


def descendants(spark: SparkSession, parents: DataFrame, root, node_type: str = "string") -> DataFrame:
    """(node, depth) of everything below a root in (child, parent) rows that make a tree."""
    parents.select(F.col("child").cast(node_type), F.col("parent").cast(node_type)).createOrReplaceTempView("__tree_edges")
    return spark.sql(
        f"""
        WITH RECURSIVE walk (node, depth) AS (
            SELECT CAST('{str(root).replace("'", "''")}' AS {node_type}), 0
            UNION ALL
            SELECT e.child, walk.depth + 1 FROM walk JOIN __tree_edges e ON e.parent = walk.node)
        SELECT node, depth FROM walk"""
    )


def connected(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) of undirected edges (a, b): root is the least node of a component. Labels are passed on and shortened each round; lineage is cut by checkpoints where a folder for them is set."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct()
    spark = edges.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="freshet-graph-")
        spark.sparkContext.setCheckpointDir(folder)
    both = both.checkpoint()
    labels = both.select(F.col("u").alias("node")).distinct().withColumn("root", F.col("node"))
    for _ in range(rounds):
        least = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("root").alias("near"))
        moved = labels.join(least, labels.node == least.u, "left").select("node", F.least("root", F.coalesce("near", "root")).alias("next"), "root")
        # follow the label's own label, so that long chains halve
        up = moved.select(F.col("node").alias("__n"), F.col("next").alias("__up"))
        new = moved.join(up, moved.next == up["__n"], "left").select("node", F.least("next", F.coalesce("__up", "next")).alias("root"), F.col("root").alias("old")).checkpoint()
        labels = new.select("node", "root")
        if not new.where("root <> old").limit(1).count():
            return labels
    raise RuntimeError("components did not settle")
