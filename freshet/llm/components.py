"""Connected components of a graph too large for one machine, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.runtime import discard, join_groups, table


def _large_star(edges: DataFrame, count: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("size"))
    return join_groups(both, least, ["u"], "size", 2 * count).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, count: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size"))
    moved = join_groups(down, least, ["u"], "size", count).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("u", "v"), 20)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of `edges` (u, v), root being the least node of its component.

    Loops and repeated edges count once, rows with a null end are ignored, no edge gives no row.
    Work per round is in proportion to the edges; a hub's neighbours are counted and minimised
    before they are shuffled, and meet its minimum wherever they are. Each round is a written
    table, the one before is deleted. Rounds grow with the logarithm of the longest path; it
    is an error if `rounds` do not suffice.
    """
    now = table(edges.select("u", "v").where("u <> v").distinct(), "edges")
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        star = table(_large_star(now, state[0]), "edges")
        new = table(_small_star(star, star.count()), "edges")
        discard(now, star)
        now = new
        state, before = _state(now), state
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    root = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return root.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
