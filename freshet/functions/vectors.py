"""Distances between vectors in array columns, and searches by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Null if either vector is null or zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def euclidean_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(euclidean_squared(a, b))


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(a: Column) -> Column:
    return F.transform(_double(a), lambda x: F.try_divide(x, norm(a)))


#: name: (expression, whether smaller is nearer)
METRICS = {
    "cosine": (lambda a, b: F.lit(1.0) - cosine_similarity(a, b), True),
    "cosine_distance": (lambda a, b: F.lit(1.0) - cosine_similarity(a, b), True),
    "l2": (euclidean, True),
    "euclid": (euclidean, True),
    "l2_distance": (euclidean, True),
    "euclidean_squared": (euclidean_squared, True),
    "manhattan": (manhattan, True),
    "ip": (dot, False),
    "dot": (dot, False),
    "inner_product": (dot, False),
}


def metric(name: str):
    """(expression, ascending); an unknown name is an error."""
    if name not in METRICS:
        raise ValueError(f"no metric {name}")
    return METRICS[name]


def knn(rows: DataFrame, query: list[float], k: int, *, vector: str = "embedding", key: str = "id", by: str = "cosine", where: Column | None = None) -> DataFrame:
    """The k nearest rows to one vector, ties by key, as `rank` and `distance` with all columns of rows.

    Rows whose distance is null or NaN are left out. Each task keeps k rows; no full sort.
    """
    measure, ascending = metric(by)
    scored = (rows if where is None else rows.where(where)).withColumn("distance", measure(F.col(vector), F.array(*[F.lit(float(x)) for x in query])))
    best = scored.where(F.col("distance").isNotNull() & ~F.isnan("distance")).orderBy(F.col("distance").asc() if ascending else F.col("distance").desc(), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("distance").asc() if ascending else F.col("distance").desc(), key)))


def knn_per_group(rows: DataFrame, query: list[float], k: int, group: str, *, vector: str = "embedding", key: str = "id", by: str = "cosine") -> DataFrame:
    """The k nearest of each group. Every task first keeps the k nearest of each group among its own rows."""
    measure, ascending = metric(by)
    scored = rows.withColumn("distance", measure(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))).where("distance is not null")
    sign = F.col("distance") if ascending else -F.col("distance")
    w = Window.partitionBy(group).orderBy(sign, key)
    # Spark turns a limit on row_number into a limit per group before the shuffle
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


QUERY_BLOCK = 4_096  # query tokens sent to all tasks at once


def max_sim(tokens: DataFrame, query_tokens: DataFrame, group: str, vector: str = "embedding", query_id: str = "query_id") -> DataFrame:
    """(group, score): the sum over query tokens of the greatest cosine with a token of the group. Query tokens are sent to all tasks, a block of bounded size at a time."""
    q = query_tokens.select(F.col(query_id).alias("__q"), F.col(vector).alias("__qv"))
    blocks = max(1, -(-q.count() // QUERY_BLOCK))
    best = None
    for b in range(blocks):
        some = q if blocks == 1 else q.where(F.pmod(F.xxhash64("__q"), F.lit(blocks)) == b)
        pairs = tokens.select(group, vector).join(F.broadcast(some))
        part = pairs.groupBy(group, "__q").agg(F.max(cosine_similarity(F.col(vector), F.col("__qv"))).alias("s"))
        best = part if best is None else best.unionByName(part)
    return best.groupBy(group).agg(F.sum("s").alias("score"))


def sparse_idf_scores(docs: DataFrame, terms: list[str], key: str, tokens: str) -> DataFrame:
    """(key, score): sum over query terms of tf * ln(N / df); documents without a term are left out."""
    total = docs.agg(F.count("*").alias("n"))
    hits = docs.select(key, F.explode(tokens).alias("term")).where(F.col("term").isin(terms)).groupBy(key, "term").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(total))
    return hits.join(F.broadcast(df), "term").groupBy(key).agg(F.sum(F.col("tf") * F.log(F.col("n") / F.col("df"))).alias("score"))


def reciprocal_rank_fusion(ranked: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """(key, score): sum of 1 / (k + rank) over lists of (key, rank); a key missing from a list adds nothing."""
    parts = ranked[0].select(key, "rank")
    for r in ranked[1:]:
        parts = parts.unionByName(r.select(key, "rank"))
    return parts.groupBy(key).agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score"))


def _place(marks: Column, many: int, value: Column, key: Column) -> Column:
    """How many of the sorted (v, k) marks stand before a value and key, by halving."""
    steps = [1 << i for i in reversed(range(many.bit_length()))]

    def halve(at: Column, step: Column) -> Column:
        m = F.get(marks, at + step - 1)
        return F.when((m["v"] < value) | ((m["v"] == value) & (m["k"] < key)), at + step).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), halve)


def fused_top_k(rows: DataFrame, key: str, values: list[Column], k: int = 10, c: int = 60) -> DataFrame:
    """(key, score): the k best rows by reciprocal rank fusion of several orders, each by a value, least first, ties by key.

    Exact, without ranking all rows: the k first rows of one order score 1 / (c + k) or more,
    so with n orders no row beyond place n * (c + k) - c of all of them can be among the best.
    The few rows before that place are fetched, and a pass for each order counts how many rows precede them.
    Rows with one key and equal values count as one candidate; a key with other values again
    is an error. Rows with a null key or value are left out.
    """
    n = len(values)
    first = n * (c + k) - c
    names = [f"v{i}" for i in range(n)]
    own = rows.select(F.col(key).alias("key"), *[v.alias(x) for v, x in zip(values, names, strict=True)])
    own = own.where(" and ".join(f"{x} is not null" for x in ["key", *names]))
    few = own.orderBy(names[0], "key").limit(first)
    for x in names[1:]:
        few = few.unionByName(own.orderBy(x, "key").limit(first))
    found: dict = {}
    for r in few.collect():  # n * first rows at most
        if found.setdefault(r["key"], r) != r:
            raise ValueError(f"{r['key']!r} is the key of rows with different values")
    kind = own.schema["key"].dataType.simpleString()
    if not found:
        return own.select(F.col("key").alias(key), F.lit(0.0).alias("score")).limit(0)
    ranks: list[dict] = []
    for x in names:
        order = sorted((r[x], r["key"]) for r in found.values())
        marks = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(k).alias("k")) for v, k in order])
        # how many of the few stand before a row; rows with the same number are counted together
        place = _place(marks, len(order), F.col(x), F.col("key"))
        counts = {r["place"]: r["count"] for r in own.groupBy(place.alias("place")).count().collect()}
        total, at = 0, {}
        for j, (_, row) in enumerate(order):
            total += counts.get(j, 0)
            at[row] = total
        ranks.append(at)
    scores = [(row, sum(1.0 / (c + at[row]) for at in ranks)) for row in found]
    best = sorted(scores, key=lambda s: (-s[1], s[0]))[:k]
    return rows.sparkSession.createDataFrame(best, f"`{key}` {kind}, score double")
