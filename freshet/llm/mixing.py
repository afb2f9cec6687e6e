"""Mixing sources to target weights, by Poisson replication (operator 2).

Each domain has a mean repetition rate: its target share of all bytes over its own share.
A document's count is the inverse of the Poisson distribution with that mean, at a uniform
number hashed from a seed and its id; the document is repeated that often, and all copies
are brought into one global random order: they are dealt by ranges of a hash, and counted
within them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm.runtime import partitions, table

_TWO52 = float(1 << 52)
BUCKET_BYTES = 64 << 20  # of text, about, in a bucket of the random order
MOST_DIGITS = 5  # 1,048,576 buckets at most: their counts are sent to all tasks


def uniform(seed: str, *keys: Column) -> Column:
    """A number from 0 up to 1, from 52 bits of an MD5 digest of seed and keys; null keys count as empty."""
    joined = F.concat_ws(":", F.lit(seed), *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("double") / _TWO52


def domain_rates(docs: DataFrame, domain_col: str = "source", text_col: str = "text", weights: dict[str, float] | None = None, exponent: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """(domain, rate, cdf): of each domain the mean repetition rate and the Poisson distribution up to where it is 1.

    Targets are `weights` (domains without one get 0), or each domain's bytes to the power
    `exponent`; they are scaled to `epochs` times all bytes. A domain without bytes has
    rate 0, unless no domain has any: then all have `epochs`.
    """
    size = docs.groupBy(F.col(f"`{domain_col}`").alias("domain")).agg(F.sum(F.octet_length(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))).cast("long").alias("bytes"))
    if weights is None:
        aim = F.pow(F.col("bytes").cast("double"), F.lit(float(exponent)))
    else:
        aim = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.coalesce(F.col("domain").cast("string"), F.lit(""))), F.lit(0.0)) if weights else F.lit(0.0)
    size = size.withColumn("aim", aim)
    total = size.agg(F.sum("bytes").alias("all_bytes"), F.sum("aim").alias("all_aims"))
    rate = F.when(F.col("all_bytes") == 0, F.lit(float(epochs))).when(F.col("bytes") == 0, F.lit(0.0)).otherwise(F.lit(float(epochs)) * F.coalesce(F.try_divide(F.col("aim"), F.col("all_aims")), F.lit(0.0)) * F.col("all_bytes") / F.col("bytes"))
    rated = size.join(F.broadcast(total)).select("domain", "bytes", rate.alias("rate"))  # the total is one row
    top = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    kind = "struct<log:double,sum:double,cdf:array<double>>"
    start = F.struct((-F.col("rate")).alias("log"), F.exp(-F.col("rate")).alias("sum"), F.array(F.exp(-F.col("rate"))).alias("cdf")).cast(kind)

    def step(acc: Column, k: Column) -> Column:
        log = acc["log"] + F.log(F.col("rate")) - F.log(k.cast("double"))
        total = acc["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.array_append(acc["cdf"], total).alias("cdf")).cast(kind)

    cdf = F.when(F.col("rate") > 0, F.aggregate(F.sequence(F.lit(1), top), start, step, lambda a: a["cdf"])).otherwise(F.array(F.lit(1.0)))
    return rated.select("domain", "bytes", "rate", cdf.alias("cdf"))


def mix(docs: DataFrame, id_col: str = "doc_id", domain_col: str = "source", text_col: str = "text", weights: dict[str, float] | None = None, exponent: float = 0.5, epochs: float = 1.0, seed: str = "mix-1") -> DataFrame:
    """All columns of `docs` for each copy, and `copy` (from 1), `copies` (of its document) and `position` (from 0, in the global order).

    Documents may get no copy. Null ids count as empty text for the draw, a null domain is a
    domain of its own. Rows repeated under one id are drawn alike; their order among
    themselves follows a hash of all columns that have one (maps do not). A column of `docs`
    that has the name of an added one is replaced. Partitions hold ranges of positions, in
    order. An empty table stays empty.
    """
    known = table(domain_rates(docs, domain_col, text_col, weights, exponent, epochs), "rates")
    rates = known.select(F.col("domain").alias("__domain"), F.col("cdf").alias("__cdf"))
    size = known.agg(F.coalesce(F.sum(F.col("bytes") * F.col("rate")), F.lit(0.0))).first()[0]
    digits = 3
    while 16**digits * BUCKET_BYTES < size and digits < MOST_DIGITS:
        digits += 1
    own = docs.drop("copy", "copies", "position")
    key = F.col(f"`{id_col}`")
    joined = own.join(rates, F.col(f"`{domain_col}`").eqNullSafe(F.col("__domain")))
    draw = uniform(seed, key)
    counted = joined.withColumn("copies", F.size(F.filter("__cdf", lambda c: c <= draw)).cast("long")).drop("__domain", "__cdf").where("copies > 0")
    many = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    order = F.md5(F.concat_ws(":", F.lit(seed + " order"), F.coalesce(key.cast("string"), F.lit("")), F.col("copy").cast("string")))
    # buckets of the order; a row's place is what stands in earlier buckets and before it in its own
    many = many.withColumn("__order", order).withColumn("__bucket", F.substring("__order", 1, digits))
    sizes = many.groupBy("__bucket").agg(F.count("*").alias("n"))
    before = sizes.select("__bucket", (F.sum("n").over(Window.orderBy("__bucket")) - F.col("n")).alias("__before"))
    plain = [F.col(f"`{f.name}`") for f in own.schema if "map" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    ties = Window.partitionBy("__bucket").orderBy("__order", key, "copy", F.xxhash64(*plain))
    placed = many.repartitionByRange(partitions(docs.sparkSession), "__bucket").withColumn("__row", F.row_number().over(ties))
    return placed.join(F.broadcast(before), "__bucket").withColumn("position", F.col("__before") + F.col("__row") - 1).drop("__order", "__bucket", "__before", "__row")
