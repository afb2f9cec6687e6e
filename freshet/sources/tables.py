"""Tables of databases and of files, as keyed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.schema import require_identifier


def table_source(spark: SparkSession, table: str, columns: list[str] | None = None, *, url: str | None = None, schema_name: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Columns of a database table by JDBC, or of a Parquet path if there is no url. Names are checked; columns and filters go down to the source."""
    if url:
        name = ".".join(require_identifier(n) for n in ([schema_name] if schema_name else []) + [table])
        df = spark.read.format("jdbc").options(url=url, dbtable=name, **(options or {})).load()
    else:
        df = spark.read.parquet(table)
    return df.select([require_identifier(c) for c in columns]) if columns else df


def keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    """`df` with `key`: its key columns as an array of text."""
    return df.withColumn("key", F.array(*[F.col(k).cast("string") for k in keys]))


def csv_to_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(key, value): the first column, and the row as JSON."""
    return pairs(spark.read.option("header", "true").csv(path))


def pairs(df: DataFrame) -> DataFrame:
    return df.select(F.col(df.columns[0]).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def route(df: DataFrame, value: str, field: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose JSON has the field, the others)."""
    has = F.get_json_object(value, f"$.{field}").isNotNull()
    return df.where(has), df.where(~has)
