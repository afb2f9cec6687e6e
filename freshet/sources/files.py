"""Files of any store that Spark reads, as keyed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions.text import decode_bom
from freshet.sources.match import MATCH_ALL, PatternMatcher


def walk(spark: SparkSession, root: str, *, recursive: bool = False, matcher: PatternMatcher = MATCH_ALL, prefix: str = "", max_file_size: int | None = None) -> DataFrame:
    """(key, path, modified, size, content): key is the path relative to `root`.

    Local folders, s3a://, abfss://, oci:// and others alike. Content is only read if it is
    selected. `prefix` narrows the listing itself.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    base = root.rstrip("/")
    files = reader.load(f"{base}/{prefix}*" if prefix else base)
    bare = base.split("://", 1)[-1] if "://" in base else base.removeprefix("file:")
    key = F.substring_index(F.col("path"), bare.rstrip("/") + "/", -1)
    out = files.select(key.alias("key"), "path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")
    out = out if max_file_size is None else out.where(F.col("size") <= max_file_size)
    return out.where(matcher.column(F.col("key")))


def read_object(spark: SparkSession, uri: str, size: int | None = None) -> DataFrame:
    """One file, or its first bytes."""
    content = F.col("content") if size is None else F.substring("content", 1, size)
    return spark.read.format("binaryFile").load(uri).select("path", F.col("length").alias("size"), content.alias("content"))


def texts(files: DataFrame) -> DataFrame:
    """`files` with their text, by byte order mark or as UTF-8."""
    return files.withColumn("text", decode_bom(F.col("content")))


def content_fingerprint(content: Column) -> Column:
    return F.sha2(content, 256)


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """(key, change) of two listings with key, modified and fp: added, modified, touched (time moved, content the same) or removed."""
    n, b = now.alias("n"), before.alias("b")
    change = (
        F.when(F.col("b.key").isNull(), "added").when(F.col("n.key").isNull(), "removed").when(F.col("n.modified") == F.col("b.modified"), None).when(F.col("n.fp") == F.col("b.fp"), "touched").otherwise("modified")
    )
    return n.join(b, F.col("n.key") == F.col("b.key"), "full_outer").select(F.coalesce("n.key", "b.key").alias("key"), change.alias("change")).where("change is not null")


# Path algebra on columns.
def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    return F.regexp_extract(name(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(name(path), r"(?<=.)\.[^.]+$", "")


def with_suffix(path: Column, new: str) -> Column:
    return F.concat(F.when(parent(path) == "", F.lit("")).otherwise(F.concat(parent(path), F.lit("/"))), stem(path), F.lit(new))


def with_name(path: Column, new: str) -> Column:
    """The path with another last part."""
    return F.concat(F.when(parent(path) == "", F.lit("")).otherwise(F.concat(parent(path), F.lit("/"))), F.lit(new))


def match(path: Column, pattern: str) -> Column:
    """Whether a path fits a glob pattern; a pattern without a slash is matched with the last part."""
    from freshet.sources.match import PatternMatcher

    return PatternMatcher((pattern if "/" in pattern else f"**/{pattern}",)).column(path)


def relative_to(path: Column, root: str) -> Column:
    """The rest of a path below `root`, null if it is elsewhere."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 30))
