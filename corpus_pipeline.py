"""From raw documents to token files, in five stages; each works on all that the one before kept."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.decontaminate import decontaminate
from freshet.llm.language_id import fit_language_model, held_out, keep_languages
from freshet.llm.mixing import mix
from freshet.llm.ngram_join import one_of_each_class
from freshet.llm.runtime import discard, table
from freshet.llm.token_output import token_output
from freshet.shipping import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
VOCABULARY, END_ID = "word_bpe_49k.json", 2


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told; learned from those with a language that are not held out."""
    ship(spark)
    docs = docs.select(COLUMNS)
    model = fit_language_model(docs.where(~held_out(F.col("doc_id"), 4, 2)), F.col("text"), F.col("lang"), F.col("doc_id"))
    return keep_languages(docs, model)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the least id, of each group of near copies."""
    ship(spark)
    return one_of_each_class(docs.select(COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    ship(spark)
    return decontaminate(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources get their target shares; the order of the rows that are written is the mix's global random order."""
    ship(spark)
    return mix(docs.select(COLUMNS)).sortWithinPartitions("position").select(COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token files, documents in the order in which the mixing stage wrote them, and returns each copy's place, size and checksum as read back.

    That order is the place of a row in its files; documents that come from no files are in ascending order of their ids.
    """
    import public_tokenizers

    ship(spark)
    order = None
    try:
        docs = docs.select(*COLUMNS, F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.row_index").alias("row_index"))
        order = [F.length("file_name"), F.col("file_name"), F.col("row_index")]  # part numbers of more than five digits are longer
    except AnalysisException:  # rows of no files
        docs = docs.select(COLUMNS)
    return token_output(docs, public_tokenizers.path(VOCABULARY), END_ID, order=order)


STAGES = [
    ("language_id", language_stage),
    ("ngram_jaccard_join", near_copy_stage),
    ("decontamination", decontamination_stage),
    ("poisson_mix", mixing_stage),
    ("token_output", token_stage),
]

#: Learned weights and file formats are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = table(stage(spark, docs, sf_dir), name)
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
