"""Queries over the driver's tables, one per operator, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from freshet.llm.decontaminate import find_overlaps
from freshet.llm.language_id import identify_languages
from freshet.llm.licenses import scan_licenses
from freshet.llm.media import media_columns
from freshet.llm.mixing import mix
from freshet.llm.ngram_join import ngram_jaccard_classes
from freshet.llm.quality import classify_quality
from freshet.llm.token_count import token_counts
from freshet.llm.token_output import token_output
from freshet.llm.url_filter import judge_urls

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS_SQL = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(_read(spark, sf_dir, "documents"))


def op2_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_read(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_classes(_read(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_read(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "labels"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(_read(spark, sf_dir, "documents"), _vocabulary(), end_id=2)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_read(spark, sf_dir, "documents")).drop("detections")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_read(spark, sf_dir, "documents"), _vocabulary(), limit=2048)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_overlaps(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


OP2_SQL = """
WITH size AS (SELECT source, sum(strlen(coalesce(text, '')))::BIGINT AS bytes FROM documents GROUP BY 1),
rated AS (SELECT source, CASE WHEN (sum(bytes) OVER ()) = 0 THEN 1.0 WHEN bytes = 0 THEN 0.0
                 ELSE 1.0 * (sqrt(bytes::DOUBLE) / sum(sqrt(bytes::DOUBLE)) OVER ()) * (sum(bytes) OVER ())::DOUBLE / bytes END AS rate FROM size),
terms AS (SELECT source, k, -rate + CASE WHEN k = 0 OR rate = 0 THEN 0 ELSE k * ln(rate) - lgamma(k + 1) END AS log_term, rate
          FROM rated, LATERAL (SELECT unnest(range(0, ceil(rate + 12 * sqrt(rate) + 31)::BIGINT)) AS k)),
cdf AS (SELECT source, k, sum(exp(log_term)) OVER (PARTITION BY source ORDER BY k) AS c FROM terms WHERE rate > 0 OR k = 0),
drawn AS (SELECT d.*, ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS u FROM documents d),
counted AS (SELECT doc_id, text, lang, source, n_chars, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM drawn.source AND c <= u)::BIGINT AS copies FROM drawn),
many AS (SELECT *, unnest(range(1, copies + 1)) AS copy FROM counted)
SELECT *, row_number() OVER (ORDER BY md5('mix-1 order:' || coalesce(doc_id::VARCHAR, '') || ':' || copy::VARCHAR), doc_id, copy) - 1 AS position FROM many"""

GRAMS_SQL = f"""
w AS (SELECT doc_id, text, {WORDS_SQL} AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE
        WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))
        WHEN len(ws) > 0 THEN ['short ' || array_to_string(ws, ' ')] ELSE [] END) AS gram FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y, c = p.n AND c = q.n AS same FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 10 * c >= 8 * (p.n + q.n - c)
          UNION ALL
          SELECT a.doc_id, b.doc_id, true FROM w a JOIN w b ON a.text = b.text AND a.doc_id <> b.doc_id AND len(a.ws) = 0 AND a.text <> ''),
reach AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
classes AS (SELECT x, min(y) AS class_id FROM reach GROUP BY 1),
counts AS (SELECT x, count(*) AS n_links, count(*) FILTER (same) AS n_same FROM links GROUP BY 1)"""

OP3_SQL = f"""
WITH RECURSIVE {GRAMS_SQL}
SELECT w.doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links, (1 + coalesce(n_same, 0))::BIGINT AS n_copies
FROM w JOIN classes ON classes.x = w.doc_id LEFT JOIN counts ON counts.x = w.doc_id"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_media_columns": op1_media_columns,
        "op2_poisson_mix": op2_poisson_mix,
        "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
        "op4_language_id": op4_language_id,
        "op5_url_filter": op5_url_filter,
        "op6_token_output": op6_token_output,
        "op7_quality_classifier": op7_quality_classifier,
        "op8_license_scan": op8_license_scan,
        "op9_token_counts": op9_token_counts,
        "op10_decontamination": op10_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_poisson_mix": OP2_SQL,
        "op3_ngram_jaccard_join": OP3_SQL,
    }
