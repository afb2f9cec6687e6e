"""Splitting, tokens, sections, code and personal data."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.functions import code, pii, text
from freshet.operators import entity
from freshet.plans.registry import query

_LINES = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
p AS (SELECT doc_id, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n) - length(line) - 1 AS pos FROM l)"""


@query(f"""{_LINES}
SELECT doc_id, (pos + length(line) - length(ltrim(line)))::BIGINT AS start, trim(line) AS text FROM p WHERE trim(line) <> ''""")
def split_separator_none(spark, t):
    return text.split_lines(t.documents, "doc_id", "text")


@query(f"""{_LINES}, c AS (SELECT doc_id, pos, line || CASE WHEN pos + length(line) < (SELECT length(text) FROM documents d WHERE d.doc_id = p.doc_id) THEN chr(10) ELSE '' END AS piece FROM p)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS ordinal, pos::BIGINT AS char_offset, piece AS text FROM c WHERE piece <> ''""")
def split_separator_keep(spark, t):
    splitter = text.SeparatorSplitter((r"\n",), keep_separator="left", trim=False)
    return text.split_column(t.documents, "doc_id", "text", splitter).select("doc_id", "ordinal", F.col("start.char_offset").alias("char_offset"), "text")


@query()
def split_recursive(spark, t):
    return text.split_column(t.documents, "doc_id", "text", text.RecursiveSplitter(), chunk_size=800, chunk_overlap=100).select("doc_id", "ordinal", "text", F.col("start.byte_offset").alias("first_byte"), F.col("end.byte_offset").alias("last_byte"), F.col("start.line").alias("line"))


@query("SELECT count(*) AS documents, true AS inside, true AS small, true AS whole FROM documents WHERE trim(text) <> ''")
def chunk_coverage(spark, t):
    """Whether every chunk is part of its text, no larger than asked for unless one word is, and no word is lost."""
    docs = text.split_rows(t.documents.select("text").where(F.col("text").rlike(r"[^\p{Zs}]")), "text", text.RecursiveSplitter(), chunk_size=800)
    small = F.forall("chunks", lambda c: (F.octet_length(c["text"]) <= 800) | ~c["text"].rlike(f"[^{text.BLANKS}][{text.BLANKS}]"))
    per = docs.select(small.alias("small"), text.covered(F.col("text"), F.col("chunks")).alias("pieces"))
    inside, whole = F.forall("pieces", lambda p: p["inside"]), ~F.exists("pieces", lambda p: p["gap"].rlike(f"[^{text.DROPPED}]"))
    every = lambda c: F.coalesce(F.every(c), F.lit(True))
    return per.agg(F.count("*").alias("documents"), every(inside).alias("inside"), every("small").alias("small"), every(whole).alias("whole"))


@query("""
SELECT page_id, CASE WHEN path LIKE '%.html' THEN 'html' WHEN path LIKE '%.py' THEN 'python' END AS language
FROM (SELECT page_id, lower(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/', ''), '[?#].*$', '')) || CASE page_id % 3 WHEN 0 THEN '.py' ELSE '' END AS path FROM pages)""")
def detect_language(spark, t):
    path = F.concat(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*/", ""), "[?#].*$", ""), F.when(F.col("page_id") % 3 == 0, ".py").otherwise(""))
    return t.pages.select("page_id", text.detect_language(path).alias("language"))


_TOKENS = "tok AS (SELECT doc_id, source, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: length(w) >= 2)) AS token FROM documents)"


@query(f"""WITH {_TOKENS}, c AS (SELECT doc_id, token, count(*) AS n FROM tok GROUP BY 1, 2)
SELECT doc_id, token, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, token) AS rank FROM c QUALIFY rank <= 6""")
def token_topk(spark, t):
    return text.top_tokens(t.documents, "doc_id", "text").withColumn("rank", F.col("rank").cast("bigint"))


@query("""
WITH s AS (SELECT source, lang, len(string_split(text, chr(10))) AS n, [length(text), len(string_split(text, ' ')), len(string_split(text, '.'))] AS f FROM documents),
f AS (SELECT source, i, sum(f[i])::BIGINT AS v FROM s, range(1, 4) r(i) GROUP BY 1, 2)
SELECT s.source, count(*) AS files, sum(n)::BIGINT AS sections, count(DISTINCT lang) AS languages, any_value(t.totals) AS feature_totals
FROM s JOIN (SELECT source, list(v ORDER BY i) AS totals FROM f GROUP BY 1) t USING (source) GROUP BY 1""")
def section_summary(spark, t):
    """Counts of a collection and the element-wise sum of its files' feature vectors."""
    parts = lambda sep: F.size(F.split("text", sep)).cast("bigint")
    s = t.documents.select("source", "lang", parts("\n").alias("n"), F.array(F.length("text").cast("bigint"), parts(" "), parts(r"\.")).alias("f"))
    head = s.groupBy("source").agg(F.count("*").alias("files"), F.sum("n").alias("sections"), F.count_distinct("lang").alias("languages"), *[F.sum(F.col("f")[i]).alias(f"f{i}") for i in range(3)])
    return head.select("source", "files", "sections", "languages", F.array("f0", "f1", "f2").alias("feature_totals"))


@query("SELECT doc_id, len(regexp_extract_all(text, '\\d{3}-\\d{2}-\\d{4}')) > 0 AS maybe_ssn, length(regexp_replace(text, '[^@]', '', 'g')) AS at_signs FROM documents")
def pii_hints(spark, t):
    return t.documents.select("doc_id", (F.regexp_count("text", F.lit(r"\d{3}-\d{2}-\d{4}")) > 0).alias("maybe_ssn"), F.length(F.regexp_replace("text", "[^@]", "")).cast("bigint").alias("at_signs"))


@query()
def pii_counts(spark, t):
    n = pii.counts(F.col("text"))
    return t.documents.select("doc_id", *[c.alias(k) for k, c in n.items()])


@query()
def pii_redact(spark, t):
    return t.documents.select("doc_id", F.sha2(pii.redact(F.col("text")), 256).alias("redacted_fp"))


@query("""
SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(coalesce(text, ''), '[A-Za-z_][A-Za-z0-9_]*'), lambda x: length(x) >= 3))) AS terms FROM documents""")
def index_terms(spark, t):
    return t.documents.select("doc_id", code.index_terms(F.col("text")).alias("terms"))


@query(f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: length(x) >= 2) AS ws FROM documents)
SELECT doc_id, greatest(len(ws) - 2, 0)::BIGINT AS n, CASE WHEN len(ws) >= 3 THEN array_to_string(ws[1:3], ' ') END AS first_shingle FROM w""")
def shingle_windows(spark, t):
    s = text.shingles(text.ascii_words(F.col("text")), 3)
    both = text.let(s, lambda runs: F.struct(F.size(runs).cast("bigint").alias("n"), F.try_element_at(runs, F.lit(1)).alias("first_shingle")))
    return t.documents.select("doc_id", both.alias("both")).select("doc_id", "both.n", "both.first_shingle")


@query("""
SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS similarity
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4""")
def entity_edges(spark, t):
    found = entity.similar_pairs(t.embeddings, 0.6, "vec_id", "embedding")
    return found.select("a", "b", F.round("similarity", 4).alias("similarity"))


@query("""
WITH RECURSIVE e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT x AS name, min(y) AS canonical FROM r GROUP BY 1""")
def entity_components(spark, t):
    """With the least name of each component as the canonical one."""
    from freshet.operators.graph import connected

    pairs = entity.similar_pairs(t.embeddings, 0.6, "vec_id", "embedding")
    roots = connected(pairs.select("a", "b"))
    return t.embeddings.select(F.col("vec_id").alias("name")).join(roots, F.col("name") == F.col("node"), "left").select("name", F.coalesce("root", "name").alias("canonical"))


@query()
def entity_canonicals(spark, t):
    named = t.embeddings.select(F.format_string("v%07d", "vec_id").alias("name"), "embedding", (F.col("vec_id") % 5 == 0).alias("known"))
    return entity.resolve_entities(named, entity.first_candidate, existing="known")
