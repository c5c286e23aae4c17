"""Queries of problem 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medloom.llm.spans import SharedSpans
from medloom.runtime import table


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SharedSpans(table(spark, sf_dir, "documents")).pairs()


def p9_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per sharing document: how many of its characters, and what share of it, lie in spans shared elsewhere."""
    documents = table(spark, sf_dir, "documents")
    shared = SharedSpans(documents).coverage()
    length = documents.groupBy("doc_id").agg(F.max(F.length("text")).cast("bigint").alias("chars"))
    told = shared.join(length, "doc_id").withColumn("shared_chars", F.coalesce("shared_chars", "chars"))
    return told.select("doc_id", "chars", "shared_chars", "spans", F.round(F.col("shared_chars") / F.col("chars"), 4).alias("shared_share"))


def p9_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per sharing document: the first document of equal text, how many there are, and the other texts it shares spans with."""
    return SharedSpans(table(spark, sf_dir, "documents")).members_of()


def p9_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shared phrases of the greedy parse of each text, with where each is copied from."""
    return SharedSpans(table(spark, sf_dir, "documents")).parse()


QUERIES = {"p9_found": p9_found, "p9_coverage": p9_coverage, "p9_classes": p9_classes, "p9_phrases": p9_phrases}

_GRAMS = """docs AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 300),
grams AS (SELECT doc_id, i, md5(substring(text, i::BIGINT, 300)) AS g FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM docs))"""
SQL = {
    "p9_found": f"""WITH {_GRAMS}, held AS (SELECT DISTINCT doc_id, g FROM grams)
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM held a JOIN held b ON a.g = b.g AND a.doc_id < b.doc_id""",
    "p9_coverage": f"""WITH {_GRAMS}, shared AS (SELECT g FROM grams GROUP BY g HAVING count(DISTINCT doc_id) > 1),
hits AS (SELECT doc_id, i, lead(i) OVER w AS ahead, lag(i) OVER w AS before FROM (SELECT DISTINCT doc_id, i FROM grams JOIN shared USING (g)) WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
sums AS (SELECT doc_id, CAST(sum(least(300, coalesce(ahead - i, 300))) AS BIGINT) AS shared_chars, count(*) FILTER (before IS NULL OR i - before > 300) AS spans FROM hits GROUP BY doc_id)
SELECT doc_id, length(text) AS chars, shared_chars, spans, round(shared_chars / length(text), 4) AS shared_share FROM sums JOIN docs USING (doc_id)""",
    "p9_classes": f"""WITH {_GRAMS}, texts AS (SELECT text, min(doc_id) AS class_id, count(*) AS copies FROM docs GROUP BY text), held AS (SELECT DISTINCT class_id, g FROM grams JOIN texts ON doc_id = class_id),
links AS (SELECT a.class_id, count(DISTINCT b.class_id) AS links FROM held a JOIN held b ON a.g = b.g AND a.class_id <> b.class_id GROUP BY a.class_id)
SELECT doc_id, class_id, copies, coalesce(links, 0) AS links FROM docs JOIN texts USING (text) LEFT JOIN links USING (class_id) WHERE copies > 1 OR links IS NOT NULL""",
}
