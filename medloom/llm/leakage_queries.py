"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from medloom.llm.leakage import leaked
from medloom.runtime import table


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return matches.where("kind = 'exact'").select("doc_id", "item_id")


def p7_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and proximity matches, with their lengths and places."""
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), slack=3)


QUERIES = {"p7_found": p7_found, "p7_matches": p7_matches}
_WORDS = "regexp_extract_all(strip_accents(replace(lower(text), 'đ', 'd')), '[\\p{L}\\p{N}]+')"
_GRAMS = "SELECT DISTINCT {0}, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT {0}, w, unnest(range(1, len(w) - 18)) AS i FROM (SELECT {0}, {1} AS w FROM {2} WHERE text IS NOT NULL))"
SQL = {
    "p7_found": f"""WITH d AS ({_GRAMS.format("doc_id", _WORDS, "documents")}), e AS ({_GRAMS.format("item_id", _WORDS, "eval_items")})
SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (g)"""
}
