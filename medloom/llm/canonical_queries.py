"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medloom.llm.canonical import map_rows, map_values
from medloom.runtime import table

FIELDS = (("prescription_plan_drugs", "id", "drug_name"), ("drug_db_vn", "row_id", "brand_name"), ("drug_db_vn", "row_id", "generic_name"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both canonical lists as one."""
    brands = table(spark, sf_dir, "brand_list").select("entry_id", F.col("brand_name").alias("name"), F.lit("brand").alias("kind"))
    return brands.union(table(spark, sf_dir, "ingredient_list").select("entry_id", "name", F.lit("ingredient")))


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).select(F.lit(f"{t}.{c}").alias("field_name"), F.col(k).cast("string").alias("row_key"), F.col(c).alias("value")) for t, k, c in FIELDS]
    return parts[0].union(parts[1]).union(parts[2])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _typed(spark, sf_dir)
    return map_rows(rows, map_values(rows, entries(spark, sf_dir)))


def p6_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed values without an entry, with how many rows hold them."""
    rows = _typed(spark, sf_dir)
    told = rows.where(F.trim("value") != "").groupBy("field_name", "value").agg(F.count("*").alias("rows"))
    return told.join(map_values(rows, entries(spark, sf_dir)).select("value").distinct(), "value", "left_anti").select("field_name", "value", "rows")


QUERIES = {"p6_found": p6_found, "p6_unmatched": p6_unmatched}
SQL: dict[str, str] = {}
