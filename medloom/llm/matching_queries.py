"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medloom.llm.matching import known_brands, match_products, read_records
from medloom.runtime import table


def p4_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of different tables for the same product, with the confidence of the rules that brought them together."""
    kb = table(spark, sf_dir, "vaipe_drugs_kb").withColumn("brand", F.when(F.trim("brand") != "", F.col("brand")))
    records = (
        read_records(table(spark, sf_dir, "drug_db_vn"), "drug_db_vn", "row_id", "brand_name", None, "generic_name", "dosage")
        .union(read_records(table(spark, sf_dir, "pill_info_vn"), "pill_info_vn", "row_id", "brand_name", None, "generic_name", "dosage"))
        .union(read_records(kb, "vaipe_drugs_kb", "id", "brand", "name", "name", "dosage", "sample_texts"))
    )
    return match_products(records, known_brands(table(spark, sf_dir, "brand_list"), table(spark, sf_dir, "ingredient_list")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_matches(spark, sf_dir).where("confidence >= 0.5").select("left_tbl", "left_id", "right_tbl", "right_id")


QUERIES = {"p4_found": p4_found, "p4_matches": p4_matches}
SQL: dict[str, str] = {}
