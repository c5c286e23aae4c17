"""Queries of problem 5: strengths of two tables in common units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medloom.operators.units import convert, read_quantities
from medloom.runtime import materialise, table

TABLES = ("drug_db_vn", "prescription_plan_drugs")


def p5_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every quantity, converted or put up for review, with the unit model's confidence."""
    vn = read_quantities(table(spark, sf_dir, TABLES[0]), TABLES[0], "row_id", "dosage", beside=("brand_name",), category="category")
    plan = read_quantities(table(spark, sf_dir, TABLES[1]), TABLES[1], "id", "dosage", named=("notes",))
    return convert(materialise(vn.union(plan), "quantities"), TABLES)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities whose unit is written, and bare numbers whose unit the model is sure of; a bare number is a case only
    where the same row names some unit, whichever the model then decides for."""
    units = p5_units(spark, sf_dir)
    cases = units.where("status = 'written' OR (status = 'predicted' AND evidence IS NOT NULL)")
    return cases.select("tbl", "row_key", "part_no", "unit", "amount")


QUERIES = {"p5_found": p5_found, "p5_units": p5_units}
SQL: dict[str, str] = {}
