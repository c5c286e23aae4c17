"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from medloom.llm.mixing import Mixture
from medloom.runtime import table


def _mixture(spark: SparkSession, sf_dir: str) -> Mixture:
    return Mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document of a target source is used."""
    return _mixture(spark, sf_dir).usage()


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The actual share of each source."""
    return _mixture(spark, sf_dir).shares()


def p8_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix: each slot of each output shard with the documents of its block."""
    return _mixture(spark, sf_dir).mixed()


QUERIES = {"p8_usage": p8_usage, "p8_shares": p8_shares, "p8_blocks": p8_blocks}
SQL: dict[str, str] = {}
