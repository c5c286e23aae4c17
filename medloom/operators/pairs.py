"""Pairs within baskets and their interactions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medloom.functions.rules import SEVERITY, severity, severity_rank
from medloom.functions.text import name_key
from medloom.runtime import materialise


def basket_pairs(items: DataFrame, basket: str, item: str) -> DataFrame:
    """``basket``, ``a``, ``b``: the unordered pairs of distinct items of a basket, a before b."""
    one = items.select(basket, item).where(F.col(item) != "").distinct()
    return one.withColumnRenamed(item, "a").join(one.withColumnRenamed(item, "b"), basket).where("a < b")


def ingredient_pairs(drugs: DataFrame, rules: DataFrame, ingredients: Callable[[Column], Column] | None = None, partitions: int | None = None) -> DataFrame:
    """Interactions of two different drugs of one request: both ingredients of a rule, one in each.

    ``drugs``: request, drug, ingredient; ``rules``: ingredient_a, ingredient_b, severity_text, dedupe_key. Each pair of
    drugs comes once per rule. ``ingredients`` gives the ingredients of a drug as an array where its name holds them; the column
    ingredient is not read then.

    The drugs are shuffled once, by request; pairs, their rules and what is grouped by request come from there
    without another shuffle. Rules join by their size as a table, so few are broadcast. As results are many times the drugs, the
    number of ``partitions`` is best in proportion to these; without one it is Spark's.
    """
    item = F.struct("drug", "ingredient") if ingredients is None else F.struct("drug")
    held = drugs.where("request IS NOT NULL AND drug IS NOT NULL").select("request", item.alias("item"))
    held = held.repartition("request") if partitions is None else held.repartition(partitions, "request")
    parts = (lambda i: F.array(i["ingredient"])) if ingredients is None else (lambda i: ingredients(i["drug"]))
    keyed = F.transform(F.collect_set("item"), lambda i: F.struct(name_key(i["drug"]).alias("key"), i["drug"].alias("drug"), parts(i).alias("ingredients")))
    baskets = held.groupBy("request").agg(keyed.alias("drugs")).where(F.size("drugs") > 1)
    first = baskets.select("request", "drugs", F.explode("drugs").alias("x"))
    both = first.select("request", "x", F.explode(F.filter("drugs", lambda d: d["key"] > F.col("x")["key"])).alias("y"))
    ends = ["request", F.col("x.key").alias("key_x"), F.col("x.drug").alias("drug_x"), F.col("y.key").alias("key_y"), F.col("y.drug").alias("drug_y")]
    words = both.select(*ends, F.explode("x.ingredients").alias("of_x"), F.col("y.ingredients").alias("of_y")).withColumn("of_y", F.explode("of_y"))
    rated = rules.where("ingredient_a IS NOT NULL AND ingredient_b IS NOT NULL").withColumn("severity", severity(F.col("severity_text")))
    ways = [rated.select("*", F.col(of_x).alias("of_x"), F.col(of_y).alias("of_y"), F.lit(turned).alias("turned")) for of_x, of_y, turned in (("ingredient_a", "ingredient_b", False), ("ingredient_b", "ingredient_a", True))]
    met = words.join(materialise(ways[0].union(ways[1]), "rules"), ["of_x", "of_y"])
    drug = lambda one, other: F.when(F.col("turned"), F.col(other)).otherwise(F.col(one))
    pair = met.withColumns({"drug_a": drug("drug_x", "drug_y"), "drug_b": drug("drug_y", "drug_x")})
    best = F.min(F.struct("drug_a", "drug_b", "ingredient_a", "ingredient_b", "severity_text", "severity")).alias("i")
    return pair.groupBy("request", "key_x", "key_y", "dedupe_key").agg(best).select("request", "i.*")


def severity_summary(found: DataFrame, by: str, name: str = "severity") -> DataFrame:
    """Counts per severity, zero-filled, the total and the highest ('unknown' where there is none)."""
    counts = [F.count_if(F.col(name) == s).alias(f"n_{s}") for s in SEVERITY]
    return found.groupBy(by).agg(*counts, F.count("*").alias("total"), F.coalesce(F.min_by(name, severity_rank(F.col(name))), F.lit("unknown")).alias("highest"))


def either_end(pairs: DataFrame, a: str, b: str, key: Column) -> DataFrame:
    """Pairs with the key at either end."""
    return pairs.where((F.col(a) == key) | (F.col(b) == key))


def both_ends(pairs: DataFrame, a: str, b: str, keys: DataFrame, key: str) -> DataFrame:
    """Pairs whose ends are both among the keys."""
    known = keys.select(key).distinct()
    return pairs.join(known.withColumnRenamed(key, a), a, "left_semi").join(known.withColumnRenamed(key, b), b, "left_semi")


def endpoint_catalogue(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Every end with its count over all records and its shortest spelling (by key)."""
    ends = pairs.select(F.explode(F.array(a, b)).alias("label")).withColumn("key", name_key(F.col("label"))).where("key <> ''")
    return ends.groupBy("key").agg(F.count("*").alias("n"), F.min_by("label", F.struct(F.length("label"), "label")).alias("label"))


def severity_groups(found: DataFrame, by: str) -> DataFrame:
    """Per ``by`` the interactions grouped by their original severity text: ``place``, ``severity_text``, ``severity``, ``n`` and
    the sorted pairs. Groups are in order of severity, of one severity in Vietnamese order of the text."""
    groups = found.groupBy(by, "severity_text", "severity").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("drug_a", "drug_b"))).alias("interactions"))
    order = Window.partitionBy(by).orderBy(severity_rank(F.col("severity")), F.collate("severity_text", "vi"), "severity_text")
    return groups.select(by, F.row_number().over(order).alias("place"), "severity_text", "severity", "n", "interactions")


def severity_per_item(found: DataFrame, by: str) -> DataFrame:
    """Per ``by`` and drug the highest severity of its interactions, and how many it has."""
    ends = found.select(by, "severity", F.explode(F.array("drug_a", "drug_b")).alias("drug"))
    return ends.groupBy(by, "drug").agg(F.min_by("severity", severity_rank(F.col("severity"))).alias("highest"), F.count("*").alias("n"))
