"""Resolving names against a dimension: trigram search, tiers, fallbacks, substring rules.

A trigram similarity above 0 needs a common trigram, so the similarity join goes
through an inverted index of trigrams: candidates come from an equi-join, and
no pair without a common trigram is ever built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom.functions.similarity import trigrams
from medloom.operators.dedupe import top_per_group


def trigram_join(asked: DataFrame, query: str, names: DataFrame, name: str, least: float) -> DataFrame:
    """``query``, ``name``, ``sim`` of all pairs of distinct texts with a trigram similarity of ``least`` or more."""
    a = asked.select(query).distinct().withColumn("_a", trigrams(F.col(query)))
    b = names.select(name).distinct().withColumn("_b", trigrams(F.col(name)))
    a = a.select(query, F.size("_a").alias("_m"), F.explode("_a").alias("_g"))
    b = b.select(name, F.size("_b").alias("_n"), F.explode("_b").alias("_g"))
    shared = a.join(b, "_g").groupBy(query, "_m", name, "_n").agg(F.count("*").alias("_s"))
    sim = F.col("_s") / (F.col("_m") + F.col("_n") - F.col("_s"))
    return shared.select(query, name, sim.alias("sim")).where(F.col("sim") >= least)


def tiered_resolve(asked: DataFrame, query: str, names: DataFrame, name: str, least: float = 0.2) -> DataFrame:
    """The best ``name`` for every query: equal ones first, then those that start with it, then the most similar; ties by name."""
    low_q, low_n = F.lower(query), F.lower(name)
    near = trigram_join(asked, query, names, name, least)
    tier = F.when(low_q == low_n, 0).when(low_n.startswith(low_q), 1).otherwise(2)
    return top_per_group(near.withColumn("tier", tier), [query], [F.col("tier"), F.desc("sim"), F.col(name)])


def tier_search(names: DataFrame, name: str, text: str, limit: int = 20) -> DataFrame:
    """Names that contain ``text``: prefix matches before others, in name order."""
    key = F.lower(name)
    wanted = text.lower()
    rank = F.when(key.startswith(wanted), 0).when(key.contains(wanted), 1).otherwise(2)
    return names.withColumn("tier", rank).where("tier < 2").orderBy("tier", name).limit(max(1, min(50, limit)))


def first_hit(asked: DataFrame, keys: Sequence[str], rules: Sequence[tuple[Column, DataFrame]], order: Sequence[Column]) -> DataFrame:
    """Per query the row of the first rule that hits; rules are (join condition, dimension)."""
    hits = None
    for k, (condition, dimension) in enumerate(rules):
        part = asked.join(dimension, condition).withColumn("tier", F.lit(k))
        hits = part if hits is None else hits.unionByName(part)
    return top_per_group(hits, keys, [F.col("tier"), *order])


def contains_either(a: Column, b: Column) -> Column:
    """Either text contains the other; empty texts match nothing."""
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


def variant_fallback(variants: DataFrame, key: str, variant: str, ordinal: str, names: DataFrame, name: str) -> DataFrame:
    """The first variant of each query, by ``ordinal``, that equals a name."""
    hits = variants.join(names, F.lower(variant) == F.lower(name))
    return top_per_group(hits, [key], [F.col(ordinal), F.col(name)])


def starts_either(a: Column, b: Column, n: int = 8) -> Column:
    """One text starts with the first ``n`` characters of the other; empty texts match nothing."""
    return (a != "") & (b != "") & (F.startswith(a, F.substring(b, 1, n)) | F.startswith(b, F.substring(a, 1, n)))


def alias_match(a: Column, b: Column, shortest: int = 5) -> Column:
    """Equal aliases, or one of at least ``shortest`` characters contained in the other."""
    short = F.when(F.length(a) <= F.length(b), F.length(a)).otherwise(F.length(b))
    return (a == b) | ((short >= shortest) & contains_either(a, b))


def alias_pairs(left: DataFrame, left_key: str, right: DataFrame, right_key: str, alias: str = "alias", shortest: int = 5) -> DataFrame:
    """Pairs of keys of which any two aliases match.

    Containment of at least ``shortest`` characters needs a common gram of that length, so candidates come from an
    equi-join on grams; equal aliases, however short, from one on the alias.
    """
    a = left.select(F.col(left_key).alias("_l"), F.lower(F.trim(alias)).alias("_a")).where("_a <> ''").distinct()
    b = right.select(F.col(right_key).alias("_r"), F.lower(F.trim(alias)).alias("_b")).where("_b <> ''").distinct()

    def grams(df: DataFrame, c: str) -> DataFrame:
        every = F.transform(F.sequence(F.lit(1), F.length(c) - shortest + 1), lambda i: F.substring(F.col(c), i, F.lit(shortest)))
        return df.where(F.length(c) >= shortest).select("*", F.explode(F.array_distinct(every)).alias("_g"))

    held = grams(a, "_a").join(grams(b, "_b").hint("merge"), "_g").where(alias_match(F.col("_a"), F.col("_b"), shortest)).select("_l", "_r")
    equal = a.join(b, a["_a"] == b["_b"]).select("_l", "_r")
    return held.union(equal).distinct().withColumnsRenamed({"_l": left_key, "_r": right_key})


def with_fallback(rows: DataFrame, references: DataFrame, key: str, fallback: str, value: str) -> DataFrame:
    """``value`` by ``key``, else by the lower-cased ``fallback``; of several the least."""
    by_key = references.groupBy(key).agg(F.min(value).alias("_one"))
    by_name = references.groupBy(F.lower(fallback).alias("_name")).agg(F.min(value).alias("_two"))
    joined = rows.join(by_key, key, "left").join(by_name, F.lower(rows[fallback]) == F.col("_name"), "left")
    return joined.withColumn(value, F.coalesce("_one", "_two")).drop("_one", "_two", "_name")


def best_variant(asked: DataFrame, query: str, names: DataFrame, key: str, least: float = 65.0, k: int = 5) -> DataFrame:
    """The best catalogue key for each scanned name, over its variants.

    Variants in order of priority: as written, cleaned, without and within parentheses. The ``k`` most similar keys of a
    variant (token-sort ratio) are taken before the guards: ``least`` and a common meaningful word. Then whether
    strengths fit, the variant's priority and the ratio decide. Candidates share a trigram with the variant.
    """
    from medloom.functions import text
    from medloom.functions.similarity import token_sort_ratio

    q = F.col(query)
    forms = F.array(*[F.struct(F.lit(n).alias("priority"), v.alias("variant")) for n, v in enumerate((F.lower(text.squeeze(q)), text.clean_scanned(q), text.clean_scanned(text.without_parentheses(q)), text.clean_scanned(text.in_parentheses(q))))])
    variants = asked.select(query).distinct().select(query, F.inline(forms)).where(F.length("variant") >= 3)
    near = trigram_join(variants, "variant", names.select(key).distinct(), key, 0.05)
    scored = near.withColumn("ratio", token_sort_ratio(F.col("variant"), F.col(key)))
    top = top_per_group(scored, ["variant"], [F.desc("ratio"), F.col(key)], k)
    held = variants.join(top, "variant").where((F.col("ratio") >= least) & text.shares_root(q, F.col(key)))
    fits = text.strength_fits(q, F.col(key)).cast("int")
    best = top_per_group(held, [query], [fits.desc(), F.desc("priority"), F.desc("ratio"), F.col(key)])
    return best.select(query, key, F.round(F.col("ratio") / 100, 3).alias("score"))


def two_scorers(asked: DataFrame, query: str, names: DataFrame, name: str, least: float = 80.0, agree: float = 70.0, shortest: int = 4) -> DataFrame:
    """``query``, ``name``, ``score``: the best name for each query by two scorers.

    The best by token-sort ratio, or by partial ratio among names whose token-sort ratio is ``agree`` or more, where that
    is higher; it must reach ``least`` and have a meaningful word in common. Queries of fewer than ``shortest`` letters have no
    match; ties go to the first name. Candidates share a trigram with the query.
    """
    from medloom.functions import text
    from medloom.functions.similarity import partial_ratio, token_sort_ratio

    told = asked.select(F.trim(query).alias(query)).where(F.length(query) >= shortest).distinct()
    near = trigram_join(told, query, names, name, 0.1).drop("sim")
    sorted_ = near.withColumn("score", token_sort_ratio(F.lower(query), F.lower(name)))
    first = top_per_group(sorted_, [query], [F.desc("score"), F.col(name)])
    partial = sorted_.where(F.col("score") >= agree).withColumn("score", partial_ratio(F.lower(query), F.lower(name)))
    both = first.withColumn("_n", F.lit(0)).unionByName(partial.withColumn("_n", F.lit(1)))
    best = top_per_group(both, [query], [F.desc("score"), F.col("_n"), F.col(name)])
    return best.where((F.col("score") >= least) & text.shares_root(F.col(query), F.col(name))).select(query, name, F.round("score", 1).alias("score"))


def catalogue_with_fallback(asked: DataFrame, query: str, cached: DataFrame, name: str, now: Column, least: float = 0.3) -> DataFrame:
    """``query``, ``name``, ``tier``: an entry of equal name that has not expired (0), else the most similar of all (1)."""
    equal = asked.select(query).distinct().join(cached.where(F.col("expires_at") > now).select(name).distinct(), F.lower(query) == F.lower(name)).select(query, name, F.lit(0).alias("tier"), F.lit(1.0).alias("sim"))
    near = trigram_join(asked, query, cached, name, least).select(query, name, F.lit(1).alias("tier"), "sim")
    return top_per_group(equal.unionByName(near), [query], [F.col("tier"), F.desc("sim"), F.col(name)]).drop("sim")
