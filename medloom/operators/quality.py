"""Data quality and evaluation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distribution(df: DataFrame, label: str) -> DataFrame:
    """Counts and percentages of the values of a column."""
    counted = df.groupBy(label).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # one row per value
    return counted.withColumn("pct", F.round(100.0 * F.col("n") / total, 4))


def profile(df: DataFrame, name: str, required: Sequence[str], key: str) -> DataFrame:
    """Rows, distinct keys and the filled share of each required column, in one pass; one row per check."""
    filled = [F.round(F.avg((F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "").cast("double")), 6).alias(f"filled_{c}") for c in required]
    wide = df.agg(F.count("*").cast("double").alias("rows"), F.count_distinct(key).cast("double").alias("keys"), *filled)
    return wide.unpivot([], wide.columns, "check", "value").select(F.lit(name).alias("tbl"), "check", "value")


def validate(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """``df`` with ``errors``, the names of the checks that fail; a check that is null fails."""
    return df.withColumn("errors", F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()])))


def precision_recall(df: DataFrame, predicted: Column, truth: Column) -> DataFrame:
    tp, fp, fn = F.count_if(predicted & truth), F.count_if(predicted & ~truth), F.count_if(~predicted & truth)
    return df.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn")).select(
        "*",
        F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"),
        F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), 6).alias("recall"),
        F.round(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6).alias("f1"),
    )


def page(df: DataFrame, order: Sequence[Column], number: int, size: int, most: int = 50) -> DataFrame:
    """A page of an ordered list (a total order is the caller's)."""
    size = max(1, min(most, size))
    return df.orderBy(*order).offset(max(0, number - 1) * size).limit(size)


def batch_summary(results: DataFrame, found: Column, failed: Column) -> DataFrame:
    """One row over a batch: results, average found, errors, results without any."""
    return results.agg(F.count("*").alias("total"), F.round(F.avg(found), 6).alias("average"), F.count_if(failed).alias("errors"), F.count_if(F.coalesce(found, F.lit(0)) == 0).alias("empty"))


def shown_children(children: DataFrame, parent: str, confirmed: Column, updated: str) -> DataFrame:
    """Per parent: all children, the confirmed ones, how many are shown (the confirmed, all where none is), and the latest shown."""
    yes = F.coalesce(confirmed, F.lit(False))
    counted = children.groupBy(parent).agg(
        F.count("*").alias("children"), F.count_if(yes).alias("confirmed"), F.max(F.when(yes, F.col(updated))).alias("_yes"), F.max(updated).alias("_all"),
    )
    some = F.col("confirmed") > 0
    return counted.select(parent, "children", "confirmed", F.when(some, F.col("confirmed")).otherwise(F.col("children")).alias("shown"), F.when(some, F.col("_yes")).otherwise(F.col("_all")).alias("latest"))


def image_statistics(pixels: Column, height: int, width: int, bright: float, ink: float) -> list[Column]:
    """Of a row-major grey image: ``sharpness`` (variance of its Laplacian), ``glare`` (share of bright pixels), and the ``top``,
    ``bottom``, ``left``, ``right`` of pixels above ``ink`` (null where there are none)."""
    at = lambda y, x: F.get(pixels, y * width + x).cast("double")
    inner = lambda n: F.sequence(F.lit(1), F.lit(n - 2))
    laplace = F.flatten(F.transform(inner(height), lambda y: F.transform(inner(width), lambda x: at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * at(y, x))))
    n = (height - 2) * (width - 2)
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, v: s + f(v))
    mean = total(laplace, lambda v: v) / n
    places = F.filter(F.sequence(F.lit(0), F.lit(height * width - 1)), lambda i: F.get(pixels, i) > ink)
    rows, columns = F.transform(places, lambda i: (i / width).cast("int")), F.transform(places, lambda i: i % width)
    return [
        (total(laplace, lambda v: v * v) / n - mean * mean).alias("sharpness"),
        (F.size(F.filter(pixels, lambda p: p >= bright)) / (height * width)).alias("glare"),
        F.array_min(rows).alias("top"), F.array_max(rows).alias("bottom"), F.array_min(columns).alias("left"), F.array_max(columns).alias("right"),
    ]
