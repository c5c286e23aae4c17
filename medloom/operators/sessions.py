"""Observations of a session brought together over its scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_items(items: DataFrame, session: str, key: str, order: Sequence[str]) -> DataFrame:
    """Per session and key: frequency, best confidence and score, status (confirmed once any is), first text, qualities.

    ``items``: session, key, status, confidence, score, text, quality and the order columns. Where it has a ``name``, the
    item takes that of its first confirmed observation, else of its first.
    """
    at = F.struct(*order)
    names = [F.coalesce(F.min_by("name", F.when(F.col("status") == "confirmed", at)), F.min_by("name", at)).alias("name")] if "name" in items.columns else []
    return items.groupBy(session, key).agg(
        F.count("*").alias("frequency"),
        F.max("confidence").alias("confidence"),
        F.max("score").alias("score"),
        F.when(F.bool_or(F.col("status") == "confirmed"), "confirmed").otherwise(F.min_by("status", at)).alias("status"),
        F.min_by("text", F.when(F.col("text") != "", at)).alias("text"),
        F.array_join(F.array_sort(F.collect_set("quality")), ",").alias("qualities"),
        *names,
    )


def signature(merged: DataFrame, session: str, key: str) -> DataFrame:
    """The ordered signature of a session's items."""
    part = F.concat_ws(":", key, "status")
    return merged.groupBy(session).agg(F.array_join(F.array_sort(F.collect_list(part)), "|").alias("signature"))


def last_k(df: DataFrame, session: str, order: Sequence[Column], k: int, rank: str = "recency") -> DataFrame:
    """The last k rows of each session; recency 1 is the latest."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(session).orderBy(*order))).where(F.col(rank) <= k)


def all_of_last(df: DataFrame, session: str, order: Sequence[Column], k: int, bad: Column) -> DataFrame:
    """Sessions of at least k rows whose last k rows are all bad."""
    return last_k(df.withColumn("_bad", bad), session, order, k).groupBy(session).agg(F.count("*").alias("n"), F.bool_and("_bad").alias("every")).where((F.col("n") == k) & F.col("every")).select(session)


def by_gap(df: DataFrame, keys: Sequence[str], at: str, order: Sequence[str], gap_minutes: float) -> DataFrame:
    """``session_no`` within the keys: a new one starts where more than the gap has passed."""
    w = Window.partitionBy(*keys).orderBy(*order)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    new = F.coalesce((micros - F.lag(micros).over(w) > int(gap_minutes * 60_000_000)).cast("int"), F.lit(1))
    return df.withColumn("_new", new).withColumn("session_no", F.sum("_new").over(w)).drop("_new")


def novel(current: DataFrame, before: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of the latest scan never seen before."""
    return current.join(before, list(keys), "left_anti")


def session_quality(merged: DataFrame, session: str) -> DataFrame:
    """Per session: items, their average confidence (null counts as 0), how many are unresolved."""
    return merged.groupBy(session).agg(F.count("*").alias("items"), F.avg(F.coalesce("confidence", F.lit(0.0))).alias("average"), F.count_if(~F.coalesce(F.col("status") == "confirmed", F.lit(False))).alias("unresolved"))


def convergence(scans: DataFrame, items: DataFrame, session: str, scan: str, order: Sequence[Column]) -> DataFrame:
    """``session``, ``converged``, ``reason`` of every session.

    ``scans``: session, scan, ``rejected`` and the order columns (latest first); ``items``: session, scan, key, status,
    confidence. 'repeated_bad_images': the last three scans are rejected. 'stable_high_confidence': of at least two good
    scans the last two show the same items in the same state, these average 0.75 or more over the session with at
    most one unresolved, and the latest shows no item at 0.85 or more that was never so certain before.
    """
    # How many rejected scans end a session, how many good ones it needs, and the confidences asked for.
    rejects, needed, average, sure, open_items = 3, 2, 0.75, 0.85, 1
    every = scans.select(session).distinct()
    bad = all_of_last(scans, session, order, rejects, F.col("rejected")).withColumn("bad", F.lit(True))
    place = Window.partitionBy(session).orderBy(*order)
    good = scans.where(~F.col("rejected")).select(session, scan, F.row_number().over(place).alias("recency"))
    held = items.join(good, [session, scan])
    merged = held.groupBy(session, "key").agg(F.max("confidence").alias("confidence"), F.when(F.bool_or(F.col("status") == "confirmed"), "confirmed").otherwise(F.min("status")).alias("status"))
    # Of the items of a scan only the last two scans' signatures are built.
    shown = held.where(F.col("recency") <= needed).select(session, scan, F.concat_ws(":", "key", "status").alias("part")).distinct()
    signs = shown.groupBy(session, scan).agg(F.array_join(F.array_sort(F.collect_list("part")), "|").alias("sign"))
    stable = signs.groupBy(session).agg(F.count("*").alias("signed"), F.count_distinct("sign").alias("signs"))
    certain = held.where(F.col("confidence") >= sure).select(session, "key", "recency")
    fresh = novel(certain.where("recency = 1").select(session, "key"), certain.where("recency > 1").select(session, "key"), [session, "key"])
    fresh = fresh.select(session).distinct().withColumn("fresh", F.lit(True))
    told = every.join(bad, session, "left").join(session_quality(merged, session), session, "left").join(stable, session, "left").join(fresh, session, "left")
    calm = (F.col("signed") == needed) & (F.col("signs") == 1) & (F.col("average") >= average) & (F.col("unresolved") <= open_items) & F.col("fresh").isNull()
    reason = F.when(F.col("bad"), "repeated_bad_images").when(calm, "stable_high_confidence")
    return told.select(session, F.coalesce(reason == "stable_high_confidence", F.lit(False)).alias("converged"), reason.alias("reason"))
