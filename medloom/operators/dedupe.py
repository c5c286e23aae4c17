"""Order-aware deduplication, upserts and change detection.

All 'first' and 'last' are by explicit order columns with a total tie-break;
none relies on the order in which rows are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each group; Spark ranks before the shuffle too, so hot groups arrive cut."""
    n = rank or "_n"
    out = df.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(n) <= k)
    return out if rank else out.drop(n)


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last by ``order``; full rows are compared where the order ties. An aggregation, pre-combined on the map side."""
    rest = [c for c in df.columns if c not in keys]
    first = [*order, *[c for c in rest if c not in order]]
    row = F.max(F.struct(*first)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    first = [*order, *[c for c in rest if c not in order]]
    row = F.min(F.struct(*first)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def upsert(log: DataFrame, keys: Sequence[str], order: Sequence[str], overwrite: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Replays upserts: ``overwrite`` columns have the last value, null or not; ``keep`` columns the last value that is not null."""
    at = F.struct(*order)
    picks = [F.max_by(F.struct(F.col(c)), at)[c].alias(c) for c in overwrite]
    picks += [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in keep]
    return log.groupBy(*keys).agg(*picks)


def merge_into(base: DataFrame, changes: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """``base`` with ``changes`` put in: the row with the highest version of each key, changes first on ties."""
    both = base.withColumn("_side", F.lit(0)).unionByName(changes.withColumn("_side", F.lit(1)))
    return last_wins(both, keys, [version, "_side"]).select(*base.columns)


def patch(base: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only the supplied (non-null) columns of ``changes`` replace those of ``base``."""
    columns = [c for c in changes.columns if c not in keys]
    new = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = base.join(new, list(keys), "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])


def replace_children(children: DataFrame, replacement: DataFrame, parent: str) -> DataFrame:
    """All children of the parents in ``replacement`` are exchanged for the new ones."""
    return children.join(replacement.select(parent).distinct(), parent, "left_anti").unionByName(replacement)


def manual_over_auto(auto: DataFrame, manual: DataFrame, keys: Sequence[str], updated: str) -> DataFrame:
    """Manual rows before automatic ones, then the latest."""
    both = auto.withColumn("_manual", F.lit(0)).unionByName(manual.withColumn("_manual", F.lit(1)))
    return last_wins(both, keys, ["_manual", updated]).select(*auto.columns)


def snapshot_changes(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with ``change``: 'added', 'removed', 'changed' or 'same', by a null-safe comparison of all other columns."""
    columns = [c for c in new.columns if c not in keys]
    a = old.select(*keys, F.struct(*columns).alias("_old"))
    b = new.select(*keys, F.struct(*columns).alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("changed")
    return a.join(b, list(keys), "full_outer").select(*keys, change.alias("change"))


def key_delta(existing: DataFrame, desired: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What to 'cancel' (existing only) and what to 'create' (desired only)."""
    gone = existing.select(*keys).distinct().join(desired, list(keys), "left_anti").withColumn("action", F.lit("cancel"))
    new = desired.select(*keys).distinct().join(existing, list(keys), "left_anti").withColumn("action", F.lit("create"))
    return gone.unionByName(new)


def digest(*parts: Column) -> Column:
    """A hash of ordered parts, for change detection."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts]), 256)


def enrich(base: DataFrame, extra: DataFrame, key: Column) -> DataFrame:
    """``base`` with those rows of ``extra`` whose key (an expression over either) it does not have; null keys are never had."""
    known = base.select(key.alias("_key")).where("_key IS NOT NULL").distinct()
    new = extra.withColumn("_key", key).join(known, "_key", "left_anti").drop("_key")
    return base.unionByName(new, allowMissingColumns=True)


def cleaned(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with the columns trimmed and null as ''."""
    return df.withColumns({c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns})
