"""Sinks: versioned tables, upserts, appends, step files.

A versioned table is a folder of versions and a pointer to the current one. A new
version is written whole beside the others; then the pointer is exchanged in one
rename, through the file system that the path belongs to. Readers see the old
version or the new one; the version before the current one stays for those still reading it.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medloom.operators.dedupe import last_wins, merge_into, replace_children

POINTER = "_CURRENT"


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def version_of(spark: SparkSession, folder: str) -> list[str]:
    """The current version and the one before it; empty where there is none yet."""
    files, Path = _files(spark, folder)
    pointer = Path(folder, POINTER)
    if not files.exists(pointer):
        return []
    stream = files.open(pointer)
    try:
        return bytes(stream.readAllBytes()).decode().split()
    finally:
        stream.close()


def _point(spark: SparkSession, folder: str, versions: list[str]) -> None:
    files, Path = _files(spark, folder)
    fresh = Path(folder, f"_{uuid.uuid4().hex}")
    stream = files.create(fresh)
    stream.write("\n".join(versions).encode())
    stream.close()
    jvm, fs = spark._jvm, spark._jvm.org.apache.hadoop.fs
    how = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    how[0] = getattr(fs, "Options$Rename").OVERWRITE
    context = fs.FileContext.getFileContext(files.getUri(), jvm.org.apache.hadoop.conf.Configuration(spark._jsc.hadoopConfiguration()))
    context.rename(files.makeQualified(fresh), files.makeQualified(Path(folder, POINTER)), how)


def publish(spark: SparkSession, tables: dict[str, DataFrame], folder: str, partition_by: Sequence[str] = ()) -> None:
    """New versions of all ``tables`` of a folder at once: one pointer stands for all. They may read the current versions."""
    version, before = f"v-{uuid.uuid4().hex}", version_of(spark, folder)
    for name, df in tables.items():
        df.write.partitionBy(*partition_by).parquet(f"{folder}/{version}/{name}")
    _point(spark, folder, [version, *before[:1]])
    if len(before) > 1:
        files, Path = _files(spark, folder)
        files.delete(Path(folder, before[1]), True)


def current(spark: SparkSession, folder: str, name: str = "data") -> DataFrame | None:
    """The current version of a table; None where there is none yet."""
    versions = version_of(spark, folder)
    return spark.read.parquet(f"{folder}/{versions[0]}/{name}") if versions else None


def swap(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Overwrites a versioned table, which ``df`` may read."""
    publish(df.sparkSession, {"data": df}, path, partition_by)


def reload(spark: SparkSession, tables: dict[str, DataFrame], folder: str) -> None:
    """Replaces several tables together: readers see all old or all new ones (``current(spark, folder, name)``)."""
    publish(spark, tables, folder)


def upsert(spark: SparkSession, changes: DataFrame, path: str, keys: Sequence[str], version: str) -> None:
    """Changes replace rows of equal key, the highest version winning. Every call writes the table anew: for a stream, size its batches by that."""
    held = current(spark, path)
    swap(last_wins(changes, keys, [version]).select(*changes.columns) if held is None else merge_into(held, changes, keys, version), path)


def replace_of_parents(spark: SparkSession, children: DataFrame, path: str, parent: str) -> None:
    """All children of the parents given are exchanged."""
    held = current(spark, path)
    swap(children if held is None else replace_children(held, children, parent), path)


def with_ttl(df: DataFrame, now: str, days: int) -> DataFrame:
    """Rows with the time they were cached and when they expire."""
    at = F.lit(now).cast("timestamp")
    return df.withColumns({"cached_at": at, "expires_at": at + F.make_dt_interval(days=F.lit(days))})


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def soft_delete(df: DataFrame, condition, column: str = "is_active") -> DataFrame:
    return df.withColumn(column, F.when(condition, F.lit(False)).otherwise(F.col(column)))


def revoke(df: DataFrame, condition, now: str, column: str = "revoked_at") -> DataFrame:
    return df.withColumn(column, F.when(condition & F.col(column).isNull(), F.lit(now).cast("timestamp")).otherwise(F.col(column)))


def finalize(images: DataFrame, set_id: str, confirmed: Sequence[str] | None = None) -> DataFrame:
    """The flags of a reference set: those named, all where none are."""
    own = F.col("reference_set_id") == set_id
    chosen = F.col("id").isin(*confirmed) if confirmed else F.lit(True)
    return images.withColumn("confirmed_by_user", F.when(own, chosen).otherwise(F.col("confirmed_by_user")))


def catalogue_rows(df: DataFrame, key: str = "soDangKy", order: str = "ordinal") -> DataFrame:
    """One row per registration number, the first; rows without a number are all kept."""
    blank = F.coalesce(F.trim(key), F.lit("")) == ""
    rest = [c for c in df.columns if c != key]
    numbered = df.where(~blank).groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r")).select(key, "_r.*")
    return numbered.select(*df.columns).unionByName(df.where(blank))


def step_files(df: DataFrame, folder: str, step: str) -> None:
    """The rows of a pipeline step as JSON lines."""
    df.write.mode("overwrite").json(f"{folder}/{step}")
