"""Session-level plumbing shared by all operators: table access and durable intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder shared by all executors (``spark.checkpoint.dir``).

    A folder of this library's own making is used only where the setting is
    absent, that is on a single machine in tests.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="medloom-")
    atexit.register(shutil.rmtree, own, True)
    spark.sparkContext.setCheckpointDir(own)
    return f"file://{own}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a Parquet table in the shared folder and read it back.

    Parquet is columnar and compressed, so it takes a fraction of the space of
    an RDD checkpoint and lets later scans prune columns. The table survives
    the loss of executors.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/medloom/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Passes:
    """A table that grows pass by pass in the shared folder and is read as one scan, so that plans stay short."""

    def __init__(self, spark: SparkSession, label: str, schema: str) -> None:
        self.spark, self.schema, self.paths = spark, schema, []
        self.folder = f"{checkpoint_dir(spark)}/medloom/{label}-{uuid.uuid4().hex}"

    def add(self, df: DataFrame) -> None:
        path = f"{self.folder}/pass={len(self.paths)}"
        df.write.option("compression", "zstd").parquet(path)
        self.paths.append(path)

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)


def hash_sample(df: DataFrame, by: list[str], most: int, total: int | None = None) -> DataFrame:
    """At most ``most`` rows, chosen by the hash of ``by``: the same rows whatever the layout.

    The share to keep is fixed beforehand from the count, so that no more than about ``most`` rows of all partitions
    together reach the final, exact cut. ``by`` should be (nearly) unique: rows with equal ``by`` stay or go together until that cut.
    """
    total = df.count() if total is None else total
    steps = 1 << 20
    keep = steps if total <= most else max(1, int(steps * 0.97 * most / total))
    h = F.xxhash64(*by)
    return df.where(F.pmod(h, F.lit(steps)) < keep).orderBy(h, *by).limit(most)
