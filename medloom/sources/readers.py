"""Readers of the formats in which the data arrives; all lazy, with declared schemas where they are known."""

from __future__ import annotations

import importlib
import json
import os
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from medloom.functions.text import squeeze
from medloom.sources import schemas


def jdbc(spark: SparkSession, url: str, query: str, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 32) -> DataFrame:
    """A query of a database, read in parallel ranges of a numeric column where one is given."""
    reader = spark.read.format("jdbc").option("url", url)
    if partition_column and bounds:
        reader = reader.option("dbtable", f"({query}) q").option("partitionColumn", partition_column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
        return reader.load()
    return reader.option("query", query).load()


def catalogue_json(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue, an object with ``drugs`` or a bare list, with one search key per brand and per generic name."""
    drug = schemas.schema("catalogue")["drugs"].dataType.simpleString()
    text = spark.read.text(path, wholetext=True)
    listed = F.coalesce(F.from_json("value", f"struct<drugs:{drug}>")["drugs"], F.from_json("value", drug))
    drugs = text.select(F.posexplode(listed).alias("ordinal", "d")).select("ordinal", "d.*")
    generics = F.transform(F.coalesce("hoatChat", F.array().cast("array<struct<tenHoatChat:string,nongDo:string>>")), lambda h: squeeze(h["tenHoatChat"]))
    brand = squeeze(F.coalesce("tenThuoc", F.lit("")))
    keys = F.array_distinct(F.filter(F.transform(F.concat(F.array(brand), generics), F.lower), lambda k: k != ""))
    return drugs.select("*", F.explode(keys).alias("search_key"))


def catalogue_csv(spark: SparkSession, path: str) -> DataFrame:
    """The small catalogue; rows without a brand are left out."""
    rows = spark.read.schema("brand_name string, generic_name string, dosage string, category string").csv(path, header=True)
    held = rows.where(F.trim("brand_name") != "")
    keys = F.array_distinct(F.filter(F.array(F.lower(F.trim("brand_name")), F.lower(F.trim("generic_name"))), lambda k: k.isNotNull() & (k != "")))
    return held.select("*", F.explode(keys).alias("search_key"))


def catalogue(spark: SparkSession, json_path: str, csv_path: str) -> DataFrame:
    """The JSON catalogue where it exists, else the CSV one."""
    return catalogue_json(spark, json_path) if os.path.exists(json_path) else catalogue_csv(spark, csv_path)


def map_of_objects(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A JSON file that maps names to objects, one row per entry."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "v")).select("key", "v.*")


def label_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of label files, one list of boxes per page."""
    text = spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("file"), "value")
    box = "array<struct<text:string,label:string,box:array<int>>>"
    page = F.regexp_extract("file", r"([^/]+?)(?:\.json)?$", 1)
    return text.select(page.alias("page"), F.posexplode(F.from_json("value", box)).alias("ordinal", "b")).select("page", "ordinal", "b.*")


def side_table(spark: SparkSession, path: str) -> DataFrame:
    """Pill, Color, Shape."""
    rows = spark.read.schema("Pill string, Color string, Shape string").csv(path, header=True)
    return rows.select(*[F.trim(c).alias(c.lower()) for c in rows.columns])


def images(spark: SparkSession, folder: str, glob: str = "*.{jpg,jpeg,png}", limit: int | None = None) -> DataFrame:
    """Image files below a folder, by path; ``label`` is the file's stem, or its folder where files lie in sub-folders."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1)
    parent = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    top = os.path.basename(os.path.normpath(folder))
    labelled = files.withColumn("label", F.when(parent == top, stem).otherwise(parent)).orderBy("path")
    return labelled.limit(limit) if limit is not None else labelled


def site_map(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<loc>(.*?)</loc>"), F.lit(1))).alias("url")).select(F.trim("url").alias("url"))


def offline_queue(spark: SparkSession, path: str, user: str | None = None) -> DataFrame:
    """Queued log entries, corrupt lines and blank occurrences left out."""
    rows = spark.read.schema("user string, plan_id string, scheduled_time string, status string, occurrence_id string, queued_at string, note string, _bad string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    held = rows.where(F.col("_bad").isNull() & (F.trim("occurrence_id") != "")).drop("_bad")
    return held.where(F.col("user").isNull() | (F.col("user") == user)) if user else held


def day_cache(df: DataFrame, day: str, column: str = "date") -> DataFrame:
    """A cached schedule counts only for its own day."""
    return df.where(F.col(column) == F.lit(day).cast("date"))


def required(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A seed file that must be there."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return spark.read.schema(schema).json(path, multiLine=True)


class Page(InputPartition):
    def __init__(self, number: int) -> None:
        self.number = number


class PagedReader(DataSourceReader):
    """Reads numbered pages, each in its own task, with retries; a page that stays unreadable fails the task."""

    def __init__(self, options: dict, fetch: Callable[[str, int], str] | None = None) -> None:
        self.path, self.pages, self.retries = options["path"], int(options["pages"]), int(options.get("retries", 3))
        self.first, self.pause = int(options.get("first", 1)), float(options.get("pause", 1))
        self.done = {int(n) for n in options.get("done", "").split(",") if n.strip()}
        module, _, name = options.get("fetch", "").partition(":")
        self.fetch = fetch or (getattr(importlib.import_module(module), name) if name else _page_file)

    def partitions(self) -> list[Page]:
        return [Page(n) for n in range(self.first, self.first + self.pages) if n not in self.done]

    def read(self, partition: Page) -> Iterator[tuple]:
        for attempt in range(self.retries):
            try:
                body = self.fetch(self.path, partition.number)
                break
            except OSError as failed:  # a missing page too
                if attempt + 1 == self.retries:
                    raise
                # A server that asks to wait says how long; else twice as long each time.
                time.sleep(getattr(failed, "retry_after", self.pause * 2**attempt))
        for ordinal, row in enumerate(json.loads(body)):
            yield partition.number, ordinal, json.dumps(row, ensure_ascii=False)


def _page_file(path: str, number: int) -> str:
    with open(os.path.join(path, f"{number}.json"), encoding="utf-8") as f:
        return f.read()


class PagedSource(DataSource):
    """``spark.dataSource.register(PagedSource)``; ``format("paged")`` with ``path``, ``pages``, ``first``, ``retries``.

    ``pause``: seconds before the first retry, doubled each time; ``fetch``: 'module:function' that gives a page's text, else pages
    are files of ``path``; ``done``: numbers of pages that an earlier run has landed (see ``pages_done``), which are not read again.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page int, ordinal int, row string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


def pages_done(landed: DataFrame) -> str:
    """The option ``done`` that resumes a crawl after the pages of ``landed``; one number per page."""
    return ",".join(str(r.page) for r in landed.select("page").distinct().orderBy("page").collect())


def lookups(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """Answers of point lookups that were landed as JSON lines: ``key`` and the parsed ``answer``, the last of each key; broken ones are null."""
    rows = spark.read.text(path).select(F.get_json_object("value", f"$.{key}").alias(key), F.from_json(F.get_json_object("value", "$.answer"), schema).alias("answer"), F.coalesce(F.get_json_object("value", "$.at"), F.lit("")).alias("_at"))
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by("answer", F.struct("_at", F.to_json("answer"))).alias("answer"))


def html_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed product pages: ``url`` (their file) and ``html``."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"))
