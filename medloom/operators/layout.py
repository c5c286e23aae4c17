"""Spatial operators over text blocks and intervals, page by page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medloom.operators.dedupe import top_per_group


def gaps(df: DataFrame, page: str, low: str, high: str, order: list[str], k: int) -> DataFrame:
    """The k widest gaps between the running right edge and the next block, with their centres."""
    w = Window.partitionBy(page).orderBy(low, *order)
    edge = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    found = df.withColumn("edge", edge).where(F.col(low) > F.col("edge"))
    found = found.select(page, "edge", F.col(low).alias("next"), (F.col(low) - F.col("edge")).alias("gap"), ((F.col(low) + F.col("edge")) / 2).alias("centre"))
    return top_per_group(found, [page], [F.desc("gap"), F.col("centre")], k, "rank")


def nearest_anchor(blocks: DataFrame, anchors: DataFrame, page: str, at: str, anchor_at: str, anchor: str) -> DataFrame:
    """Each block with the anchor whose band holds it: bands end midway between consecutive anchors.

    An as-of search without a range join: anchors' upper bounds and blocks are merged in one ordered pass, every block
    taking the next bound at or after it.
    """
    w = Window.partitionBy(page).orderBy(anchor_at, anchor)
    bounds = anchors.withColumn("bound", (F.col(anchor_at) + F.lead(anchor_at).over(w)) / 2)
    bounds = bounds.select(page, F.coalesce("bound", F.lit(float("inf"))).alias("_at"), F.struct(F.col(anchor)).alias("_anchor"), F.lit(1).alias("_side"), F.lit(None).cast(_row_type(blocks)).alias("_row"))
    rows = blocks.select(page, F.col(at).cast("double").alias("_at"), F.lit(None).cast(f"struct<{anchor}:{dict(anchors.dtypes)[anchor]}>").alias("_anchor"), F.lit(0).alias("_side"), F.struct(*blocks.columns).alias("_row"))
    ahead = Window.partitionBy(page).orderBy("_at", "_side").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    merged = rows.unionByName(bounds).withColumn("_found", F.first("_anchor", ignorenulls=True).over(ahead))
    return merged.where("_side = 0").select("_row.*", F.col(f"_found.{anchor}").alias(anchor))


def _row_type(df: DataFrame) -> str:
    return "struct<" + ",".join(f"`{n}`:{t}" for n, t in df.dtypes) + ">"


def neighbours(blocks: DataFrame, page: str, block: str, x1: str, x2: str, y1: str, y2: str, band: float = 50) -> DataFrame:
    """Per block the nearest one to its right (strictly overlapping heights) and below (overlapping widths).

    Blocks that overlap in height share a band of ``band`` units, so blocks to the right meet by page and band of rows,
    blocks below by page and band of columns; no two blocks of a page meet that have none in common.
    """
    cols = [block, x1, x2, y1, y2]

    def met(low: str, high: str) -> DataFrame:
        """Pairs with a common band between ``low`` and ``high``."""
        cut = lambda c: F.floor(F.col(c) / band)
        spread = blocks.where(F.col(high) >= F.col(low)).select(page, *cols, F.explode(F.sequence(cut(low), cut(high))).alias("_band"))
        a, b = (spread.select(page, "_band", *[F.col(c).alias(f"{s}_{c}") for c in cols]) for s in ("a", "b"))
        return a.join(b.hint("merge"), [page, "_band"]).where(F.col(f"a_{block}") != F.col(f"b_{block}")).drop("_band")

    rows_meet = F.greatest(f"a_{y1}", f"b_{y1}") < F.least(f"a_{y2}", f"b_{y2}")
    columns_meet = F.greatest(f"a_{x1}", f"b_{x1}") < F.least(f"a_{x2}", f"b_{x2}")
    right = met(y1, y2).where(rows_meet & (F.col(f"b_{x1}") >= F.col(f"a_{x2}"))).withColumn("dir", F.lit("right")).withColumn("_d", F.col(f"b_{x1}"))
    below = met(x1, x2).where(columns_meet & (F.col(f"b_{y1}") >= F.col(f"a_{y2}"))).withColumn("dir", F.lit("below")).withColumn("_d", F.col(f"b_{y1}"))
    best = top_per_group(right.unionByName(below), [page, f"a_{block}", "dir"], [F.col("_d"), F.col(f"b_{block}")])
    return best.select(page, F.col(f"a_{block}").alias("src"), F.col(f"b_{block}").alias("dst"), "dir")


def bands(titles: DataFrame, page: str, top: str, bottom: str, block: str, least: float = 52, factor: float = 1.15) -> DataFrame:
    """``band`` within the page: a new one starts where the gap to the block above reaches the larger of both limits."""
    w = Window.partitionBy(page).orderBy(top, block)
    height = titles.groupBy(page).agg(F.median(F.col(bottom) - F.col(top)).alias("_h"))
    gap = F.col(top) - F.lag(top).over(w)
    new = F.coalesce((gap >= F.greatest(F.lit(least), F.col("_h") * factor)).cast("int"), F.lit(1))
    return titles.join(height, page).withColumn("_new", new).withColumn("band", F.sum("_new").over(w)).drop("_new", "_h")


def roll_up(blocks: DataFrame, by: list[str], column: str, y: str, text: str, box: list[str], confidence: str) -> DataFrame:
    """Bands as lines: texts of a column in reading order, columns joined by ' | ', the box around all, mean confidence."""
    cells = blocks.groupBy(*by, column).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(y, text))), lambda s: s[text]), " ").alias("_t"),
        F.min(box[0]).alias("x1"), F.min(box[1]).alias("y1"), F.max(box[2]).alias("x2"), F.max(box[3]).alias("y2"), F.sum(confidence).alias("_c"), F.count("*").alias("_n"),
    )
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(column, "_t"))), lambda s: s["_t"]), " | ")
    return cells.groupBy(*by).agg(line.alias("line"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.round(F.sum("_c") / F.sum("_n"), 4).alias("confidence"))


def reading_order(top: str, left: str) -> list[Column]:
    return [F.col(top).asc(), F.col(left).asc()]
