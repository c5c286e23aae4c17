"""Streaming twins of the batch operators: same rows in, same result out.

Checkpoint locations are the caller's, in a folder all executors share, so a
query resumes where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from medloom.sources import writers


def rate_windows(events: DataFrame, at: str, by: Sequence[str], limit: int, window: str = "15 minutes", late: str = "15 minutes") -> DataFrame:
    """Tumbling windows in which a key exceeds its limit."""
    counted = events.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), *by).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") > limit).select(*by, F.col("w.start").alias("start"), "n")


def gap_sessions(events: DataFrame, at: str, by: Sequence[str], gap: str, late: str) -> DataFrame:
    """Sessions that end after a gap."""
    grouped = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *by)
    return grouped.agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


STATE = "frequency long, confidence double, score double, confirmed boolean, first long, status string, texted long, text string, qualities string"
MERGED = "session string, key string, frequency long, confidence double, score double, status string, text string, qualities string"


def merge_sessions(items: DataFrame) -> DataFrame:
    """Running merge of the items of (session, key); every batch emits the keys that it changed.

    ``items``: session, key, status, confidence, score, text, quality and ``n``, their order. State is one row a key,
    whatever the number of items. The last row of a key is that of ``sessions.merge_items`` over all of them.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        low, high = float("-inf"), 2**63 - 1
        n, confidence, score, confirmed, first, status, texted, text, said = state.get if state.exists else (0, low, low, False, high, None, high, None, "")
        qualities = set(said.split(",")) - {""}
        for pdf in frames:
            n += len(pdf)
            confidence, score = max(confidence, pdf.confidence.max()), max(score, pdf.score.max())
            confirmed = confirmed or bool((pdf.status == "confirmed").any())
            qualities |= set(pdf.quality.dropna())
            if int(pdf.n.min()) < first:
                row = pdf.loc[pdf.n.idxmin()]
                first, status = int(row.n), row.status
            filled = pdf[pdf.text.fillna("") != ""]
            if len(filled) and int(filled.n.min()) < texted:
                row = filled.loc[filled.n.idxmin()]
                texted, text = int(row.n), row.text
        said = ",".join(sorted(qualities))
        state.update((n, float(confidence), float(score), confirmed, first, status, texted, text, said))
        yield pd.DataFrame([(*key, n, confidence, score, "confirmed" if confirmed else status, text, said)], columns=["session", "key", "frequency", "confidence", "score", "status", "text", "qualities"])

    return items.groupBy("session", "key").applyInPandasWithState(step, MERGED, STATE, "update", GroupStateTimeout.NoTimeout)


def missed_doses(doses: DataFrame, logs: DataFrame, miss_after: str = "45 minutes", late: str = "45 minutes") -> DataFrame:
    """Doses without a log entry by the time they count as missed.

    A left outer join of two streams on the occurrence, within the miss window: a dose is given out as missed when the
    watermark passes the end of its window, and entries that arrive up to ``late`` after later ones still count. ``doses``: occurrence, scheduled; ``logs``: log_occurrence, logged.
    """
    d = doses.withWatermark("scheduled", late)
    lg = logs.withWatermark("logged", late)
    inside = F.expr(f"occurrence = log_occurrence AND logged >= scheduled - INTERVAL 30 MINUTES AND logged <= scheduled + INTERVAL {miss_after}")
    return d.join(lg, inside, "leftOuter").where("log_occurrence IS NULL").select("occurrence", "scheduled", F.lit("missed").alias("status"))


def upsert_sink(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], version: str) -> StreamingQuery:
    """At-least-once batches into an idempotent table: replays change nothing."""

    def put(batch: DataFrame, _: int) -> None:
        writers.upsert(batch.sparkSession, batch, path, keys, version)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reconcile_sink(stream: DataFrame, act: Callable[[DataFrame], None], checkpoint: str, every: str = "10 minutes") -> StreamingQuery:
    """Reconciliation at most once per interval."""
    return stream.writeStream.foreachBatch(lambda batch, _: act(batch)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def with_late(status: DataFrame, late: DataFrame, key: str, column: str = "status") -> DataFrame:
    """Queued entries override what the server knows."""
    queued = late.select(key, F.col(column).alias("_late"))
    return status.join(queued, key, "left").withColumn(column, F.coalesce("_late", column)).drop("_late")


def unexpired(cache: DataFrame, now: str) -> DataFrame:
    return cache.where(F.col("expires_at") > F.lit(now).cast("timestamp"))
