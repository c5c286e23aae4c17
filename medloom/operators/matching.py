"""Matching detections to reference vectors, and evaluating it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from medloom.operators.dedupe import top_per_group


def reference_bank(vectors: DataFrame, label: str, order: str, k: int) -> DataFrame:
    """The first k vectors of each label."""
    return top_per_group(vectors, [label], [F.col(order)], k)


def score_candidates(asked: DataFrame, bank: DataFrame, key: str, vector: str, label: str, k: int = 3, block: int = 10_000) -> DataFrame:
    """Per query the k labels with the highest dot product over their references, clamped to [0, 1], to four places.

    A bank of at most ``block`` vectors is sent to the tasks and the queries stream past it. A larger one is cut into
    blocks of whole labels, each of which meets each block of queries in a task of its own; the best of all blocks are
    taken at the end. Vectors of another length than the bank's first, by label, have no candidates.
    """
    n = bank.count()
    refs = bank.select(F.col(label).alias("candidate"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL AND candidate IS NOT NULL")
    kinds = dict(asked.dtypes)[key], dict(refs.dtypes)["candidate"]
    arrow = to_arrow_type(refs.schema["candidate"].dataType)
    schema = f"{key} {kinds[0]}, candidate {kinds[1]}, score double"
    head = refs.select("candidate", F.size("v").alias("d")).orderBy("candidate", "d").first()
    if head is None:
        return asked.limit(0).select(key, F.lit(None).cast(kinds[1]).alias("candidate"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    refs = refs.where(F.size("v") == head.d)
    whole = asked.where(F.size(vector) == head.d).select(key, F.col(vector).cast("array<double>").alias("v"))

    def best_of(ids: pa.Array, vectors: pa.Array, names: np.ndarray, first: np.ndarray, held: np.ndarray) -> list[pa.Array]:
        x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, held.shape[0])
        top = np.maximum.reduceat(x @ held, first, axis=1)
        top = np.floor(np.clip(top, 0, 1) * 1e4 + 0.5) / 1e4
        at = np.argsort(-top, axis=1, kind="stable")[:, :k]
        row = np.repeat(np.arange(len(x)), at.shape[1])
        return [ids.take(pa.array(row)), pa.array(names[at.ravel()]).cast(arrow), pa.array(np.take_along_axis(top, at, 1).ravel())]

    def laid_out(candidates: list, vectors: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = sorted(range(len(candidates)), key=candidates.__getitem__)
        names, first = np.unique(np.array([candidates[i] for i in order]), return_index=True)
        return names, first, np.array([vectors[i] for i in order]).T

    if n <= block:
        rows = refs.collect()  # ``block`` vectors at most
        bench = laid_out([r.candidate for r in rows], [r.v for r in rows])

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays(best_of(batch.column(0), batch.column(1), *bench), names=[key, "candidate", "score"])

        best = whole.mapInArrow(score, schema)
    else:
        banks, queries = -(-n // block), max(1, -(-whole.count() // (4 * block)))
        left = whole.select(key, "v", F.pmod(F.xxhash64(key), F.lit(queries)).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(banks - 1))).alias("part"))
        right = refs.select("candidate", "v", F.explode(F.sequence(F.lit(0), F.lit(queries - 1))).alias("q"), F.pmod(F.xxhash64("candidate"), F.lit(banks)).alias("part"))

        def meet(asking: pa.Table, held: pa.Table) -> pa.Table:
            out = [pa.array([], asking.schema.field(key).type), pa.array([], arrow), pa.array([], pa.float64())]
            if asking.num_rows and held.num_rows:
                bench = laid_out(held["candidate"].to_pylist(), held["v"].to_pylist())
                out = best_of(asking[key].combine_chunks(), asking["v"].combine_chunks(), *bench)
            return pa.table(dict(zip([key, "candidate", "score"], out)))

        best = left.groupBy("q", "part").cogroup(right.groupBy("q", "part")).applyInArrow(meet, schema)
    return top_per_group(best, [key], [F.desc("score"), F.col("candidate")], k, "rank")


def mark_extra(assigned: DataFrame, plan: str, expected: str, order: list[Column], status: str = "status") -> DataFrame:
    """Beyond the expected number per plan, the less confident assignments are 'extra'; others keep their status."""
    ranked = top_per_group(assigned.where(F.col(status) == "assigned"), [plan], order, 2**31 - 1, "_place")
    marked = ranked.withColumn(status, F.when(F.col("_place") > F.col(expected), "extra").otherwise(F.col(status))).drop("_place")
    return marked.unionByName(assigned.where(F.col(status) != "assigned"))


def count_summary(expected: DataFrame, found: DataFrame, plan: str, n: str, status: str = "status") -> DataFrame:
    """Per plan: expected, assigned, extra and missing."""
    got = found.groupBy(plan).agg(F.count_if(F.col(status) == "assigned").alias("assigned"), F.count_if(F.col(status) == "extra").alias("extra"))
    joined = expected.join(got, plan, "left").fillna(0, ["assigned", "extra"])
    return joined.withColumn("missing", F.greatest(F.col(n) - F.col("assigned"), F.lit(0)))


def uncovered(expected: DataFrame, references: DataFrame, *keys: str) -> DataFrame:
    """Expected rows without a reference."""
    return expected.join(references, list(keys), "left_anti")


def top1_accuracy(scored: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per class: cases, hits and accuracy of the first guess."""
    hit = F.col(truth) == F.col(predicted)
    return scored.groupBy(truth).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.round(F.count_if(hit) / F.count("*"), 6).alias("accuracy"))


def evaluation(scored: DataFrame, truth: str, predicted: str, status: str = "status") -> DataFrame:
    """One row: cases, first guesses right, assigned, assigned right, and their rates."""
    hit, given = F.col(truth) == F.col(predicted), F.col(status) == "assigned"
    counted = scored.agg(F.count("*").alias("total"), F.count_if(hit).alias("top1_correct"), F.count_if(given).alias("assigned"), F.count_if(given & hit).alias("assigned_correct"))
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 4)
    return counted.select("*", rate("top1_correct", "total").alias("top1_accuracy"), rate("assigned", "total").alias("assigned_rate"), rate("assigned_correct", "assigned").alias("assigned_precision"))


def worst_classes(scored: DataFrame, truth: str, predicted: str, k: int = 20) -> DataFrame:
    """The ``k`` classes with the lowest accuracy, of equal ones the smaller, then by name."""
    per = top1_accuracy(scored, truth, predicted)
    return per.orderBy("accuracy", "n", truth).limit(k)
