"""Quantities of different written units in one unit per kind (problem 5).

Texts are read in one map-only Arrow pass. A text that is one bare number lacks
its unit: a tree ensemble, trained on rows that do write their unit and
calibrated on held-out ones, predicts it from the magnitude, the table, the
category and the unit named by neighbouring fields. Confident predictions are
converted; the others go to review. A row that writes its unit is learned from
twice: with what its neighbouring fields say, and with its own unit moved into
them, as rows with a bare number have it. What the neighbours say is a feature
only: nothing but the model gives a bare number its unit.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from fractions import Fraction

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medloom.functions.quantity import BASE, UNITS, bare_number, plain, quantities, unit_beside, unit_named
from medloom.runtime import hash_sample, materialise

PARSED = "tbl string, row_key string, category string, part_no bigint, unit string, amount bigint, value double, written string, evidence string, aside string"

# One label per kind and size of unit; the spelling first listed stands for it.
_LABEL_OF: dict[str, str] = {}
_FIRST: dict[tuple[str, int], str] = {}
for _unit, _size in UNITS.items():
    if _size[0] != "percent":
        _LABEL_OF[_unit] = _FIRST.setdefault(_size, _unit)
LABELS = tuple(dict.fromkeys(_LABEL_OF.values()))
CATEGORY_BUCKETS = 8


def _value(text: str) -> tuple[Fraction, str] | None:
    """The number and written unit of a text that is one number with a plain unit."""
    words = plain(text).strip()
    digits = len(words) - len(words.lstrip("0123456789.,"))
    unit = words[digits:].strip()
    if unit in _LABEL_OF and (value := bare_number(words[:digits])) is not None:
        return value, unit
    return None


def read_quantities(
    df: DataFrame, tbl: str, key: str, text: str, beside: Sequence[str] = (), named: Sequence[str] = (), category: str | None = None
) -> DataFrame:
    """One row per quantity in column ``text``, and one with null ``unit`` for a text that is one bare number.

    ``beside``: columns that may repeat the number with its unit; ``named``: columns that may name the unit without a
    number of its own. Their finding is ``evidence``; a unit that a ``named`` column writes beside the same number is
    ``aside`` (it may belong to another quantity). Null keys, null, blank and unit-less texts give no row. Columns of
    other names are not read.
    """
    context = [*beside, *named]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row_key, kind, dosage, *around in zip(*(c.to_pylist() for c in batch.columns)):
                value = bare_number(dosage)
                single = None if value is not None else _value(dosage)
                evidence = aside = None
                if value is not None or single is not None:
                    at = value if value is not None else single[0]
                    for text_ in around[: len(beside)]:
                        evidence = evidence or unit_beside(text_, at)
                    for text_ in around[len(beside) :]:
                        evidence = evidence or unit_named(text_)
                        aside = aside or unit_beside(text_, at)
                said = _LABEL_OF.get(evidence), _LABEL_OF.get(aside)
                if value is not None:
                    rows.append((tbl, row_key, kind, 1, None, None, float(value), None, *said))
                    continue
                for k, q in enumerate(quantities(dosage), 1):
                    written = (float(single[0]), _LABEL_OF[single[1]]) if single else (None, None)
                    rows.append((tbl, row_key, kind, k, q.unit, q.amount, *written, *said))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    schema = T._parse_datatype_string(PARSED)
    names = schema.names
    arrow = {T.StringType: pa.string(), T.LongType: pa.int64(), T.DoubleType: pa.float64()}
    types = [arrow[type(f.dataType)] for f in schema.fields]
    category_col = F.col(category) if category else F.lit(None)
    source = df.select(F.col(key).cast("string").alias("k"), category_col.cast("string").alias("c"), F.col(text).cast("string").alias("t"), *[F.col(c).cast("string").alias(f"x{i}") for i, c in enumerate(context)])
    return source.where(F.col("k").isNotNull() & F.col("t").rlike(r"\d")).mapInArrow(run, schema)


def _features(tables: Sequence[str]) -> Column:
    """Magnitude, its fraction, table, category bucket and the neighbours' unit, as a vector."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    bucket = F.pmod(F.hash(F.lower("category")), F.lit(CATEGORY_BUCKETS))
    return array_to_vector(
        F.array(
            F.log10(F.greatest(F.coalesce("value", F.lit(0.0)), F.lit(1e-6))),
            F.coalesce(F.col("value") % 1, F.lit(0.0)),
            *[flag(F.col("tbl") == t) for t in tables],
            *[flag((bucket == k) & F.col("category").isNotNull()) for k in range(CATEGORY_BUCKETS)],
            *[flag(F.col(c) == u) for c in ("evidence", "aside") for u in LABELS],
        )
    )


def predict_units(parsed: DataFrame, tables: Sequence[str], fit_rows: int = 20_000, trees: int = 30, depth: int = 9, seed: int = 11) -> DataFrame:
    """The bare numbers of ``parsed`` with ``predicted`` unit and calibrated ``confidence``.

    The ensemble is fitted on at most ``fit_rows`` labelled rows, chosen by key hash: three quarters train the trees, a quarter the isotonic calibration. With fewer than two units in the sample there is no model:
    ``predicted`` is null and ``confidence`` 0.
    """
    bare = parsed.where("unit IS NULL")
    label = F.element_at(F.create_map(*[F.lit(x) for i, u in enumerate(LABELS) for x in (u, float(i))]), F.col("written"))
    labelled = parsed.where("written IS NOT NULL").select("tbl", "row_key", "category", "value", "evidence", "aside", "written", label.alias("label"), F.xxhash64("row_key").alias("h"))
    sample = materialise(hash_sample(labelled, ["tbl", "row_key"], fit_rows), "unit-sample")
    if len(sample.select("label").distinct().limit(2).collect()) < 2:
        return bare.withColumns({"predicted": F.lit(None).cast("string"), "confidence": F.lit(0.0)})
    moved = sample.withColumns({"evidence": F.col("written"), "aside": F.lit(None).cast("string")})
    sample = sample.unionByName(moved).withColumn("features", _features(tables))
    held_out = F.pmod("h", F.lit(4)) == 0
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="0.6", maxMemoryInMB=64)
    model = forest.fit(sample.where(~held_out).select("features", "label").coalesce(2))
    top = F.array_max(vector_to_array("probability"))
    scored = model.transform(sample.where(held_out)).select(top.alias("p"), (F.col("prediction") == F.col("label")).cast("double").alias("hit"))
    calibration = IsotonicRegression(featuresCol="p", labelCol="hit", predictionCol="confidence").fit(scored) if scored.limit(1).count() else None
    out = model.transform(bare.withColumn("features", _features(tables)))
    out = out.withColumn("predicted", F.element_at(F.array(*map(F.lit, LABELS)), F.col("prediction").cast("int") + 1)).withColumn("p", top)
    out = calibration.transform(out) if calibration else out.withColumn("confidence", F.col("p"))
    return out.select(*bare.columns, "predicted", "confidence")


def convert(parsed: DataFrame, tables: Sequence[str], threshold: float = 0.9, **model: Mapping) -> DataFrame:
    """All quantities in base units, with how each came about.

    ``status``: 'written' (its unit is in the text), 'predicted' (confidence at or above ``threshold``), 'review' (unit
    and amount null). ``evidence`` is the unit that neighbouring fields name, ``predicted`` the model's, whether or not it is taken.
    """
    size = F.element_at(F.create_map(*[F.lit(x) for u in LABELS for x in (u, float(UNITS[u][1]))]), F.col("predicted"))
    base = F.element_at(F.create_map(*[F.lit(x) for u in LABELS for x in (u, BASE[UNITS[u][0]])]), F.col("predicted"))
    sure = (F.col("confidence") >= threshold) & F.col("predicted").isNotNull()
    guessed = predict_units(parsed, tables, **model).select(
        "tbl",
        "row_key",
        "part_no",
        F.when(sure, base).alias("unit"),
        F.when(sure, F.round(F.col("value") * size).cast("bigint")).alias("amount"),
        F.when(sure, "predicted").otherwise("review").alias("status"),
        "evidence",
        "predicted",
        F.round("confidence", 4).alias("confidence"),
    )
    written = parsed.where("unit IS NOT NULL").select("tbl", "row_key", "part_no", "unit", "amount", F.lit("written").alias("status"), "evidence", F.col("written").alias("predicted"), F.lit(1.0).alias("confidence"))
    return written.unionByName(guessed).dropDuplicates(["tbl", "row_key", "part_no", "unit", "amount"])
