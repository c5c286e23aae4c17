"""Mapping typed values to the entries of a canonical list (problem 6).

Values are reduced to distinct ones and normalised: list numbers, strengths,
forms, counts and salts go, and what separates two names splits the value into
segments, each a key of letters and digits. Keys equal to an entry's are
resolved by an equi-join. For the others an inverted index of positional
character n-grams gives the candidates, which are scored by the cosine of
2-gram and 3-gram vectors weighted by inverse entry frequency; the best is
accepted above a threshold, with a margin over the second and within a few edits.

Retrieval is complete: an entry is cut into one gram more than the edits allowed,
so whatever is edited, one gram stands unchanged, shifted by no more than the edits
around it. The index holds entries' grams by length and place, and a key looks up
the grams that can meet each. Keys are indexed as spelt, as they sound (ph as f, k
as c, l as i) and as they scan (e as c, l as i), since few edits may be counted in any.

Both sides of every join are partitioned by key or gram: the list may grow with
the data. Only the weights of the 2- and 3-grams of keys (a-z, 0-9 and two marks) are
sent to tasks, at most 38**2 + 38**3 of them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medloom.functions.quantity import MULTIPLIERS, UNITS, plain
from medloom.runtime import materialise

# Words that follow a name without being part of it (forms, packs, counts, salts), folded.
NOISE = (
    "amp", "ampoule", "anhydrous", "bot", "cap", "capsule", "caps", "chai", "clorid", "cream", "dang", "dung", "extract", "gel",
    "giot", "goi", "hcl", "hop", "hydroclorid", "hydrochloride", "inj", "kali", "kem", "lo", "maleat", "mo", "monohydrat",
    "monohydrate", "muoi", "nang", "natri", "nen", "nho", "nuoc", "ong", "oral", "phim", "potassium", "sac", "salt", "siro",
    "sl", "so", "sodium", "stt", "sui", "sulfat", "syrup", "tab", "tablet", "tablets", "tabs", "tiem", "trong", "tube", "tuyp",
    "vi", "vien", "x",
)
# Digits that scanning puts in place of letters.
CONFUSED = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "b", "7": "t", "8": "b", "9": "g"})

#: Letters from which on a single word of a longer segment may stand for a name with edits.
WORD = 6

_UNIT = "|".join(sorted(map(re.escape, UNITS), key=len, reverse=True))
_MARKER = re.compile(r"^\s*(?:stt\s*\d+\s*[.):-]*|\d+\s*[.):-]+)\s*(?=\D)")
_PACK = re.compile(r"(?<![a-z0-9])(?:x|sl)\s*\d+(?![a-z0-9])")
_AMOUNT = re.compile(rf"(?<![a-z0-9])\d+(?:[.,]\d+)*\s*(?:(?:{'|'.join(MULTIPLIERS)})\s*)?(?:(?:{_UNIT})(?![a-z0-9])|(?![a-z0-9]))(?:\s*(?:/|trong)\s*(?:{_UNIT})(?![a-z0-9]))?")
_SPLIT = re.compile(r"[()\[\]/+,;&|]| va | and | - ")


def segments(value: str | None) -> list[tuple[int, int, str]]:
    """(number, level, key) of the names that a value may hold; level 1: single words of a segment of several, level 2:
    such words that are too short to be matched with edits."""
    if not value:
        return []
    text = _MARKER.sub(" ", plain(value))
    text = _AMOUNT.sub(" | ", _PACK.sub(" | ", text))
    out = []
    for number, part in enumerate(_SPLIT.split(f" {text} ")):
        words = [w for w in re.split(r"[^a-z0-9]+", part) if w]
        while words and words[-1] in NOISE:
            words.pop()
        key = "".join(words).translate(CONFUSED)
        if key:
            out.append((number, 0, key))
            if len(words) > 1:
                out += [(number, 1 if len(w) >= WORD else 2, w.translate(CONFUSED)) for w in words]
    return out


def list_key(name: Column) -> Column:
    """The key of a list entry."""
    from medloom.functions.text import fold_col

    return F.regexp_replace(fold_col(name), "[^a-z0-9]+", "")


def sound(key: Column) -> Column:
    """The key as it sounds and scans: spellings that are taken for each other are one."""
    return F.regexp_replace(F.translate(F.regexp_replace(key, "ph", "f"), "kyl", "cii"), r"(.)\1+", "$1")


def _segment_table(values: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(v, *s) for v in batch.column(0).to_pylist() for s in segments(v)]
            if rows:
                types = [pa.string(), pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["value", "number", "level", "key"])

    return values.mapInArrow(run, "value string, number int, level int, key string")


def scan(key: Column) -> Column:
    """The key with letters that scanning confuses made one."""
    return F.translate(key, "el", "ci")


def _cut(m: Column, edits: int, place: int) -> tuple[Column, Column]:
    """Start (zero-based) and length of the gram at ``place`` of ``edits`` + 1 that a key of length ``m`` is cut into."""
    parts = edits + 1
    short = (m / parts).cast("int")
    longer = m % parts  # this many grams, the last ones, have a letter more
    first_long = parts - longer
    return short * place + F.greatest(F.lit(place) - first_long, F.lit(0)), short + (F.lit(place) >= first_long).cast("int")


def _entry_grams(key: Column, form: str, edits: int) -> list[Column]:
    """Hashes of the grams that an entry is indexed by."""
    m = F.length(key)
    out = []
    for place in range(edits + 1):
        start, length = _cut(m, edits, place)
        out.append(F.array(F.xxhash64(F.lit(form), m, F.lit(place), F.substr(key, start + 1, length))))
    return out


def _key_grams(key: Column, form: str, edits: int) -> list[Column]:
    """Hashes of the grams of a key that can meet an entry's: for each length, place and shift that so many edits allow."""
    n = F.length(key)
    out = []
    for longer in range(-edits, edits + 1):
        m = n + longer
        for place in range(edits + 1):
            start, length = _cut(m, edits, place)
            for shift in range(-edits, edits + 1):
                # No more edits before the gram than its place, no more after it than are left.
                if abs(shift) <= place and abs(shift + longer) <= edits - place:
                    at = start + shift
                    inside = (m >= 1) & (at >= 0) & (at + length <= n)
                    out.append(F.when(inside, F.xxhash64(F.lit(form), m, F.lit(place), F.substr(key, at + 1, length))))
    return [F.array_compact(F.array(*out))]


#: The forms in which keys are compared, with the edits that each may differ by and how many more these count for.
FORMS = (("spelt", lambda k: k, 2, 0), ("said", sound, 2, 0), ("scanned", scan, 1, 1))


def candidates(keys: DataFrame, entries: DataFrame) -> DataFrame:
    """``key``, ``entry_key``, ``edits``: all pairs within two edits as spelt or as sounded, or one as scanned (which counts two).

    ``keys``: ``key``; ``entries``: ``entry_key``; both distinct. Complete, whatever the length of the keys.
    """
    asked, held = [], []
    for form, f, edits, more in FORMS:
        # The form is computed once, ahead of the many expressions that use it.
        for df, key, text, grams, out in ((keys, "key", "a", _key_grams, asked), (entries, "entry_key", "b", _entry_grams, held)):
            told = df.select(key, f(F.col(key)).alias(text))
            every = F.explode(F.array_distinct(F.concat(*grams(F.col(text), form, edits)))).alias("gram")
            out.append(told.select(key, text, F.lit(edits).alias(f"{text}_most"), F.lit(more).alias(f"{text}_more"), every))
    left, right = (reduce(DataFrame.unionByName, sides) for sides in (asked, held))
    met = left.join(right.drop("b_most", "b_more").hint("merge"), "gram")
    edits = F.when(F.col("a_most") == 2, F.levenshtein("a", "b", 2)).otherwise(F.levenshtein("a", "b", 1))  # -1 beyond
    near = met.select("key", "entry_key", edits.alias("d"), "a_more").where("d >= 0")
    return near.groupBy("key", "entry_key").agg(F.min(F.col("d") + F.col("a_more")).alias("edits"))


def _pieces(key: str) -> Counter:
    padded = f"^{key}$"
    return Counter(padded[i : i + n] for n in (2, 3) for i in range(len(padded) - n + 1))


def _weights(entries: DataFrame) -> dict[str, float]:
    padded = F.concat(F.lit("^"), F.col("entry_key"), F.lit("$"))
    every = [F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i, n=n: F.substr(padded, i, F.lit(n))) for n in (2, 3)]
    counts = entries.where("length(entry_key) >= 2").select(F.explode(F.array_distinct(F.concat(*every))).alias("gram")).groupBy("gram").count()
    total = max(entries.count(), 1)
    return {gram: math.log(1 + total / n) for gram, n in counts.collect()} | {"": math.log(1 + total)}


def fuzzy(keys: DataFrame, entries: DataFrame, threshold: float, margin: float, letters: int = 3) -> DataFrame:
    """``key``, ``entry_id``, ``kind``, ``confidence``: the accepted entry of each key that no entry equals.

    An edit is believed only for every ``letters`` letters of the shorter of both.
    """
    listed = entries.select("entry_id", "kind", "entry_key")
    met = candidates(materialise(keys.select("key"), "unresolved"), listed.select("entry_key")).where(F.least(F.length("key"), F.length("entry_key")) >= F.col("edits") * letters)
    met = met.join(listed, "entry_key").select("key", sound(F.col("key")).alias("said"), "entry_id", "kind", sound(F.col("entry_key")).alias("entry_said"), "edits")
    weights = _weights(listed.select(sound(F.col("entry_key")).alias("entry_key")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = weights[""]
        norm: dict[str, tuple[Counter, float]] = {}

        def vector(key: str) -> tuple[Counter, float]:
            if key not in norm:
                if len(norm) > 200_000:
                    norm.clear()
                grams = _pieces(key)
                norm[key] = grams, math.sqrt(sum((n * weights.get(g, rare)) ** 2 for g, n in grams.items()))
            return norm[key]

        for batch in batches:
            out = []
            for said, entry in zip(batch.column(1).to_pylist(), batch.column(4).to_pylist()):
                a, x = vector(said)
                b, y = vector(entry)
                out.append(sum(n * b[g] * weights.get(g, rare) ** 2 for g, n in a.items() if g in b) / (x * y))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, "cosine"])

    scored = met.mapInArrow(score, "key string, said string, entry_id bigint, kind string, entry_said string, edits int, cosine double")
    order = Window.partitionBy("key").orderBy(F.desc("cosine"), "entry_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where("rank <= 2")
    best = ranked.groupBy("key").agg(
        F.max(F.when(F.col("rank") == 1, F.col("cosine"))).alias("cosine"),
        F.max(F.when(F.col("rank") == 2, F.struct("cosine", "edits"))).alias("second"),
        F.max(F.when(F.col("rank") == 1, F.struct("entry_id", "kind", "edits"))).alias("e"),
    )
    # A margin over the second, or fewer edits than it has.
    apart = (F.col("cosine") - F.coalesce("second.cosine", F.lit(0.0)) >= margin) | (F.col("e.edits") < F.col("second.edits"))
    return best.where((F.col("cosine") >= threshold) & apart).select("key", "e.entry_id", "e.kind", F.col("cosine").alias("confidence"))


def map_values(rows: DataFrame, entries: DataFrame, value: str = "value", prefer: str = "brand", threshold: float = 0.35, margin: float = 0.08) -> DataFrame:
    """``value``, ``entry_id``, ``kind``, ``confidence`` of every distinct value of ``rows`` that names an entry.

    ``entries``: ``entry_id``, ``name``, ``kind``. A value that names entries of kind ``prefer`` counts as those only.
    Entries with equal keys: the smallest id stands for them. Null and blank values and those that name no entry have no
    row; entries with null or empty names match nothing; empty tables give empty results.
    """
    listed = entries.select(F.col("entry_id").cast("bigint").alias("entry_id"), "kind", list_key(F.col("name")).alias("entry_key")).where("entry_key <> '' AND entry_id IS NOT NULL")
    listed = listed.groupBy("entry_key").agg(F.min(F.struct("entry_id", "kind")).alias("e")).select("e.*", "entry_key")
    distinct = rows.where(F.trim(value) != "").select(F.col(value).alias("value")).distinct()
    parts = materialise(_segment_table(distinct), "segments")
    keys = parts.select("key").distinct()
    exact = keys.join(listed, keys.key == listed.entry_key).select("key", "entry_id", "kind", F.lit(1.0).alias("confidence"))
    rest = parts.where("level < 2").select("key").distinct().join(listed, F.col("key") == listed.entry_key, "left_anti")
    matched = materialise(exact.unionByName(fuzzy(rest, listed, threshold, margin)), "matched")
    named = parts.join(matched, "key")
    # Whole segments before their single words; names of the preferred kind before others.
    level = F.least("level", F.lit(1))
    named = named.withColumn("first", F.min(level).over(Window.partitionBy("value", "number"))).where(level == F.col("first"))
    preferred = F.max((F.col("kind") == prefer).cast("int")).over(Window.partitionBy("value"))
    named = named.withColumn("some", preferred).where((F.col("some") == 0) | (F.col("kind") == prefer))
    return named.groupBy("value", "entry_id", "kind").agg(F.max("confidence").alias("confidence"))


def map_rows(rows: DataFrame, mapped: DataFrame) -> DataFrame:
    """``rows`` (``field_name``, ``row_key``, ``value``) with ``entry_id``: one row per entry named, 0 where none is.

    Null keys and null or blank values give no row; repeated rows count once.
    """
    told = rows.where("row_key IS NOT NULL AND value IS NOT NULL").where(F.regexp_replace("value", r"[\s\x{00a0}]+", "") != "")
    return told.join(mapped, "value", "left").select("field_name", "row_key", F.coalesce("entry_id", F.lit(0)).alias("entry_id")).dropDuplicates()
