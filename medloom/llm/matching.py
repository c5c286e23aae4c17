"""Matching products across tables without a common key (problem 4): a deterministic rule cascade.

Every record is brought to a product, a canonical brand with a strength, by
successive exact joins on weaker and weaker attributes; records that a rule
resolves are anti-joined before the next one. Brand rules join the record's
brand key with a catalogue on: the key as spelt, as it sounds, as it scans, the
keys of its sample texts, keys with one letter left out, with two left out (one
and two edits meet in such keys and are then counted, see ``within``), the last two first together with the
ingredient and then alone where only one candidate is met. Brands outside the
catalogue are resolved among themselves the same way, rare spellings to frequent
ones; of equally frequent ones the spelling that names an ingredient, then the smaller
key, is the entry. Records of one product in different tables match.

Confidence: each rule's precision, counted on records that it resolves by evidence
that it does not use, smoothed by (hits + 1) / (cases + 2). Rules on the whole key: whether
the record's ingredient is the entry's, where both are known. Rules with edits, which look at
the ingredient: how often another record of the entry, resolved as spelt, has the same strength,
as a share of how often that is so of records that are themselves resolved as spelt. A match has the product of
its rules' precisions.

All joins are equi-joins on keys; nothing is broadcast and no two records of a
table are ever compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom.functions.quantity import Quantity, bare_number, of, quantities, unit_beside
from medloom.llm.canonical import list_key, scan, segments, sound
from medloom.runtime import Passes, materialise

RECORD = "tbl string, id bigint, brand string, strength string, strength_rule string, name_strength string, ingredients array<string>, texts array<string>"


def _strength(found: list[Quantity]) -> str | None:
    return " + ".join(f"{q.amount} {q.unit}" for q in sorted(found, key=lambda q: (q.unit, q.amount))) or None


def _keys(text: str | None) -> list[str]:
    return [key for _, level, key in segments(text) if level == 0]


def read_records(df: DataFrame, tbl: str, row_id: str, brand: str, name: str | None, generic: str, dosage: str, texts: str | None = None) -> DataFrame:
    """Records with keys: ``brand`` (of column ``brand``, else of ``name``), ``strength``, ``ingredients``, ``texts``.

    The strength is that of the dosage, else of the name, else of the sample texts if they agree. Records without id, or
    without any brand, have no row; a strength that is missing everywhere is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, b, n, g, dose, samples in zip(*(c.to_pylist() for c in batch.columns)):
                own = _keys(b) or _keys(n)
                samples = samples or []
                in_dose, in_name = quantities(dose), quantities(b) or quantities(n)
                rule, strength = "dosage", _strength(in_dose)
                if not strength and (value := bare_number(dose)) is not None and (unit := unit_beside(b, value) or unit_beside(n, value)):
                    rule, strength = "bare", _strength([of(value, unit)])
                if not strength:
                    rule, strength = "name", _strength(in_name)
                if not strength and len(said := {s for t in samples if (s := _strength(quantities(t)))}) == 1:
                    rule, strength = "texts", said.pop()
                keys = sorted({k for t in samples for k in _keys(t)[:1]})
                if own:
                    out.append((tbl, i, own[0], strength, rule if strength else "none", _strength(in_name), _keys(g), keys))
            if out:
                types = [pa.string(), pa.int64(), *[pa.string()] * 4, *[pa.list_(pa.string())] * 2]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["tbl", "id", "brand", "strength", "strength_rule", "name_strength", "ingredients", "texts"])

    null = F.lit(None).cast("string")
    told = df.where(F.col(row_id).isNotNull()).dropDuplicates([row_id])
    return told.select(F.col(row_id).cast("bigint"), brand, (F.col(name) if name else null).alias("_n"), generic, dosage, F.col(texts).alias("_t") if texts else F.lit(None).cast("array<string>").alias("_t")).mapInArrow(run, RECORD)


def less_one(key: Column) -> Column:
    """The key and all keys with one letter left out."""
    drop = F.transform(F.sequence(F.lit(1), F.length(key)), lambda i: F.concat(F.substr(key, F.lit(1), i - 1), F.substr(key, i + 1)))
    return F.array_distinct(F.concat(F.array(key), drop))


def less_two(key: Column) -> Column:
    """The key and all keys with one or two letters left out."""
    return F.array_distinct(F.flatten(F.transform(less_one(key), less_one)))


def within(a: Column, b: Column, edits: int, letters: int = 3) -> Column:
    """Whether two keys that share a key of ``less_one`` or ``less_two`` are so many edits apart, a moved letter being one.

    Keys of fewer than ``letters`` letters an edit are too short to be told apart so.
    """
    d = F.levenshtein(a, b, edits + 1)  # -1 beyond
    spelling = lambda c: F.array_sort(F.split(c, ""))
    moved = (d == edits + 1) & (spelling(a) == spelling(b)) if edits == 1 else (d == edits + 1) & (F.length(a) == F.length(b))
    return (F.least(F.length(a), F.length(b)) >= edits * letters) & (((d >= 0) & (d <= edits)) | moved)


def _enough(keys, edits: int, letters: int = 3):
    """``keys`` only of a key that is long enough for so many edits: short ones would all meet on a few keys."""
    return lambda key: F.when(F.length(key) >= edits * letters, keys(key)).otherwise(F.array().cast("array<string>"))


# Rules in order of strength, by pass: those of one pass share a join, records that it resolves leave before the next.
PASSES = (("spelt", "sound", "scan", "texts"), ("one",), ("two",))
RANK = {rule: n for n, rule in enumerate(("spelt", "sound", "scan", "texts", "one+ingredient", "one", "two+ingredient", "two"))}
EDITS = {"one": 1, "two": 2}
_KEYS = {"spelt": F.array, "sound": lambda k: F.array(sound(k)), "scan": lambda k: F.array(scan(k)), "texts": F.array, "one": _enough(less_one, 1), "two": _enough(less_two, 2)}


def _tagged(rules: tuple[str, ...], key: Column, texts: Column | None) -> Column:
    """Keys with the rule they belong to; the rule 'texts' takes the keys of the sample texts where there are some."""

    def tag(rule: str) -> Column:
        keys = texts if rule == "texts" and texts is not None else _KEYS[rule](key)
        return F.transform(keys, lambda k: F.struct(F.lit(rule).alias("rule"), k.alias("k")))

    return F.inline(F.array_distinct(F.concat(*[tag(r) for r in rules])))


def cascade(records: DataFrame, catalogue: DataFrame, label: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """``tbl``, ``id``, ``brand_id``, ``rule`` of the records that some rule resolves to one entry of ``catalogue``.

    ``catalogue``: ``brand_id``, ``brand_key``, ``said`` (its ingredients as they sound). A rule that meets several
    entries leaves the record to the next. Rules in ``skip`` resolve nothing.
    """
    passes = Passes(records.sparkSession, label, "tbl string, id bigint, brand_id string, rule string")
    rank = F.create_map(*[F.lit(x) for r, n in RANK.items() for x in (r, n)])
    for rules in PASSES:
        left = records.join(passes.table(), ["tbl", "id"], "left_anti") if passes.paths else records
        asked = left.select("tbl", "id", "brand", "said", _tagged(rules, F.col("brand"), F.col("texts")))
        held = catalogue.select("brand_id", "brand_key", F.col("said").alias("has"), _tagged(rules, F.col("brand_key"), None))
        met = asked.join(held.hint("merge"), ["rule", "k"])  # the exploded side is larger than its source: never broadcast
        if rules[0] in EDITS:
            met = met.where(within(F.col("brand"), F.col("brand_key"), EDITS[rules[0]]))
        agrees = F.when(F.arrays_overlap("said", "has"), F.col("brand_id"))
        met = met.groupBy("tbl", "id", "rule").agg(
            F.min("brand_id").alias("lo"), F.max("brand_id").alias("hi"), F.min(agrees).alias("lo_i"), F.max(agrees).alias("hi_i")
        )
        edited = F.col("rule").isin("one", "two")
        rule = F.when(edited & (F.col("lo_i") == F.col("hi_i")), F.concat("rule", F.lit("+ingredient"))).when(F.col("lo") == F.col("hi"), F.col("rule"))
        entry = F.when(rule.endswith("+ingredient"), F.col("lo_i")).otherwise(F.col("lo"))
        sure = met.select("tbl", "id", rule.alias("rule"), entry.alias("brand_id")).where(F.col("rule").isNotNull() & ~F.col("rule").isin(*skip, ""))
        best = sure.groupBy("tbl", "id").agg(F.min_by(F.struct("brand_id", "rule"), rank[F.col("rule")]).alias("b"))
        passes.add(best.select("tbl", "id", "b.brand_id", "b.rule"))
    return passes.table()


def match_products(records: DataFrame, brands: DataFrame) -> DataFrame:
    """``left_tbl``, ``left_id``, ``right_tbl``, ``right_id``, ``confidence``: records of different tables for one product.

    ``brands``: the known brands, ``brand_key`` and ``said``. Records without strength match nothing. The table earlier in
    the alphabet is left. Each pair comes once; empty inputs give an empty result.
    """
    records = materialise(records.withColumn("said", F.transform("ingredients", sound)), "records")
    listed = brands.select(F.concat(F.lit("L:"), "brand_key").alias("brand_id"), "brand_key", "said").dropDuplicates(["brand_id"])
    # Two edits alone, without the ingredient, met a wrong listed brand more often than the right one.
    known = cascade(records, listed, "listed", skip=("two",))
    rest = records.join(known, ["tbl", "id"], "left_anti")
    # Brands that no list has: their own frequent spellings are the catalogue.
    told = rest.select("brand", F.explode("said").alias("one")).groupBy("brand", "one").agg(F.count("*").alias("m"))
    usual = told.groupBy("brand").agg(F.array(F.max_by("one", F.struct("m", "one"))).alias("said"))
    votes = rest.groupBy("brand").agg(F.count("*").alias("n")).join(usual, "brand", "left")
    votes = materialise(votes.withColumn("said", F.coalesce("said", F.array().cast("array<string>"))), "votes")
    near = votes.withColumn("key", sound(F.col("brand"))).select("brand", "key", "n", "said", F.explode(_KEYS["two"](F.col("key"))).alias("k"))
    stronger = near.select("k", F.col("brand").alias("better"), F.col("key").alias("better_key"), F.col("n").alias("m"), F.col("said").alias("has"))
    # Of equally frequent spellings one gives way, unless they name different ingredients.
    named, other = F.size("said") > 0, F.size("has") > 0
    tied = (F.col("m") == F.col("n")) & (~named | ~other | F.arrays_overlap("said", "has"))
    gives_way = (F.col("m") > F.col("n")) | (tied & ((other & ~named) | ((other == named) & (F.col("better") < F.col("brand")))))
    weak = near.join(stronger.hint("merge"), "k").where(gives_way & (F.col("better") != F.col("brand")) & within(F.col("key"), F.col("better_key"), 2)).select("brand").distinct()
    weak = materialise(weak, "weak")
    own = votes.join(weak, "brand", "left_anti").select(F.concat(F.lit("O:"), "brand").alias("brand_id"), F.col("brand").alias("brand_key"), "said")
    met = cascade(rest, own, "own")
    # A spelling that gave way and met no entry, or several, still stands for itself.
    left = rest.join(weak, "brand").join(met, ["tbl", "id"], "left_anti").select("tbl", "id", F.concat(F.lit("O:"), "brand").alias("brand_id"), F.lit("spelt").alias("rule"))
    found = materialise(known.union(met).union(left), "resolved")
    products = records.join(found, ["tbl", "id"])

    # Labelled precision of the brand rules.
    truth = listed.unionByName(own).select("brand_id", F.col("said").alias("has"))
    backed = products.where("rule = 'spelt' AND strength IS NOT NULL").groupBy("brand_id", "strength").agg(F.min(F.struct("tbl", "id")).alias("lo"), F.max(F.struct("tbl", "id")).alias("hi"))
    judged = products.join(truth, "brand_id").join(backed, ["brand_id", "strength"], "left")
    me = F.struct("tbl", "id")
    support = F.coalesce((F.col("lo") != me) | (F.col("hi") != me), F.lit(False))
    # Only ingredients that some listed brand has can be told right from wrong.
    real = brands.select(F.explode("said").alias("one")).distinct().withColumn("real", F.lit(True))
    told = products.select("tbl", "id", F.explode("said").alias("one")).join(real, "one").select("tbl", "id").distinct().withColumn("told", F.lit(True))
    judged = judged.join(told, ["tbl", "id"], "left")
    agrees = F.when(F.col("told") & (F.size("has") > 0), F.arrays_overlap("said", "has"))
    smooth = lambda hit: (F.coalesce(F.sum(hit.cast("int")), F.lit(0)) + 1) / (F.count(hit) + 2)
    strong = F.when(F.col("strength").isNotNull(), support)
    counted = {r.rule: (float(r.by_ingredient), float(r.by_strength)) for r in judged.groupBy("rule").agg(smooth(agrees).alias("by_ingredient"), smooth(strong).alias("by_strength")).collect()}  # a row per rule
    usual = counted.get("spelt", (0.5, 0.5))[1]
    precision = {rule: min(1.0, by_strength / usual) if rule.split("+")[0] in EDITS else by_ingredient for rule, (by_ingredient, by_strength) in counted.items()}
    # And of the strength rules, where dosage and name both tell one.
    both = products.where("strength_rule = 'dosage' AND name_strength IS NOT NULL")
    p_name = both.agg((F.coalesce(F.sum((F.col("strength") == F.col("name_strength")).cast("int")), F.lit(0)) + 1) / (F.count("*") + 2)).first()[0]
    p_strength = F.when(F.col("strength_rule") == "dosage", 1.0).otherwise(F.lit(float(p_name)))

    p_brand = F.create_map(*[F.lit(x) for r in RANK for x in (r, float(precision.get(r, 0.5)))])[F.col("rule")]
    sure = products.where("strength IS NOT NULL").select("tbl", "id", "brand_id", "strength", (p_brand * p_strength).alias("p"))
    a, b = (sure.select("brand_id", "strength", *[F.col(c).alias(f"{s}_{c}") for c in ("tbl", "id", "p")]) for s in ("left", "right"))
    pairs = a.join(b, ["brand_id", "strength"]).where("left_tbl < right_tbl")
    return pairs.select("left_tbl", "left_id", "right_tbl", "right_id", F.round(F.col("left_p") * F.col("right_p"), 4).alias("confidence"))


def known_brands(brand_list: DataFrame, ingredient_list: DataFrame) -> DataFrame:
    """``brand_key``, ``said``: the brands of the list with their ingredient."""
    ingredient = ingredient_list.select(F.col("entry_id").alias("ingredient_id"), sound(list_key(F.col("name"))).alias("one"))
    joined = brand_list.select("ingredient_id", list_key(F.col("brand_name")).alias("brand_key")).where("brand_key <> ''").join(ingredient, "ingredient_id", "left")
    return joined.groupBy("brand_key").agg(F.collect_set("one").alias("said"))
