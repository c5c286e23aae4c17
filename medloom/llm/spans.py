"""Long exact spans shared between records (problem 9): relative Lempel-Ziv factors against indexed blocks.

Equal texts are one record with copies. Every text is indexed by *reference blocks*:
substrings of ``block`` characters chosen by content (the least hash in each window), so
that any span of ``min_chars`` holds at least one, the same one wherever the span occurs.
Blocks seen in two or more records are the references. A record is factored
against every reference block it holds: the match is extended to both sides as far as
characters agree, checked one by one in the text around the block, and matches
that overlap at one shift between two records are joined to one factor, so that a factor
is as long as the two records agree. Factors of ``min_chars`` or more are the shared spans. From its
factors each record is parsed greedily from left to right: at each place the factor that
reaches furthest, else a literal up to the next; the phrases say how much of it is shared.

Skew: occurrences of a block with equal surroundings form one class, so copies of a passage
are compared once. Blocks with few classes compare them pairwise; blocks with
more than ``pairwise`` classes (a short notice in countless records) are joined
on the hashes of every possible span around the block instead, which meets only
true matches. Nothing is dropped either way.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medloom.llm.arrays import chunks, code_points, prefix_hashes, range_hashes, sliding_argmin
from medloom.runtime import materialise

CHUNK = 500_000


def _pieces(ids: list, texts: list[str], overlap: int) -> Iterator[tuple[int, int, str]]:
    """Long texts in overlapping pieces, so that memory stays bounded: id, offset, piece."""
    for i, t in zip(ids, texts):
        for start in range(0, max(1, len(t) - overlap), CHUNK):
            yield i, start, t[start : start + CHUNK + overlap]


def reference_blocks(docs: DataFrame, id_col: str, text_col: str, min_chars: int, block: int) -> DataFrame:
    """The blocks of every text: ``fp`` (hash), ``doc``, ``pos`` (zero-based), ``digest`` (of the whole text). Texts under ``min_chars`` have none."""
    width = min_chars - block + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            pieces = list(_pieces(list(zip(batch.column(0).to_pylist(), map(_digest, texts))), texts, min_chars - 1))
            for a, b in chunks([p[2] for p in pieces], CHUNK):
                codes, starts = code_points([p[2] for p in pieces[a:b]])
                if len(codes) < min_chars:
                    continue
                prefix = prefix_hashes(codes)
                at = np.arange(len(codes) - block + 1)
                hashes = range_hashes(prefix, at, at + block)
                places = sliding_argmin(hashes, width)
                piece = np.searchsorted(starts, np.arange(len(places)), side="right") - 1
                chosen = np.unique(places[np.arange(len(places)) + min_chars <= starts[piece + 1]])
                piece = np.searchsorted(starts, chosen, side="right") - 1
                doc = np.array([p[0][0] for p in pieces[a:b]], dtype=np.int64)[piece]
                digest = pa.array([p[0][1] for p in pieces[a:b]], pa.binary()).take(pa.array(piece))
                offset = np.array([p[1] for p in pieces[a:b]], dtype=np.int64)[piece]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[chosen].view(np.int64)), pa.array(doc), pa.array((chosen - starts[piece] + offset).astype(np.int32)), digest],
                    names=["fp", "doc", "pos", "digest"],
                )

    source = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return source.where(f"doc IS NOT NULL AND length(text) >= {min_chars}").mapInArrow(run, "fp bigint, doc bigint, pos int, digest binary")


def _digest(text: str) -> bytes:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _surroundings(docs: DataFrame, block: int, need: int) -> DataFrame:
    """The ``need`` characters before and after each block, one row per block; a text travels once, however many it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text, fps, places in zip(*(c.to_pylist() for c in batch.columns)):
                out += [(fp, doc, p, text[max(0, p - need) : p], text[p + block : p + block + need]) for fp, p in zip(fps, places)]
            for start in range(0, len(out), 20_000):
                columns = zip(zip(*out[start : start + 20_000]), (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["fp", "doc", "pos", "left", "right"])

    return docs.mapInArrow(run, "fp bigint, doc bigint, pos int, left string, right string")


def _common(a: str, b: str) -> int:
    """The length of the common prefix."""
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _factors(pairs: DataFrame, need: int) -> DataFrame:
    """The factors of class pairs: common characters to the left and right of the block, ``need`` at least together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, la, lb, ra, rb = (c.to_pylist() for c in batch.columns)
            left = [_common(x[::-1], y[::-1]) for x, y in zip(la, lb)]
            right = [_common(x, y) for x, y in zip(ra, rb)]
            keep = [k for k in range(len(a)) if left[k] + right[k] >= need]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c[k] for k in keep], t) for c, t in ((a, pa.int64()), (b, pa.int64()), (left, pa.int32()), (right, pa.int32()))],
                names=["class_a", "class_b", "l", "r"],
            )

    columns = ["class_a", "class_b", "left_a", "left_b", "right_a", "right_b"]
    return pairs.select(*columns).mapInArrow(run, "class_a bigint, class_b bigint, l int, r int")


def _span_keys(classes: DataFrame, need: int) -> DataFrame:
    """For every span of full length around the block, a hash: classes with a common key share that span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, ids, lefts, rights = (c.to_pylist() for c in batch.columns)
            for fp, i, left, right in zip(fps, ids, lefts, rights):
                codes, _ = code_points([left + right])
                begin = np.arange(max(0, len(left) - need), len(left) + 1)
                begin = begin[begin + need <= len(left) + len(right)]
                if len(begin):
                    keys = range_hashes(prefix_hashes(codes), begin, begin + need)
                    # The share to the left belongs to the key: the block lies at the same place of the span.
                    keys = keys * np.uint64(2 * need + 1) + (len(left) - begin).astype(np.uint64)
                    n = len(keys)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, fp, dtype=np.int64)), pa.array(np.full(n, i, dtype=np.int64)), pa.array(keys.view(np.int64))],
                        names=["fp", "class", "key"],
                    )

    return classes.select("fp", "class", "left", "right").mapInArrow(run, "fp bigint, class bigint, key bigint")


class SharedSpans:
    """The classes of block occurrences of a corpus and the factors between them.

    Null ids, null and short texts take no part; repeated rows count as one record; texts equal throughout share all of
    themselves and are compared with others once; an empty table gives empty results. Columns other than the two named are never read.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 300, block: int = 100, pairwise: int = 200) -> None:
        self.block, self.min_chars = block, min_chars
        need = min_chars - block
        blocks = materialise(reference_blocks(docs, id_col, text_col, min_chars, block), "blocks")
        shared = blocks.groupBy("fp").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("fp")
        owners = blocks.select("digest", "doc").distinct()
        texts = owners.groupBy("digest").agg(F.min("doc").alias("rep"), F.count("*").alias("copies"))
        #: Every record of ``min_chars`` with the first record of equal text, and how many have it.
        self.copies = materialise(owners.join(texts, "digest").select("doc", "rep", "copies"), "copies")
        first = self.copies.where("doc = rep").select("doc").distinct()
        found = blocks.select("fp", "doc", "pos").join(shared, "fp").join(first, "doc")
        found = found.join(found.groupBy("fp").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("fp"), "fp")
        text = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text")).where(f"doc IS NOT NULL AND length(text) >= {min_chars}")
        places = found.groupBy("doc").agg(F.collect_list(F.struct("fp", "pos")).alias("places"))  # as many as its text is long
        around = _surroundings(places.join(text, "doc").select("doc", "text", "places.fp", "places.pos"), block, need)
        around = around.withColumn("class", F.xxhash64("fp", "left", "right"))
        around = materialise(around.dropDuplicates(["class", "doc", "pos"]), "occurrences")
        self.members = around.select("class", "doc", "pos")
        classes = around.groupBy("fp", "class").agg(F.first("left").alias("left"), F.first("right").alias("right"), F.min("doc").alias("lo"), F.max("doc").alias("hi"))
        self.classes = classes = materialise(classes, "classes")
        size = classes.groupBy("fp").agg(F.count("*").alias("n"))
        few = classes.join(size.where(f"n BETWEEN 2 AND {pairwise}").select("fp"), "fp")
        many = classes.join(size.where(f"n > {pairwise}").select("fp"), "fp")

        def side(df: DataFrame, s: str) -> DataFrame:
            return df.select("fp", *[F.col(c).alias(f"{c}_{s}") for c in ("class", "left", "right")])

        direct = side(few, "a").join(side(few, "b"), "fp").where("class_a < class_b")
        keys = _span_keys(many, need)
        met = keys.withColumnRenamed("class", "class_a").join(keys.withColumnRenamed("class", "class_b").hint("merge"), ["fp", "key"])
        met = met.where("class_a < class_b").select("fp", "class_a", "class_b").dropDuplicates()
        keyed = met.join(side(many, "a"), ["fp", "class_a"]).join(side(many, "b"), ["fp", "class_b"])
        met = _factors(direct.unionByName(keyed), need)
        own = classes.where(f"lo < hi AND length(left) + length(right) >= {need}")
        met = met.union(own.select("class", "class", F.length("left"), F.length("right")))
        self.matches = materialise(met, "matches")

    def factors(self) -> DataFrame:
        """``doc_a``, ``start_a``, ``doc_b``, ``start_b``, ``chars``: the factors of ``min_chars`` or more that two different texts share.

        Of equal texts the first record stands for all; ``doc_a`` < ``doc_b``.
        """
        a, b = (self.members.select(F.col("class").alias(f"class_{s}"), F.col("doc").alias(f"doc_{s}"), F.col("pos").alias(f"pos_{s}")) for s in "ab")
        both = self.matches.join(a, "class_a").join(b, "class_b").where("doc_a <> doc_b")
        turned = F.col("doc_a") > F.col("doc_b")
        start = {s: F.col(f"pos_{s}") - F.col("l") for s in "ab"}
        pick = lambda x, y: F.when(turned, y).otherwise(x)
        one = both.select(
            pick(F.col("doc_a"), F.col("doc_b")).alias("doc_a"), pick(start["a"], start["b"]).alias("s"), pick(F.col("doc_b"), F.col("doc_a")).alias("doc_b"),
            (pick(start["b"], start["a"]) - pick(start["a"], start["b"])).alias("shift"), (F.col("l") + F.col("r") + self.block).alias("n"),
        ).groupBy("doc_a", "doc_b", "shift", "s").agg(F.max("n").alias("n"))
        # Matches of one shift that overlap or touch are one factor.
        w = Window.partitionBy("doc_a", "doc_b", "shift").orderBy("s")
        reached = F.max(F.col("s") + F.col("n")).over(w.rowsBetween(Window.unboundedPreceding, -1))
        parts = one.withColumn("new", F.coalesce((F.col("s") > reached).cast("int"), F.lit(1))).withColumn("part", F.sum("new").over(w))
        whole = parts.groupBy("doc_a", "doc_b", "shift", "part").agg(F.min("s").alias("start_a"), F.max(F.col("s") + F.col("n")).alias("end"))
        return whole.where(F.col("end") - F.col("start_a") >= self.min_chars).select("doc_a", "start_a", "doc_b", (F.col("start_a") + F.col("shift")).alias("start_b"), (F.col("end") - F.col("start_a")).alias("chars"))

    def links(self) -> DataFrame:
        """``doc_a``, ``doc_b``: different texts that share a span, each pair once, by their first records."""
        return self.factors().select("doc_a", "doc_b").distinct()

    def pairs(self) -> DataFrame:
        """``doc_a``, ``doc_b``: all records that share a span, copies included, smaller id first, each pair once."""
        a, b = (self.copies.select(F.col("doc").alias(f"x_{s}"), F.col("rep").alias(f"doc_{s}")) for s in "ab")
        between = self.links().join(a, "doc_a").join(b, "doc_b").select("x_a", "x_b")
        equal = self.copies.where("copies > 1").select("rep", "doc")
        inside = equal.withColumnRenamed("doc", "x_a").join(equal.withColumnRenamed("doc", "x_b"), "rep").where("x_a < x_b").select("x_a", "x_b")
        return between.select(F.least("x_a", "x_b").alias("doc_a"), F.greatest("x_a", "x_b").alias("doc_b")).union(inside)

    def members_of(self) -> DataFrame:
        """``doc_id``, ``class_id``, ``copies``, ``links``: every sharing record once: the first record of its text, how many
        have that text, and with how many other texts it shares a span."""
        linked = self.links()
        ends = linked.select(F.col("doc_a").alias("rep")).union(linked.select("doc_b")).groupBy("rep").agg(F.count("*").alias("links"))
        joined = self.copies.join(ends, "rep", "left").where("copies > 1 OR links IS NOT NULL")
        return joined.select(F.col("doc").alias("doc_id"), F.col("rep").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))

    def parse(self) -> DataFrame:
        """``doc``, ``start``, ``chars``, ``ref``, ``ref_start``: the phrases of the greedy parse of each first record of a text, from left
        to right and without overlap, with the record and place that each is copied from."""
        found = self.factors()
        sides = [found.select(F.col(f"doc_{x}").alias("doc"), F.col(f"start_{x}").alias("s"), (F.col(f"start_{x}") + F.col("chars")).alias("e"), F.col(f"doc_{y}").alias("ref"), F.col(f"start_{y}").alias("ref_s")) for x, y in ("ab", "ba")]
        # Of factors that start at one place the longest; so a record has no more than its text has characters.
        longest = sides[0].union(sides[1]).groupBy("doc", "s").agg(F.max_by(F.struct("e", "ref", "ref_s"), F.struct("e", -F.col("ref"), -F.col("ref_s"))).alias("f"))
        lists = longest.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("s", "f.e", "f.ref", "f.ref_s"))).alias("factors"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[tuple] = []
                for doc, factors in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    at, best, n = 0, None, 0
                    while True:
                        while n < len(factors) and factors[n]["s"] <= at:
                            best = max(best, factors[n], key=lambda f: f["e"]) if best else factors[n]
                            n += 1
                        if best and best["e"] > at:
                            out.append((doc, at, best["e"] - at, best["ref"], best["ref_s"] + at - best["s"]))
                            at = best["e"]
                        elif n < len(factors):
                            at = factors[n]["s"]  # literals up to here
                        else:
                            break
                if out:
                    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["doc", "start", "chars", "ref", "ref_start"])

        return lists.mapInArrow(run, "doc bigint, start int, chars int, ref bigint, ref_start int")

    def coverage(self) -> DataFrame:
        """``doc_id``, ``shared_chars``, ``spans``: how much of each sharing record lies in spans found elsewhere, and in how
        many stretches. A text with copies is shared whole: ``shared_chars`` is null and ``spans`` 1."""
        before = Window.partitionBy("doc").orderBy("start")
        new = F.coalesce(F.col("start") > F.lag(F.col("start") + F.col("chars")).over(before), F.lit(True))
        parsed = self.parse().withColumn("new", new).groupBy("doc").agg(F.sum("chars").alias("shared_chars"), F.count_if("new").alias("spans"))
        single = self.copies.where("copies = 1").select("doc")
        whole = self.copies.where("copies > 1").select(F.col("doc").alias("doc_id"), F.lit(None).cast("bigint").alias("shared_chars"), F.lit(1).cast("bigint").alias("spans"))
        return parsed.join(single, "doc", "left_semi").select(F.col("doc").alias("doc_id"), "shared_chars", "spans").union(whole)
