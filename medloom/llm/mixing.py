"""Mixing sources to target weights (problem 8), in fixed-length token blocks.

Each source's documents, in a fixed order, make one stream of tokens, cut into
blocks of ``block_tokens``. The plan says how many blocks each source gives to
the mix: its share of the total, at most ``max_repeats`` times its blocks. The
mix is written in shards; a shard's source counts are multinomial draws conditioned on
the plan, that is drawn without replacement from all slots of all sources, so
that shares hold exactly and not only on average. The draw is a pseudorandom
permutation of all slots, of which each shard takes a stretch: any task can tell the
sources of any shard, whatever their number, and the driver lists none. The n-th slot of a source takes
the block at the n-th place of pseudorandom permutations of its blocks, one
after another: no block is used r+1 times before all are used r times. Slots are
joined to blocks, and blocks to documents, by index.

Streams are laid out by prefix sums in two levels (hash buckets of a source, as many
as its documents need, and documents of a bucket), so a source of any size is spread over many tasks.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medloom.llm.arrays import mix
from medloom.runtime import materialise

TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, doc_id: str, text: str, source: str, tokenizer: str) -> DataFrame:
    """``doc_id``, ``source``, ``tokens``: the size of every text, in tokens of the rank file ``tokenizer``."""

    docs.sparkSession.sparkContext.addFile(tokenizer)  # executors need not have it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(tokenizer if os.path.exists(tokenizer) else SparkFiles.get(os.path.basename(tokenizer)))
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["doc_id", "source", "tokens"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"))
    return rows.where("doc_id IS NOT NULL AND source IS NOT NULL AND length(text) > 0").mapInArrow(run, "doc_id bigint, source string, tokens bigint")


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 at ``index``: a Feistel network, walked until it falls inside."""
    half = max(1, (int(size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for r in range(4):
            salt = np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % 2**64)
            left, right = right, left ^ (mix(right + salt) & mask)
        return (left << np.uint64(half)) | right

    if size <= 1:
        return np.zeros(len(index), dtype=np.int64)
    out = once(index.astype(np.uint64))
    while len(outside := np.flatnonzero(out >= np.uint64(size))):
        out[outside] = once(out[outside])
    return out.astype(np.int64)


class Mixture:
    """A mix of ``docs`` by source towards ``targets`` (``source``, ``target_share``, ``max_repeats``).

    ``total_tokens``: the planned size (default: that of all documents with a target, once). Documents with null or empty
    text, null id or a source without target are left out; repeated rows count once; sources without documents or whose
    repeats are used up fall short and say so. ``targets`` is one row per source, a bounded table; of repeated rows the
    first by share counts, rows with null in any column are left out.
    """

    def __init__(
        self,
        docs: DataFrame,
        targets: DataFrame,
        doc_id: str = "doc_id",
        text: str = "text",
        source: str = "source",
        tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken",
        total_tokens: int | None = None,
        block_tokens: int = 256,
        shard_blocks: int = 4096,
        bucket_docs: int = 20_000,
        seed: int = 17,
    ) -> None:
        spark = self.spark = docs.sparkSession
        self.block_tokens, self.shard_blocks, self.seed = block_tokens, shard_blocks, seed
        goal: dict[str, tuple[float, int]] = {}
        for r in sorted(targets.select("source", "target_share", "max_repeats").dropna().distinct().collect()):
            goal.setdefault(r.source, (float(r.target_share), int(r.max_repeats)))
        self.goal = goal
        wanted = docs.where(F.col(source).isin(*goal)) if goal else docs.limit(0)
        counted = token_counts(wanted, doc_id, text, source, tokenizer)
        self.sizes = materialise(counted.groupBy("doc_id").agg(F.min(F.struct("source", "tokens")).alias("d")).select("doc_id", "d.*"), "sizes")
        totals = {r.source: (r.docs, r.n) for r in self.sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("n")).collect()}  # a row per source
        self.buckets = max(1, -(-max([docs for docs, _ in totals.values()], default=0) // bucket_docs))
        self.tokens = {s: totals.get(s, (0, 0))[1] for s in goal}
        self.blocks = {s: -(-n // block_tokens) for s, n in self.tokens.items()}
        self.total = sum(self.tokens.values()) if total_tokens is None else total_tokens
        self.names = sorted(goal)
        self.quota = {}
        for s in self.names:
            share, repeats = goal[s]
            # A short last block stands for less than a block's tokens.
            per_block = self.tokens[s] / self.blocks[s] if self.blocks[s] else 1
            self.quota[s] = min(round(share * self.total / per_block), max(0, repeats) * self.blocks[s])
        #: Where the slots of each source begin among all slots.
        self.edges = np.cumsum([0, *[self.quota[s] for s in self.names]]).astype(np.int64)

    def slots(self) -> DataFrame:
        """``shard``, ``source``, ``slot``, ``block``: which block fills each slot of the mix."""
        names, blocks, seed, edges, size = self.names, self.blocks, self.seed, self.edges, self.shard_blocks
        total = int(edges[-1])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                place = batch.column(0).to_numpy()
                drawn = permuted(place, total, seed)
                n = np.searchsorted(edges, drawn, side="right") - 1
                slot = drawn - edges[n]
                block = np.zeros(len(slot), dtype=np.int64)
                for s in np.unique(n):
                    held = blocks[names[s]]
                    for turn in np.unique(slot[n == s] // held):
                        at = np.flatnonzero((n == s) & (slot // held == turn))
                        block[at] = permuted(slot[at] % held, held, seed * 1_000_003 + (int(s) + 1) * 1009 + int(turn))
                source = pa.array([names[s] for s in n], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(place // size), source, pa.array(slot), pa.array(block)], names=["shard", "source", "slot", "block"])

        parts = max(1, -(-total // 500_000), min(total // 4096, self.spark.sparkContext.defaultParallelism))
        return self.spark.range(0, total, 1, parts).mapInArrow(run, "shard bigint, source string, slot bigint, block bigint")

    def _pieces(self) -> DataFrame:
        """``doc_id``, ``source``, ``tokens``, ``block``, ``start``, ``held``: the tokens that each document has in each block."""
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")
        sizes = self.sizes.withColumn("bucket", bucket)
        levels = sizes.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))
        ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
        base = levels.select("source", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
        before = Window.partitionBy("source", "bucket").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
        laid = sizes.withColumn("at", F.coalesce(F.sum("tokens").over(before), F.lit(0))).join(base, ["source", "bucket"])
        laid = laid.withColumn("at", F.col("at") + F.col("base"))
        size = self.block_tokens
        block = F.explode(F.expr(f"sequence(at div {size}, (at + greatest(tokens, 1) - 1) div {size})"))
        parts = laid.select("doc_id", "source", "tokens", "at", block.alias("block"))
        start = F.greatest(F.col("at"), F.col("block") * size)
        end = F.least(F.col("at") + F.col("tokens"), (F.col("block") + 1) * size)
        return parts.select("doc_id", "source", "tokens", "block", (start - F.col("at")).alias("start"), (end - start).alias("held"))

    def mixed(self) -> DataFrame:
        """The mix itself: ``shard``, ``source``, ``slot``, ``block`` and, per document in the block, ``doc_id``, ``start`` and ``held`` (tokens)."""
        pieces = self._pieces().where("held > 0").select("source", "block", "doc_id", "start", "held")
        return self.slots().join(pieces.hint("merge"), ["source", "block"]).select("shard", "source", "slot", "block", "doc_id", "start", "held")

    def usage(self) -> DataFrame:
        """``doc_id``, ``source``, ``tokens``, ``times_used``, ``tokens_used``: every document with a target.

        ``times_used`` is the highest use of any of its blocks, ``tokens_used`` counts only what the mix holds of it.
        """
        used = self.slots().groupBy("source", "block").agg(F.count("*").alias("uses"))
        joined = self._pieces().join(used.hint("merge"), ["source", "block"], "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
        return joined.groupBy("doc_id", "source").agg(F.first("tokens").alias("tokens"), F.max("uses").cast("bigint").alias("times_used"), F.sum(F.col("held") * F.col("uses")).cast("bigint").alias("tokens_used"))

    def shares(self) -> DataFrame:
        """Per target source: its target, its actual share of the mix and of the plan, its most used document and whether the target was met."""
        per = self.usage().groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"), F.sum("tokens_used").alias("tokens_used"), F.max("times_used").alias("most_used"))
        rows = [(s, *self.goal[s]) for s in self.names]
        goal = self.spark.createDataFrame(rows, "source string, target_share double, max_repeats int")
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
        out = goal.join(per, "source", "left").select("source", "target_share", "max_repeats", *map(zero, ("docs", "tokens", "tokens_used", "most_used")))
        total = F.sum("tokens_used").over(Window.partitionBy())  # one row per source
        plan = F.col("tokens_used") / F.lit(float(max(self.total, 1)))
        actual = F.coalesce(F.col("tokens_used") / F.nullif(total, F.lit(0)), F.lit(0.0))
        return out.select("*", F.round(actual, 6).alias("actual_share"), F.round(plan, 6).alias("share_of_plan"), (plan >= F.col("target_share") * 0.99).alias("target_met"))
