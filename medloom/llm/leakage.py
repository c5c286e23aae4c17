"""Test passages inside a training corpus (problem 7): a distributed positional inverted index.

The corpus is cut into segments; each stores, sorted by term, the postings
(document, word position) of every term that the test items use. Document
frequencies are summed over all segments. A query starts, for every window of
``min_words`` words of an item, from the list of the term that is rarest in the
whole corpus, shifts it by the term's place in the item, intersects it with the
lists of the next rarest terms at their places, and checks the survivors word by
word. A segment holds all postings of its documents, so the search itself moves
no data; only frequencies and results are shuffled.

The corpus is tokenised and indexed once, for the words of all items. The items are a
stated query set: they are searched in blocks of at most ``block_items``, each of which is
sent to the tasks and reads the index, not the corpus.

For proximity matches a window may lack some words, so it starts from as many of its
rarest terms as that, and one more, and asks for one further of them nearby: whichever
words are missing, one start is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medloom.llm.arrays import chunks, words
from medloom.runtime import materialise

CHUNK = 1_000_000
SEGMENT = "docs binary, terms binary, lengths binary, frequencies binary, doc binary, pos binary"
RESULT = "doc_id bigint, item_id bigint, kind string, words int, matched int, doc_word int, item_word int"


def _pieces(text: str) -> Iterator[str]:
    """A long text in pieces cut at white space."""
    start = 0
    while len(text) - start > CHUNK:
        cut = max(text.rfind(" ", start, start + CHUNK), text.rfind("\n", start, start + CHUNK))
        cut = start + CHUNK if cut <= start else cut
        yield text[start:cut]
        start = cut
    yield text[start:]


def build_index(docs: DataFrame, id_col: str, text_col: str, vocabulary: np.ndarray) -> DataFrame:
    """Index segments over the sorted word hashes ``vocabulary``; one row per segment."""

    def segment(ids: list[int], texts: list[str]) -> list[bytes]:
        docs_, terms, places = [], [], []
        parts = [(k, piece) for k, t in enumerate(texts) for piece in (_pieces(t) if len(t) > CHUNK else (t,))]
        done = np.zeros(len(texts), dtype=np.int64)
        for a, b in chunks([p for _, p in parts], CHUNK):
            hashes, starts = words([p for _, p in parts[a:b]])
            at = np.searchsorted(vocabulary, hashes)
            at[at == len(vocabulary)] = 0
            hit = np.flatnonzero(vocabulary[at] == hashes)
            piece = np.searchsorted(starts, hit, side="right") - 1
            doc = np.array([k for k, _ in parts[a:b]], dtype=np.int64)
            offset = np.zeros(b - a, dtype=np.int64)
            for k in range(b - a):
                offset[k] = done[doc[k]]
                done[doc[k]] += starts[k + 1] - starts[k]
            docs_.append(doc[piece])
            terms.append(at[hit])
            places.append(hit - starts[piece] + offset[piece])
        term, doc, pos = (np.concatenate(x).astype(np.int32) for x in (terms, docs_, places))
        order = np.argsort(term, kind="stable")  # documents and positions already ascend
        term, doc, pos = term[order], doc[order], pos[order]
        unique, first, lengths = np.unique(term, return_index=True, return_counts=True)
        new_doc = np.ones(len(term), dtype=np.int64)
        new_doc[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
        frequencies = np.add.reduceat(new_doc, first) if len(first) else new_doc
        return [np.asarray(ids, dtype=np.int64).tobytes(), *(x.astype(np.int32).tobytes() for x in (unique, lengths, frequencies, doc, pos))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks(texts, CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in segment(ids[a:b], texts[a:b])], names=names)

    names = ["docs", "terms", "lengths", "frequencies", "doc", "pos"]
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.where("id IS NOT NULL AND length(text) > 0").mapInArrow(run, SEGMENT)


def document_frequencies(index: DataFrame, size: int) -> np.ndarray:
    """In how many documents of the whole corpus each vocabulary term occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for terms, counts in zip(*(c.to_pylist() for c in batch.columns)):
                total[np.frombuffer(terms, np.int32)] += np.frombuffer(counts, np.int32)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    rows = index.select("terms", "frequencies").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(size, dtype=np.int64)
    for term, n in rows.collect():  # one row per vocabulary term at most
        out[term] = n
    return out


class Probes:
    """For every window of an item: its rarest terms, one more than may be ``missing``, with the next rarest ones, as flat arrays."""

    def __init__(self, items: list[np.ndarray], frequency: np.ndarray, min_words: int, missing: int = 0) -> None:
        rows: dict[tuple[int, int], set[int]] = {}
        starts, pool = missing + 1, missing + (2 if missing else 3)
        for k, terms in enumerate(items):
            for start in range(len(terms) - min_words + 1):
                window = terms[start : start + min_words]
                order = np.argsort(frequency[window], kind="stable")
                # A term that the window repeats says nothing new.
                fresh = [int(o) for n, o in enumerate(order) if window[o] not in window[order[:n]]][:pool]
                for first in fresh[:starts]:
                    rows.setdefault((k, start + first), set()).update(start + o for o in fresh if o != first)
        self.item = np.array([k for k, _ in rows], dtype=np.int64)
        self.place = np.array([p for _, p in rows], dtype=np.int64)
        most = max([len(s) for s in rows.values()], default=0)
        self.next = np.array([sorted(s) + [-1] * (most - len(s)) for s in rows.values()], dtype=np.int64).reshape(len(rows), most)


def _search(segment: dict[str, np.ndarray], items: list[np.ndarray], probes: Probes, min_words: int, slack: int, share: float) -> dict:
    """The best match of each document of a segment with each item: {(document, item): (words, matched, doc word, item word)}."""
    found: dict[tuple[int, int], tuple] = {}
    if not len(probes.item) or not len(segment["terms"]):
        return found
    span = int(segment["pos"].max()) + 1 + 2 * slack + 1
    n_docs = len(segment["docs"])
    term_of = np.repeat(segment["terms"].astype(np.int64), segment["lengths"])
    keys = (term_of * n_docs + segment["doc"]) * span + segment["pos"] + slack  # ascending
    begin = np.concatenate([[0], np.cumsum(segment["lengths"])]).astype(np.int64)

    def near(term: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
        inside = (pos >= -slack) & (pos < span - slack)
        base = (term * n_docs + doc) * span + slack
        at = np.searchsorted(keys, base + np.maximum(pos, 0) - slack if slack else base + pos)
        at[at == len(keys)] = len(keys) - 1
        return inside & (keys[at] >= base + pos - slack) & (keys[at] <= base + pos + slack)

    flat = np.concatenate(items).astype(np.int64)
    item_start = np.concatenate([[0], np.cumsum([len(x) for x in items])]).astype(np.int64)
    term = flat[item_start[probes.item] + probes.place]
    slot = np.searchsorted(segment["terms"], term)
    slot[slot == len(segment["terms"])] = 0
    length = np.where(segment["terms"][slot] == term, segment["lengths"][slot], 0).astype(np.int64)
    probe = np.repeat(np.arange(len(term)), length)
    posting = begin[slot[probe]] + np.arange(len(probe)) - np.repeat(np.cumsum(length) - length, length)
    doc, offset, item = segment["doc"][posting].astype(np.int64), segment["pos"][posting] - probes.place[probe], probes.item[probe]
    alive = np.zeros(len(probe), dtype=bool)
    for column in probes.next.T:
        place = column[probe]
        rest = np.flatnonzero((place >= 0) & ~alive)
        alive[rest] = near(flat[item_start[item[rest]] + place[rest]], doc[rest], offset[rest] + place[rest])
    alive |= (probes.next < 0).all(axis=1)[probe]  # windows that repeat a single word
    survivors = np.unique(np.stack([doc, item, offset], axis=1)[alive], axis=0)
    for d, i, o in survivors.tolist():
        terms = items[i].astype(np.int64)
        places = np.arange(len(terms))
        docs = np.full(len(terms), d, dtype=np.int64)
        loose = near(terms, docs, o + places)
        if slack:
            at = np.searchsorted(keys, (terms * n_docs + d) * span + slack + np.maximum(o + places, 0))
            at[at == len(keys)] = 0
            exact = keys[at] == (terms * n_docs + d) * span + slack + o + places
        else:
            exact = loose
        breaks = np.flatnonzero(np.concatenate([[True], ~exact, [True]]))
        runs = np.diff(breaks) - 1
        best = int(runs.argmax())
        sums = np.concatenate([[0], np.cumsum(loose)])
        dense = int((sums[min_words:] - sums[:-min_words]).max()) if len(terms) >= min_words else 0
        if runs[best] >= min_words or (slack and dense >= share * min_words):
            first = int(breaks[best])
            row = (int(runs[best]), int(loose.sum()), int(o + first), first)
            found[d, i] = max(found.get((d, i), row), row)
    return found


def leaked(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    min_words: int = 20,
    slack: int = 0,
    share: float = 0.8,
    block_items: int = 5_000,
) -> DataFrame:
    """Documents that hold test passages: one row per document and item, with the longest match.

    ``kind`` 'exact': at least ``min_words`` consecutive words of the item. With ``slack`` > 0 also 'near': ``share`` of
    some ``min_words`` words of the item occur within ``slack`` words of their places, as counted from one of the rarest of them.
    ``words`` is the longest exact run, ``matched`` the item's words found at about their places, ``doc_word`` and
    ``item_word`` where that run starts. Null ids, null and empty texts and items of fewer than ``min_words`` words give
    no row; repeated rows count once; empty tables give an empty result. Other columns are never read.
    """
    texts = items.select(F.col(item_id).cast("bigint").alias("id"), F.col(item_text).cast("string").alias("text")).where("id IS NOT NULL AND length(text) > 0").dropDuplicates()
    rows = sorted(texts.collect())  # the query set
    hashes, starts = words([r.text for r in rows])
    vocabulary, flat = np.unique(hashes, return_inverse=True)
    if not len(vocabulary):
        return docs.sparkSession.createDataFrame([], RESULT)
    index = materialise(build_index(docs, doc_id, doc_text, vocabulary), "postings")
    frequency = document_frequencies(index, len(vocabulary))
    missing = int((1 - share) * min_words + 1e-9) if slack else 0
    parts = []
    for first in range(0, len(rows), block_items):
        block = range(first, min(first + block_items, len(rows)))
        ids = [rows[n].id for n in block]
        item_terms = [flat[starts[n] : starts[n + 1]] for n in block]
        probes = Probes(item_terms, frequency, min_words, missing)

        def run(batches: Iterator[pa.RecordBatch], ids=ids, item_terms=item_terms, probes=probes) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    raw = {n: batch.column(n)[row].as_py() for n in batch.schema.names}
                    segment = {n: np.frombuffer(v, np.int64 if n == "docs" else np.int32) for n, v in raw.items()}
                    best = _search(segment, item_terms, probes, min_words, slack, share)
                    out = [(int(segment["docs"][d]), ids[i], "exact" if m[0] >= min_words else "near", *m) for (d, i), m in best.items()]
                    if out:
                        types = [pa.int64(), pa.int64(), pa.string(), *[pa.int32()] * 4]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["doc_id", "item_id", "kind", "words", "matched", "doc_word", "item_word"])

        parts.append(index.select("docs", "terms", "lengths", "doc", "pos").mapInArrow(run, RESULT))
    best = F.max_by(F.struct("kind", "words", "matched", "doc_word", "item_word"), F.struct("words", "matched", -F.col("doc_word"), -F.col("item_word")))
    return reduce(DataFrame.union, parts).groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")
