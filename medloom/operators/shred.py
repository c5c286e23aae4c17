"""Columnar shredding of nested JSON into related flat tables (problem 3).

Each document is striped into one column per leaf path, whatever paths occur, every
entry with a repetition level (at which repeated ancestor a new element starts) and
a definition level (how much of the path exists). The flat table of a repeated
ancestor is then rebuilt from the level sequences alone: positions are running
counts of element starts, restarted wherever a shallower ancestor repeats, and each
leaf finds the rows of its values by its own levels.

Definition levels of a path whose node lies below D repeated ancestors: ``2k-1`` when
an element slot exists at depth k, ``2k`` when that element is an object, ``2D+j``
when the first j steps of the path exist; a leaf of m steps has its value at
``2D+m``. A list of scalars is a leaf that repeats at level D+1: its last step is
``[]``, an empty list lies at ``2D+m-1``, a null element at ``2D+m``, a value one above.

Lists of objects are repeated ancestors. Those that a ``Repeated`` names go by its
name, whichever of its keys they stand under; any other is named by its path.

Striping happens batch by batch in one map-only pass, so a document is never
moved and a hot parent key costs nothing; the single shuffle is the removal of
repeated rows, which pre-aggregates on the map side.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medloom.runtime import materialise

_MARKS = re.compile(r"[\\.\[]")
SCHEMA = "rel string, parent_id string, child_path string, leaves map<string,string>"


@dataclass(frozen=True)
class Repeated:
    """A repeated ancestor: a list of objects under one of ``keys`` of its parent (no keys: the document itself).

    ``leaves``: the columns that ``relation`` gives its table, each the first filled of some leaf paths.
    """

    rel: str
    keys: tuple[str, ...] = ()
    leaves: tuple[tuple[str, ...], ...] = ()
    children: tuple[Repeated, ...] = ()


class Literal(str):
    """A number too long to be read as one."""


def _reject(token: str) -> None:
    raise ValueError(token)


def _deep(text: str):
    """Parses without a limit on nesting: the scanner in Python, whose frames are not on the C stack."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 8 * len(text) + 10_000))
    decoder = json.JSONDecoder(parse_constant=_reject, parse_int=_integer)
    decoder.parse_object, decoder.parse_array = json.decoder.JSONObject, json.decoder.JSONArray
    decoder.scan_once = json.scanner.py_make_scanner(decoder)
    return decoder.decode(text)


def _integer(digits: str):
    return int(digits) if len(digits) < 4000 else Literal(digits)


def parse(text: str | None):
    """The content of a JSON text; None where it is absent or not valid JSON (NaN and Infinity are not)."""
    if text is None:
        return None
    try:
        return json.loads(text, parse_constant=_reject)
    except json.JSONDecodeError:
        return None
    except RecursionError:
        pass
    except ValueError:  # a constant, or an integer beyond the limit of int()
        try:
            return json.loads(text, parse_constant=_reject, parse_int=_integer)
        except RecursionError:
            pass
        except ValueError:
            return None
    try:
        return _deep(text)
    except ValueError:
        return None


def unwrap(value):
    """JSON kept as text inside JSON counts as its content, however often it is wrapped."""
    while isinstance(value, str) and not isinstance(value, Literal):
        value = parse(value)
    return value


def elements(value) -> list | None:
    """The list behind ``value``; a bare object stands for a list of one."""
    value = unwrap(value)
    if isinstance(value, dict):
        return [value]
    return value if isinstance(value, list) else None


def leaf_text(value) -> str | None:
    """A leaf as text: strings as they are, other values as JSON."""
    if value is None or isinstance(value, str):
        return value
    return json_text(value)


def json_text(value) -> str:
    if isinstance(value, Literal):
        return str(value)
    try:
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    except RecursionError:
        return "".join(json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).iterencode(value))


def _nested(value):
    """``value``, or its content where it is a text that holds a JSON object or list."""
    if isinstance(value, str) and value.lstrip()[:1] in ("{", "[", '"') and isinstance(inner := unwrap(value), (dict, list)):
        return inner
    return value


def _name(path: tuple[str, ...]) -> str:
    """A path as one text; marks within its steps are escaped, so that different paths have different names."""
    return ".".join(_MARKS.sub(lambda m: "\\" + m[0], step) for step in path)


class Stripe:
    """The column of one leaf path. Entries up to ``seen`` of its node's own are written; the rest are blanks still to come."""

    def __init__(self) -> None:
        self.values: list = []
        self.rep: list[int] = []
        self.define: list[int] = []
        self.seen = 0

    def fill(self, node: Level, upto: int) -> None:
        """Blanks for the node's entries before ``upto``: as much of the path exists as of the node."""
        if self.seen < upto:
            self.rep += node.rep[self.seen : upto]
            self.define += node.define[self.seen : upto]
            self.values += [None] * (upto - self.seen)
            self.seen = upto

    def put(self, value, rep: int, define: int) -> None:
        self.values.append(value)
        self.rep.append(rep)
        self.define.append(define)


class Level(Stripe):
    """A node: the levels of its elements, the stripes of its leaves, the nodes below it."""

    def __init__(self, rel: str, depth: int, spec: Repeated | None = None) -> None:
        super().__init__()
        self.rel, self.depth = rel, depth
        self.leaves: dict[tuple[str, ...], Stripe] = {}
        self.below: dict[object, Level] = {}
        self.named = spec.children if spec else ()
        for child in self.named:
            self.below[child] = Level(child.rel, depth + 1, child)

    def leaf(self, path: tuple[str, ...]) -> Stripe:
        if (stripe := self.leaves.get(path)) is None:
            stripe = self.leaves[path] = Stripe()
        stripe.fill(self, len(self.rep) - 1)
        stripe.seen += 1
        return stripe

    def finish(self) -> None:
        for stripe in self.leaves.values():
            stripe.fill(self, len(self.rep))
        for level in self.below.values():
            level.fill(self, len(self.rep))
            level.finish()


class Striper:
    """Writes documents into the stripes of all leaf paths that occur below ``roots``."""

    def __init__(self, roots: tuple[Repeated, ...], document: str = "document") -> None:
        self.top = Level(document, 0, Repeated(document, (), (), roots))

    def add(self, text: str | None) -> None:
        content = unwrap(parse(text))
        top = self.top
        if any(not child.keys for child in top.named):  # the document is the list
            top.put(None, 0, 0)
            for child in top.named:
                self._list(top, top.below[child], content, 0)
        elif isinstance(content, dict):
            self._object(top, content, 0)
        else:
            top.put(None, 0, -1)

    def _list(self, parent: Level, node: Level, value, rep: int, whole: bool = False) -> None:
        """The elements of ``value`` below the last entry of ``parent``; ``whole``: elements that are no objects are rows too."""
        items = elements(value)
        if not items:
            return  # a blank, written when the next entry or the end comes
        node.fill(parent, len(parent.rep) - 1)
        for item in items:
            item = _nested(item)
            if isinstance(item, dict):
                self._object(node, item, rep)
            elif whole:
                self._object(node, {"": item}, rep)
            else:
                node.put(None, rep, 2 * node.depth - 1)
            rep = node.depth
        node.seen = len(parent.rep)

    def _object(self, node: Level, item: dict, rep: int) -> None:
        node.put(None, rep, 2 * node.depth)
        taken = set()
        for child in node.named:
            for key in child.keys:
                if item.get(key) is not None:
                    taken.add(key)
                    self._list(node, node.below[child], item[key], rep)
                    break
        base = 2 * node.depth
        todo = [((key,), value) for key, value in item.items() if key not in taken]
        while todo:
            path, value = todo.pop()
            value = _nested(value)
            if isinstance(value, dict) and value:
                todo += [((*path, key), inner) for key, inner in value.items()]
            elif isinstance(value, list) and any(isinstance(_nested(x), dict) for x in value):
                if path not in node.below:
                    node.below[path] = Level(f"{node.rel}/{_name(path)}", node.depth + 1)
                self._list(node, node.below[path], value, rep, whole=True)
            elif isinstance(value, list):
                steps = (*path, "[]")
                stripe, at = node.leaf(steps), rep
                for x in value:
                    stripe.put(json_text(x), at, base + len(steps) + (x is not None))
                    at = node.depth + 1
                if not value:
                    stripe.put(None, rep, base + len(steps) - 1)
            elif value is not None:
                node.leaf(path).put(leaf_text(value), rep, base + len(path))


def assemble(rep: np.ndarray, define: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """From the levels of a stripe whose node lies at ``depth``: entries that start an object, their documents, their positions."""
    entry = np.arange(len(rep))
    document = np.cumsum(rep == 0) - 1
    positions = []
    for k in range(1, depth + 1):
        starts = (rep <= k) & (define >= 2 * k - 1)
        count = np.cumsum(starts)
        parent = np.maximum.accumulate(np.where(rep < k, entry, 0))
        positions.append(count - 1 - (count - starts)[parent])
    # An entry stands for an object of this node only where the node itself starts.
    rows = np.flatnonzero((rep <= depth) & (define >= 2 * depth))
    return rows, document[rows], [p[rows] for p in positions]


def _leaf_values(node: Level, n: int) -> list[list[tuple[str, str]]]:
    """Per object of a node its leaf values; each stripe tells by its own levels whose they are."""
    out: list[list[tuple[str, str]]] = [[] for _ in range(n)]
    for path, stripe in node.leaves.items():
        rep, define = np.asarray(stripe.rep, dtype=np.int32), np.asarray(stripe.define, dtype=np.int32)
        owner = np.cumsum((rep <= node.depth) & (define >= 2 * node.depth)) - 1
        full = 2 * node.depth + len(path)
        if path[-1] != "[]":
            name = _name(path)
            for k in np.flatnonzero(define == full).tolist():
                out[owner[k]].append((name, stripe.values[k]))
            continue
        name = _name(path[:-1]) + "[]"
        lists: dict[int, list[str]] = {int(owner[k]): [] for k in np.flatnonzero(define >= full - 1)}
        for k in np.flatnonzero(define >= full).tolist():
            lists[int(owner[k])].append(stripe.values[k])
        for row, parts in lists.items():
            out[row].append((name, f"[{','.join(parts)}]"))
    return out


def _tables(node: Level, ids: np.ndarray, values: bool) -> Iterator[pa.RecordBatch]:
    rows, document, positions = assemble(np.asarray(node.rep, dtype=np.int32), np.asarray(node.define, dtype=np.int32), node.depth)
    if len(rows):
        path = pa.array([""] * len(rows), pa.string())
        for k, p in enumerate(positions):
            text = pa.array(p).cast(pa.string())
            path = pa.compute.binary_join_element_wise(path, text, ".") if k else text
        leaves = _leaf_values(node, len(rows)) if values else [None] * len(rows)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([node.rel] * len(rows), pa.string()),
                pa.array(ids[document], pa.string()),
                path,
                pa.array(leaves, pa.map_(pa.string(), pa.string())),
            ],
            names=["rel", "parent_id", "child_path", "leaves"],
        )
    for child in node.below.values():
        yield from _tables(child, ids, values)


def shred(df: DataFrame, id_col: str, json_col: str, roots: tuple[Repeated, ...], document: str = "document", values: bool = True) -> DataFrame:
    """All flat tables of ``json_col`` in one pass: a row per document that is an object (``rel`` = ``document``) and per object in a list.

    Columns: ``rel`` (the table), ``parent_id``, ``child_path`` (zero-based positions, outer list first, joined by
    '.'; empty for the document), ``leaves`` (every leaf value by its path; a list of scalars as JSON under its path and
    '[]'; null unless ``values``). Null ids, absent texts and invalid JSON give no row; elements that are not objects count as
    positions only, except in lists that ``roots`` does not name, where they are rows with the leaf ''; empty lists of
    objects give no row; null leaves are absent. Repeated
    input rows give repeated output rows (see ``links``). Other columns of ``df`` are never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                striper = Striper(roots, document)
                for text in part.column(1).to_pylist():
                    striper.add(text)
                striper.top.finish()
                ids = np.asarray(part.column(0).to_pylist(), dtype=object)
                if any(not root.keys for root in roots):
                    for node in striper.top.below.values():
                        yield from _tables(node, ids, values)
                else:
                    yield from _tables(striper.top, ids, values)

    source = df.select(F.col(id_col).cast("string").alias("id"), F.col(json_col).cast("string").alias("text"))
    return source.where("id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, T._parse_datatype_string(SCHEMA))


def links(shredded: DataFrame) -> DataFrame:
    """The parent-child links of elements, each once: repeated input rows collapse here."""
    return shredded.where("child_path <> ''").select("rel", "parent_id", "child_path").dropDuplicates()


def leaf_rows(shredded: DataFrame) -> DataFrame:
    """Every leaf value of every table, each once: ``rel``, ``parent_id``, ``child_path``, ``path``, ``value``."""
    return shredded.select("rel", "parent_id", "child_path", F.explode("leaves").alias("path", "value")).dropDuplicates()


def relation(shredded: DataFrame, node: Repeated) -> DataFrame:
    """One flat table with leaf values as columns, all further ones in ``rest`` (JSON), and the link to the parent element.

    ``parent_path`` is null for children of the document itself. A column is the first filled of its paths and has the
    name of the first. Rows that repeat whole collapse.
    """
    leaves = F.col("leaves")
    columns = [F.coalesce(*[leaves[k] for k in keys]).alias(keys[0]) for keys in node.leaves]
    used = [k for keys in node.leaves for k in keys]
    rest = F.map_filter(leaves, lambda k, v: ~k.isin(*used)) if used else leaves
    parent = F.when(F.instr("child_path", ".") > 0, F.regexp_extract("child_path", r"^(.*)\.\d+$", 1))
    ordered = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(rest))))
    return shredded.where(F.col("rel") == node.rel).select("parent_id", parent.alias("parent_path"), "child_path", *columns, ordered.alias("rest")).dropDuplicates()


def flat_tables(shredded: DataFrame, nodes: tuple[Repeated, ...]) -> dict[str, DataFrame]:
    """All tables of ``nodes`` from one pass over the documents: the rows are written once and read per table."""
    held = materialise(shredded, "shredded")
    return {node.rel: relation(held, node) for node in nodes}
