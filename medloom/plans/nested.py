"""Queries of problem 3: the JSON texts of scans, sessions and detections as flat tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medloom.operators.shred import Repeated, leaf_rows, links, relation, shred
from medloom.runtime import table

INGREDIENT = Repeated("scan_ingredient", ("hoatChat", "hoat_chat"), (("tenHoatChat", "ten_hoat_chat"), ("nongDo", "nong_do")))
CANDIDATE = Repeated("scan_candidate", ("candidates", "alternatives"), (("tenThuoc", "ten_thuoc"), ("score",)), (INGREDIENT,))
MEDICATION = Repeated(
    "scan_medication",
    ("medications", "medication_candidates"),
    (
        ("drug_name", "drugName", "drug_name_raw", "ocr_text"),
        ("confidence",),
        ("match_score", "matchScore"),
        ("mapping_status", "mappingStatus"),
    ),
    (CANDIDATE,),
)
REFERENCE = Repeated("expected_reference", ("references",), (("imageId", "image_id"), ("side",)))
EXPECTED = Repeated(
    "expected_medication",
    (),
    (("planId", "plan_id"), ("drugName", "name"), ("dosage",), ("expectedCount", "pillsPerDose")),
    (REFERENCE,),
)
EVIDENCE = Repeated("suggestion_evidence", ("evidence",), (("kind",), ("adj",)))
SUGGESTION = Repeated("suggestion", (), (("planId", "plan_id"), ("drugName", "name"), ("score",)), (EVIDENCE,))
SCAN = Repeated("scan", (), (("quality_state",), ("roi_mode",)), (MEDICATION,))
SOURCES = (
    ("scans", "result", MEDICATION, "scan"),
    ("dose_verification_sessions", "expected_medications", EXPECTED, "session"),
    ("dose_verification_detections", "suggestions", SUGGESTION, "detection"),
)
#: The tables that ``p3_found`` is about; lists that occur beside them have tables of their own.
FOUND = ("scan_medication", "scan_candidate", "scan_ingredient", "expected_medication", "expected_reference", "suggestion", "suggestion_evidence")


def _shredded(spark: SparkSession, sf_dir: str, source: int, values: bool = True) -> DataFrame:
    name, column, root, document = SOURCES[source]
    return shred(table(spark, sf_dir, name), "id", column, (root,), document, values)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [_shredded(spark, sf_dir, k, values=False) for k in range(len(SOURCES))]
    return links(reduce(DataFrame.union, parts).where(F.col("rel").isin(*FOUND)))


def p3_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaf value of the three columns with the element that holds it."""
    return leaf_rows(reduce(DataFrame.union, [_shredded(spark, sf_dir, k) for k in range(len(SOURCES))]))


def _relation(source: int, node: Repeated):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return relation(_shredded(spark, sf_dir, source), node).drop("rest")  # all leaves: p3_leaves

    return query


QUERIES = {
    "p3_found": p3_found,
    "p3_leaves": p3_leaves,
    "p3_scans": _relation(0, SCAN),
    "p3_scan_medications": _relation(0, MEDICATION),
    "p3_scan_candidates": _relation(0, CANDIDATE),
    "p3_scan_ingredients": _relation(0, INGREDIENT),
    "p3_expected_medications": _relation(1, EXPECTED),
    "p3_expected_references": _relation(1, REFERENCE),
    "p3_suggestions": _relation(2, SUGGESTION),
    "p3_suggestion_evidence": _relation(2, EVIDENCE),
}


def _content(x: str) -> str:
    """JSON kept as text counts as its content."""
    return f"CASE WHEN json_type({x}) = 'VARCHAR' AND json_valid({x} ->> '$') THEN ({x} ->> '$')::JSON ELSE {x} END"


def _level(name: str, source: str, content: str, path: str) -> str:
    """The objects of a list, or the bare object, with their positions; ``content`` is the JSON of the list in ``source``."""
    return f"""{name}_l AS (SELECT id, path AS up, {content} AS v FROM {source}), {name}_c AS (SELECT id, up, {_content("v")} AS v FROM {name}_l),
{name}_e AS (SELECT id, up, unnest(CASE json_type(v) WHEN 'ARRAY' THEN from_json(v, '["JSON"]') WHEN 'OBJECT' THEN [v] ELSE [] END) AS e,
  unnest(range(CASE json_type(v) WHEN 'ARRAY' THEN json_array_length(v)::BIGINT WHEN 'OBJECT' THEN 1 ELSE 0 END)) AS n FROM {name}_c),
{name} AS (SELECT id, {path} AS path, {_content("e")} AS o FROM {name}_e WHERE json_type({_content("e")}) = 'OBJECT')"""


def _either(o: str, a: str, b: str) -> str:
    return f"CASE WHEN coalesce(json_type({o}, '$.{a}'), 'NULL') <> 'NULL' THEN json_extract({o}, '$.{a}') ELSE json_extract({o}, '$.{b}') END"


def _documents(name: str, tbl: str, column: str) -> str:
    return f"""{name}_d AS (SELECT DISTINCT id, {column}::JSON AS v FROM {tbl} WHERE id IS NOT NULL AND json_valid({column})), {name} AS (SELECT id, '' AS path, {_content("v")} AS o FROM {name}_d)"""


_DEEPER = "up || '.' || n"
SQL = {
    "p3_found": "WITH "
    + ",\n".join(
        (
            _documents("scan", "scans", "result"),
            _level("scan_medication", "scan", _either("o", "medications", "medication_candidates"), "n::VARCHAR"),
            _level("scan_candidate", "scan_medication", _either("o", "candidates", "alternatives"), _DEEPER),
            _level("scan_ingredient", "scan_candidate", _either("o", "hoatChat", "hoat_chat"), _DEEPER),
            _documents("session", "dose_verification_sessions", "expected_medications"),
            _level("expected_medication", "session", "o", "n::VARCHAR"),
            _level("expected_reference", "expected_medication", "json_extract(o, '$.references')", _DEEPER),
            _documents("detection", "dose_verification_detections", "suggestions"),
            _level("suggestion", "detection", "o", "n::VARCHAR"),
            _level("suggestion_evidence", "suggestion", "json_extract(o, '$.evidence')", _DEEPER),
        )
    )
    + "\n"
    + " UNION ".join(f"SELECT '{r}' AS rel, id AS parent_id, path AS child_path FROM {r}" for r in FOUND)
}


def _table_sql(found: str, node: Repeated, level: str) -> str:
    """The twin of ``relation``: the levels of ``p3_found``, and the leaves of one."""
    columns = ", ".join("coalesce(" + ", ".join(f"o ->> '$.{k}'" for k in keys) + f') AS "{keys[0]}"' for keys in node.leaves)
    parent = "CASE WHEN contains(path, '.') THEN regexp_extract(path, '^(.*)\\.\\d+$', 1) END"
    whole = " WHERE json_type(o) = 'OBJECT'" if node is SCAN else ""
    return found[: found.index("\nSELECT")] + f"\nSELECT DISTINCT id AS parent_id, {parent} AS parent_path, path AS child_path, {columns} FROM {level}{whole}"


for _query, _node in (
    ("p3_scans", SCAN), ("p3_scan_medications", MEDICATION), ("p3_scan_candidates", CANDIDATE), ("p3_scan_ingredients", INGREDIENT), ("p3_expected_medications", EXPECTED),
    ("p3_expected_references", REFERENCE), ("p3_suggestions", SUGGESTION), ("p3_suggestion_evidence", EVIDENCE),
):
    SQL[_query] = _table_sql(SQL["p3_found"], _node, _node.rel)
