import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from medloom.operators.shred import Repeated, Striper, assemble, elements, leaf_rows, links, parse, relation, shred, unwrap

import numpy as np

C = Repeated("c", ("cs", "c_s"), (("v",),))
B = Repeated("b", ("bs",), (("w",),), (C,))
A = Repeated("a", (), (("x",),), (B,))
NESTED = Repeated("a", ("as",), (), (Repeated("b", ("bs",)),))


def pick(parent, keys):
    return next((parent[k] for k in keys if parent.get(k) is not None), None)


def brute(node, value, path=()):
    """The links of a document by plain recursion."""
    out = []
    for k, item in enumerate(elements(value) or []):
        item = unwrap(item) if isinstance(item, str) else item
        if isinstance(item, dict):
            here = (*path, k)
            out.append((node.rel, ".".join(map(str, here))))
            for child in node.children:
                out += brute(child, pick(item, child.keys), here)
    return out


def found(spark, texts, root=A):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, t string")
    return sorted((r.parent_id, r.rel, r.child_path) for r in links(shred(df, "id", "t", (root,))).collect())


CASES = [
    '[{"x":1,"bs":[{"w":"p","cs":[{"v":1},null,3,{"v":2}]},7,[],{"w":null}]},null,{"x":2}]',
    '{"x":1,"bs":{"cs":{"v":5}}}',
    '"[{\\"x\\": 1}]"',
    '[{"bs":"[{\\"w\\":1}]"}]',
    '["{\\"x\\":1}", "viên"]',
    "[]", "{}", "null", "5", '""', "", "[{", "{bad}", "[NaN]", '[{"x":NaN}]', None,
]


def test_cases_equal_plain_recursion(spark):
    want = sorted((str(i), *link) for i, t in enumerate(CASES) for link in brute(A, unwrap(parse(t))))
    assert found(spark, CASES) == want
    assert ("0", "c", "0.0.3") in want and ("1", "c", "0.0.0") in want and ("2", "a", "0") in want and ("3", "b", "0.0") in want


leaf = st.one_of(st.none(), st.integers(-3, 3), st.text(max_size=3), st.booleans())
element = st.recursive(st.one_of(leaf, st.fixed_dictionaries({}, optional={"v": leaf, "w": leaf, "x": leaf})), lambda inner: st.dictionaries(st.sampled_from(["bs", "cs", "c_s", "v"]), st.one_of(inner, st.lists(inner, max_size=3)), max_size=3), max_leaves=8)


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.one_of(element, st.lists(element, max_size=4)), min_size=1, max_size=4))
def test_levels_rebuild_any_document(documents):
    striper = Striper((A,))
    texts = [json.dumps(d) for d in documents]
    for t in texts:
        striper.add(t)
    striper.top.finish()
    got, node = [], striper.top
    for spec, depth in ((A, 1), (B, 2), (C, 3)):
        node = node.below[spec]
        links_of = []
        for stripe in (node, *node.leaves.values()):  # every leaf's own levels tell the same rows
            rows, doc, positions = assemble(np.array(stripe.rep, dtype=np.int32), np.array(stripe.define, dtype=np.int32), depth)
            links_of.append([(int(doc[k]), spec.rel, ".".join(str(int(p[k])) for p in positions)) for k in range(len(rows))])
        assert all(x == links_of[0] for x in links_of)
        got += links_of[0]
    assert sorted(got) == sorted((i, *link) for i, t in enumerate(texts) for link in brute(A, unwrap(parse(t))))


def test_object_root_and_aliases(spark):
    root = Repeated("a", ("as", "as_"), (), (Repeated("b", ("bs",)),))
    assert found(spark, ['{"as":null,"as_":[{"bs":[{}]}]}', '{"as":[{}]}', "[]", '"{\\"as\\":[{}]}"'], root) == [("0", "a", "0"), ("0", "b", "0.0"), ("1", "a", "0"), ("3", "a", "0")]


def test_tables_nulls_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([("1", '[{"x":1,"bs":[{"w":"p"}]}]', "z"), ("1", '[{"x":1,"bs":[{"w":"p"}]}]', "z"), (None, "[{}]", "z")], "id string, t string, rel string")
    long = shred(df, "id", "t", (A,))
    assert links(long).count() == 2
    assert [tuple(r) for r in relation(long, B).collect()] == [("1", "0", "0.0", "p", "{}")]
    assert [tuple(r) for r in relation(long, A).collect()] == [("1", None, "0", "1", "{}")]
    assert shred(df.limit(0), "id", "t", (A,)).count() == 0


def test_long_lists(spark):
    text = json.dumps([{"bs": [{}] * 50}] * 400)
    assert len(found(spark, [text])) == 400 + 400 * 50


def test_every_leaf_is_kept(spark):
    text = json.dumps({"q": "GOOD", "stats": {"n": 2, "deep": {"z": None, "y": True}}, "none": [], "as": [{"bbox": [1, None, 2.5], "m": {"colors": ["red", "blue"]}, "other": [{"k": 1}, 5, {"k": 2}]}, {"bbox": []}], "a.b": "dot", "wrapped": json.dumps({"i": 1})})
    df = spark.createDataFrame([("1", text)], "id string, t string")
    got = {(r.rel, r.child_path, r.path, r.value) for r in leaf_rows(shred(df, "id", "t", (Repeated("a", ("as",)),), "doc")).collect()}
    assert got == {
        ("doc", "", "q", "GOOD"), ("doc", "", "stats.n", "2"), ("doc", "", "stats.deep.y", "true"), ("doc", "", "none[]", "[]"), ("doc", "", "a\\.b", "dot"), ("doc", "", "wrapped.i", "1"),
        ("a", "0", "bbox[]", "[1,null,2.5]"), ("a", "0", "m.colors[]", '["red","blue"]'), ("a", "1", "bbox[]", "[]"),
        ("a/other", "0.0", "k", "1"), ("a/other", "0.1", "", "5"), ("a/other", "0.2", "k", "2"),
    }


def test_deep_wrapped_and_long(spark):
    """No limit on how often text is wrapped in text, how deep lists nest or how long an integer is."""
    wrapped = json.dumps([{}])
    for _ in range(12):
        wrapped = json.dumps(wrapped)
    deep = '{"x":' * 30_000 + "1" + "}" * 30_000
    long = '[{"x":' + "9" * 6000 + "}]"
    assert found(spark, [wrapped[:], f"[{deep}]", long]) == [("0", "a", "0"), ("1", "a", "0"), ("2", "a", "0")]
    df = spark.createDataFrame([("1", long)], "id string, t string")
    assert leaf_rows(shred(df, "id", "t", (A,))).first().value == "9" * 6000


@pytest.mark.parametrize("name", ["p3_found", "p3_leaves", "p3_scans", "p3_scan_candidates", "p3_suggestions"])
def test_whole_tables(name, spark, data):
    from medloom.plans import nested

    df = nested.QUERIES[name](spark, data)
    assert df.count() == df.distinct().count() > 0
