"""The training-data operators against brute force, round trips and edge cases on small fixtures."""

import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from medloom.llm import registry


def folded_words(s):
    s = "".join(c for c in unicodedata.normalize("NFD", s.lower().replace("đ", "d")) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", s)


# --- arrays ---------------------------------------------------------------------------------------------------------


def test_words_are_the_plain_ones():
    from medloom.llm.arrays import words

    texts = ["Đau đầu, 5mg—x_y!", "", "   ", "é É a1", "一二 ab", "end", "x"]
    hashes, starts = words(texts)
    plain = [folded_words(t) for t in texts]
    assert np.diff(starts).tolist() == [len(p) for p in plain]
    flat = [w for p in plain for w in p]
    by_word = {}
    for w, h in zip(flat, hashes.tolist()):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_sliding_argmin():
    from medloom.llm.arrays import sliding_argmin

    rng = np.random.default_rng(0)
    v = rng.integers(0, 9, 200).astype(np.uint64)
    for width in (1, 2, 3, 7, 16, 50):
        got = sliding_argmin(v, width)
        for i in range(len(v) - width + 1):
            w = v[i : i + width]
            assert got[i] == i + max(np.flatnonzero(w == w.min()))


# --- problem 1 ------------------------------------------------------------------------------------------------------


def vectors(n=400, dim=74, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 8, dim))
    x = centres[rng.integers(0, len(centres), n)] + 0.25 * rng.normal(size=(n, dim))
    return [(f"i{k:04d}", [float(np.float32(a)) for a in v]) for k, v in enumerate(x)]


def brute_neighbours(rows, k, least):
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = np.round(x @ x.T, 12)
    out = set()
    for a in range(len(ids)):
        order = sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-s[a, b], ids[b]))[:k]
        out |= {(ids[a], ids[b]) for b in order if s[a, b] >= least}
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, embedding array<float>")


def test_neighbours_recall(spark):
    from medloom.llm.neighbours import most_similar

    rows = vectors()
    want = brute_neighbours(rows, 5, 0.7)
    got = {(r.id, r.neighbour) for r in most_similar(frame(spark, rows), k=5, min_cosine=0.7, block=64).collect()}
    assert got - want == set() or len(got - want) <= 0.02 * len(want)
    assert len(want & got) >= 0.95 * len(want)
    every = brute_neighbours(rows, 5, -1)
    loose = {(r.id, r.neighbour) for r in most_similar(frame(spark, rows), k=5).collect()}
    assert len(every & loose) >= 0.9 * len(every)


def test_neighbours_are_exact_where_the_gap_takes_every_cell(spark):
    from medloom.llm.neighbours import most_similar

    rows = vectors()
    for least in (-1, 0.7):
        got = {(r.id, r.neighbour) for r in most_similar(frame(spark, rows), k=5, min_cosine=least, gap=4.0, block=64).collect()}
        assert got == brute_neighbours(rows, 5, least)


def test_neighbours_copies_and_unusable(spark):
    from medloom.llm.neighbours import most_similar

    base = vectors(40)
    one = base[0][1]
    copies = [(f"c{k:03d}", [v * 2.0 ** (k % 3) for v in one]) for k in range(60)]
    bad = [("n0", None), ("n1", []), ("n2", [1.0] * 10), ("n3", [0.0] * 74), ("n4", [float("nan")] + one[1:]), ("n5", [float("inf")] + one[1:]), (None, one), ("n6", [None] + one[1:])]
    rows = base + copies
    df = frame(spark, rows + rows[:5] + bad).withColumn("rep", F.lit("clash")).withColumn("cosine", F.lit(None).cast("string"))
    got = {(r.id, r.neighbour) for r in most_similar(df, k=5, min_cosine=0.9, block=16).collect()}
    assert got == brute_neighbours(rows, 5, 0.9)
    assert most_similar(df.limit(0), k=5).count() == 0
    assert most_similar(frame(spark, base[:1]), k=5).count() == 0


def test_heap_walk_takes_the_occupied_cells_within_the_gap_in_order():
    from medloom.llm.neighbours import walk

    rng = np.random.default_rng(1)
    a, b = np.sort(rng.random(12)), np.sort(rng.random(12))
    o1, o2 = rng.permutation(12).tolist(), rng.permutation(12).tolist()
    cells = rng.random((12, 12)) < 0.5
    for gap in (0.0, 0.4, 9.0):
        got = walk(a.tolist(), b.tolist(), o1, o2, [row.tobytes() for row in cells], gap)
        want = sorted((a[i] + b[j], o1[i], o2[j]) for i in range(12) for j in range(12) if cells[o1[i], o2[j]] and a[i] + b[j] <= a[0] + b[0] + gap)
        assert got == [(i, j) for _, i, j in want]


def test_heap_walk_takes_blocks_of_pairs(monkeypatch):
    from medloom.llm import neighbours

    pops, pop = [], neighbours.heappop
    monkeypatch.setattr(neighbours, "heappop", lambda heap: pops.append(1) or pop(heap))
    rng = np.random.default_rng(2)
    a, b = np.sort(rng.random(300)), np.sort(rng.random(280))
    order1, order2 = list(range(300)), list(range(280))
    for gap in (0.3, 9.0):
        got = neighbours.walk(a.tolist(), b.tolist(), order1, order2, [b"\1" * 280] * 300, gap)
        assert set(got) == set(zip(*np.nonzero(a[:, None] + b[None, :] <= a[0] + b[0] + gap))) and len(set(got)) == len(got)
    assert len(pops) < 200  # one by one: more than 84,000


# --- problem 2 ------------------------------------------------------------------------------------------------------

DRUG = "id long, name string, usage string, color string, source string, updated_at string, trust_rank int"


def drugs(spark, rows):
    return spark.createDataFrame(rows, DRUG).withColumn("updated_at", F.to_timestamp("updated_at"))


def trust(spark):
    return spark.createDataFrame([("good", 1), ("poor", 2)], "source string, trust_rank int")


def test_representatives(spark):
    from medloom.llm.survivors import representatives

    df = drugs(
        spark,
        [
            (1, "Đau-5mg", "dùng cho đau…", "red", "good", "2025-01-01", None),
            (2, "dau 5MG.", "dùng cho đau đầu", "red", " POOR ", "2024-01-01", None),
            (3, "DAU  5mg", "Đang cập nhật.", "red", "good", "2026-01-01", None),
            (4, "dau 5mg", "khác", None, "forum", "2026-01-01", None),
            (4, "dau 5mg", "khác", None, "forum", "2026-01-01", None),
            (5, "alone", "x", None, "good", None, None),
            (5, "alone", "x", None, "good", None, None),
            (6, None, "x", None, "good", None, None),
            (7, "none", "?", None, "good", None, None),
            (8, "None", " ", None, None, None, None),
        ],
    )
    got = {r.group_id: r.usage_id for r in representatives(df, trust(spark), ["usage"]).collect()}
    assert got == {1: 2, 7: None}
    assert representatives(df.limit(0), trust(spark), ["usage"]).count() == 0


def test_currency_places_untimed_rows(spark):
    """Red gives way to blue in many groups, so an untimed blue row is later than a timed red one."""
    from medloom.llm.survivors import representatives

    rows = []
    for g in range(6):
        rows += [(10 * g + 1, f"drug {g}", "old", "red", "good", "2024-01-01", None), (10 * g + 2, f"drug {g}", "new", "blue", "good", "2025-01-01", None)]
    rows += [(101, "query", "old", "red", "good", "2024-05-01", None), (102, "query", "new", "blue", "good", None, None)]
    df = drugs(spark, rows)
    last = {r.group_id: r.usage for r in representatives(df, trust(spark), ["usage"]).collect()}
    inferred = {r.group_id: r.usage for r in representatives(df, trust(spark), ["usage"], attributes=["color"], missing_time="infer").collect()}
    assert last[101] == "old" and inferred[101] == "new"
    assert {v for k, v in inferred.items() if k != 101} == {"new"}


def test_untimed_rows_are_ordered_among_themselves(spark):
    """Red gives way to blue and blue to green: of untimed rows the green one is latest, also without any timed row."""
    from medloom.llm.survivors import representatives

    rows = []
    for g in range(6):
        for n, (older, newer) in enumerate((("red", "blue"), ("blue", "green"))):
            base = 100 * g + 10 * n
            rows += [(base + 1, f"drug {g} {n}", "old", older, "good", "2024-01-01", None), (base + 2, f"drug {g} {n}", "new", newer, "good", "2025-01-01", None)]
    rows += [(901, "wholly", "r", "red", "good", None, None), (902, "wholly", "g", "green", "good", None, None), (903, "wholly", "b", "blue", "good", None, None)]
    rows += [(911, "partly", "r", "red", "good", "2024-05-01", None), (912, "partly", "b", "blue", "good", None, None), (913, "partly", "g", "green", "good", None, None)]
    got = {r.group_id: r.usage for r in representatives(drugs(spark, rows), trust(spark), ["usage"], attributes=["color"], missing_time="infer").collect()}
    assert got[901] == "g" and got[911] == "g"


def test_chains_of_untimed_rows_and_cycles(spark):
    """A chain over two attributes is followed through its untimed rows; the weakest edge of a cycle is broken."""
    from medloom.llm.survivors import currency, followed

    edges = spark.createDataFrame([("a", "p", "q", 9), ("a", "q", "r", 5), ("a", "r", "p", 3), ("b", "x", "y", 4)], "attr string, older string, newer string, n long")
    assert {tuple(r) for r in followed(edges).collect()} == {("a", "p", "q"), ("a", "q", "r"), ("a", "p", "r"), ("b", "x", "y")}

    schema = "key string, id long, time timestamp, color string, shape string"
    rows = spark.createDataFrame([], schema)
    seen = [(f"g{k}", 10 * k + n, "2024-01-0%d 00:00:00" % (n + 1), c, s) for k in range(4) for n, (c, s) in enumerate((("red", None), ("blue", None)))]
    seen += [(f"h{k}", 100 + 10 * k + n, "2024-01-0%d 00:00:00" % (n + 1), c, s) for k in range(4) for n, (c, s) in enumerate(((None, "oval"), (None, "round")))]
    # 901 is timed and red; 902 is blue, so after it; 903 is round, so after 902, which is oval; 904 follows nothing.
    seen += [("q", 901, "2024-06-01 00:00:00", "red", None), ("q", 902, None, "blue", "oval"), ("q", 903, None, None, "round"), ("q", 904, None, "green", None)]
    rows = spark.createDataFrame(seen, "key string, id long, t string, color string, shape string").withColumn("time", F.to_timestamp("t")).drop("t")
    got = {r.id: (str(r["at"]), r.depth) for r in currency(rows, ["color", "shape"], "infer").where("key = 'q'").collect()}
    assert got[901] == ("2024-06-01 00:00:00", 0) and got[902] == ("2024-06-01 00:00:00", 2) and got[903] == ("2024-06-01 00:00:00", 2) and got[904] == ("None", 0)
    assert {r.depth for r in currency(rows, ["color", "shape"], "last").collect()} == {0}
    assert currency(rows.limit(0), ["color", "shape"], "infer").count() == 0


# --- problem 4 ------------------------------------------------------------------------------------------------------


def test_matching_rules(spark):
    from medloom.llm.matching import match_products, read_records

    schema = "id long, brand string, generic string, dosage string, rule string"
    a = spark.createDataFrame([(1, "Tapovebakom", "xanor", "50mg", "z"), (2, "Tapovebakom", "xanor", "100mg", "z"), (3, "Mulokunisir 500 ug", None, "", "z"), (4, None, None, "5mg", "z"), (None, "Tapovebakom", None, "50mg", "z")], schema)
    b = spark.createDataFrame([(1, "TAPOVEBAKOM", None, "0,05g", "z"), (1, "TAPOVEBAKOM", None, "0,05g", "z"), (2, "tap- ovebakom 50mg", None, None, "z"), (3, "Tapovebkaom", "xanor", "50 mg", "z"), (4, "muloKunisir", None, "0.5mg", "z"), (5, "Mulokunisir", None, None, "z")], schema)
    records = read_records(a, "a", "id", "brand", None, "generic", "dosage").union(read_records(b, "b", "id", "brand", None, "generic", "dosage"))
    known = spark.createDataFrame([("tapovebakom", ["xanor"])], "brand_key string, said array<string>")
    got = {(r.left_id, r.right_id): r.confidence for r in match_products(records, known).collect()}
    assert set(got) == {(1, 1), (1, 2), (1, 3), (3, 4)}
    assert all(0 < c <= 1 for c in got.values())
    assert match_products(records.limit(0), known).count() == 0


def test_equally_frequent_spellings_meet(spark):
    """Unlisted brands, once in each table: one spelling is the entry, unless the ingredients differ; chains keep their own."""
    from medloom.llm.matching import match_products, read_records

    schema = "id long, brand string, generic string, dosage string"
    a = spark.createDataFrame([(1, "Kuphobacgpas", "xanor", "125mg"), (2, "Diva-phaphitrex", None, "1g"), (3, "Modugalorim", "xanor", "5mg"), (4, "Rilopasenib", None, "5mg")], schema)
    b = spark.createDataFrame([(1, "Kuphobacipas", "xanor", "125mg"), (2, "divaphaaphitrex", "xanor", "1g"), (3, "Modugalorin", "pithogexin", "5mg"), (4, "Rilopasxxib", None, "5mg"), (5, "Rilopyyxxib", None, "5mg")], schema)
    c = spark.createDataFrame([(1, "Rilopyyxxib", None, "5mg"), (2, "Rilopasxxib", None, "5mg"), (3, "Rilopasenib", None, "5mg")], schema)
    records = read_records(a, "a", "id", "brand", None, "generic", "dosage")
    for df, name in ((b, "b"), (c, "c")):
        records = records.union(read_records(df, name, "id", "brand", None, "generic", "dosage"))
    known = spark.createDataFrame([("tapovebakom", ["xanor"])], "brand_key string, said array<string>")
    got = {(r.left_tbl, r.left_id, r.right_tbl, r.right_id) for r in match_products(records, known).collect()}
    assert {("a", 1, "b", 1), ("a", 2, "b", 2), ("a", 4, "c", 3), ("b", 5, "c", 1)} <= got
    assert ("a", 3, "b", 3) not in got


def test_deletion_keys_meet(spark):
    from medloom.llm.matching import less_one, less_two

    df = spark.createDataFrame([("abcd", "abdc"), ("abcd", "axcd"), ("abcd", "acd"), ("abcd", "wxcd")], "a string, b string")
    one = [r[0] for r in df.select(F.arrays_overlap(less_one(F.col("a")), less_one(F.col("b")))).collect()]
    two = [r[0] for r in df.select(F.arrays_overlap(less_two(F.col("a")), less_two(F.col("b")))).collect()]
    assert one == [True, True, True, False] and two == [True] * 4


def test_edits_are_counted_after_deletion_keys_meet(spark):
    from medloom.llm.matching import within

    pairs = [("abcdef", "abcdef"), ("abcdef", "abcdxf"), ("abcdef", "abcedf"), ("abcdef", "xbcdxf"), ("abcdef", "xycdef"), ("abcdefgh", "xycdefzw"), ("ab", "ac"), ("abcde", "abxye")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [tuple(r) for r in df.select(within(F.col("a"), F.col("b"), 1), within(F.col("a"), F.col("b"), 2)).collect()]
    assert got == [(True, True), (True, True), (True, True), (False, True), (False, True), (False, False), (False, False), (False, False)]


def test_rules_share_a_pass_without_changing_what_each_resolves(spark):
    """The rules of the first pass in one join give what they give one after the other, each on what is left."""
    from medloom.llm import matching

    rng = random.Random(4)
    names = ["".join(rng.choice("abcdeklpy") for _ in range(rng.randrange(3, 6))) for _ in range(60)]
    records = spark.createDataFrame([("t", k, rng.choice(names), [], [rng.choice(names)] if k % 3 == 0 else []) for k in range(300)], "tbl string, id long, brand string, said array<string>, texts array<string>")
    catalogue = spark.createDataFrame([(f"L:{n}", n, []) for n in sorted(set(names))[::2]], "brand_id string, brand_key string, said array<string>")
    together = {tuple(r) for r in matching.cascade(records, catalogue, "together").collect()}
    passes, matching.PASSES = matching.PASSES, tuple((rule,) for rules in matching.PASSES for rule in rules)
    try:
        alone = {tuple(r) for r in matching.cascade(records, catalogue, "alone").collect()}
    finally:
        matching.PASSES = passes
    assert together == alone and len(together) > 100


# --- problem 6 ------------------------------------------------------------------------------------------------------

LIST = [(1, "Tapovebakom", "brand"), (2, "Mulokunisir", "brand"), (3, "xedoranol", "ingredient"), (4, "pithogexin", "ingredient"), (5, None, "brand")]


def test_mapping(spark):
    from medloom.llm.canonical import map_rows, map_values

    values = {
        "a": ("TAPOVEBAKOM 50mg x 20 viên", {1}), "b": ("4) tapo- vebakom", {1}), "c": ("Tap0vebak0m ống", {1}), "d": ("tapovebkaom", {1}), "e": ("xedoranol (Mulokunisir)", {2}),
        "f": ("xedoranol/pithogexin 5mg/10mg", {3, 4}), "g": ("xedoranol và pithogexin", {3, 4}), "h": ("xedoranol natri", {3}), "i": ("thuốc bổ", {0}), "j": ("500mg", {0}),
        "k": ("  ", set()), "l": (None, set()), "m": ("Khongcotrongds", {0}), "n": ("thuốc Mulokunisir", {2}), "o": ("STT 7 mulocunisir - SL 10", {2}),
    }
    rows = spark.createDataFrame([("f", k, v) for k, (v, _) in values.items()] + [("f", "a", values["a"][0]), ("f", None, "xedoranol")], "field_name string, row_key string, value string")
    entries = spark.createDataFrame(LIST, "entry_id long, name string, kind string")
    got: dict = {k: set() for k in values}
    for r in map_rows(rows, map_values(rows, entries)).collect():
        assert r.entry_id not in got[r.row_key]
        got[r.row_key].add(r.entry_id)
    assert got == {k: v for k, (_, v) in values.items()}
    assert map_values(rows.limit(0), entries).count() == 0
    assert {r.entry_id for r in map_rows(rows, map_values(rows, entries.limit(0))).collect()} == {0}


def test_mapping_recovers_typos(spark, data):
    """Held-out accuracy: entries of the real list, damaged by one or two edits, must come back."""
    from medloom.llm.canonical import map_values

    names = [r.brand_name for r in spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/brand_list.parquet").collect()]
    rng = random.Random(4)
    truth = {}
    for name in names:
        typed = list(name)
        for _ in range(rng.choice((1, 2))):
            k = rng.randrange(1, len(typed) - 1)
            what = rng.choice("dis")
            if what == "d":
                del typed[k]
            elif what == "i":
                typed.insert(k, rng.choice("aeioubcdghk"))
            else:
                typed[k] = rng.choice("aeioubcdghk")
        truth["".join(typed)] = name
    ids = {n: k for k, n in enumerate(names)}
    entries = spark.createDataFrame([(k, n, "brand") for n, k in ids.items()], "entry_id long, name string, kind string")
    rows = spark.createDataFrame([(t,) for t in truth], "value string")
    got = {r.value: r.entry_id for r in map_values(rows, entries).collect()}
    right = sum(got.get(t) == ids[n] for t, n in truth.items())
    wrong = sum(t in got and got[t] != ids[n] for t, n in truth.items())
    assert right >= 0.95 * len(truth) and wrong <= 0.01 * len(truth)


def test_retrieval_is_complete(spark):
    """Every pair within the edits allowed is retrieved, however short or long, and no other."""
    from medloom.llm.canonical import candidates, scan, sound

    rng = random.Random(9)
    entries = sorted({"".join(rng.choice("aeklpy1") for _ in range(n)) for n in range(1, 15) for _ in range(6)})
    keys = set(entries[::3])
    for e in entries:
        for _ in range(6):
            k = list(e)
            for _ in range(rng.randrange(1, 4)):
                at = rng.randrange(len(k) + 1)
                k[at : at + rng.randrange(2)] = rng.choice(["", "x", "k", "l"])
            keys.add("".join(k))
    keys = sorted(keys - {""})
    a, b = spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame([(e,) for e in entries], "entry_key string")
    got = {(r.key, r.entry_key): r.edits for r in candidates(a, b).collect()}
    x, y = F.col("key"), F.col("entry_key")
    far = lambda p, q, most, more=0: F.when(F.levenshtein(p, q) <= most, F.levenshtein(p, q) + more).otherwise(99)
    every = a.crossJoin(b).withColumn("d", F.least(far(x, y, 2), far(sound(x), sound(y), 2), far(scan(x), scan(y), 1, 1))).where("d < 99")
    assert got == {(r.key, r.entry_key): r.d for r in every.collect()}


# --- problem 7 ------------------------------------------------------------------------------------------------------


def passages(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"từ{i}" for i in range(60)] + ["and", "the", "uống", "mỗi"]
    items = [" ".join(rng.choices(vocabulary, k=rng.randrange(15, 40))) for _ in range(12)]
    docs = []
    for k in range(80):
        body = rng.choices(vocabulary + [f"x{i}" for i in range(200)], k=60)
        if k % 3 == 0:
            w = items[k % 12].split()
            n = rng.choice((18, 19, 20, 21, len(w)))
            start = rng.randrange(0, max(1, len(w) - n + 1))
            part = w[start : start + n]
            at = rng.randrange(60)
            body[at:at] = [p.upper() if rng.random() < 0.5 else p for p in part]
        docs.append((k, rng.choice([" ", ", ", "\n"]).join(body)))
    return docs + [(900, None), (901, ""), (902, "the " * 300)], [*enumerate(items), (50, None), (51, "ngắn"), (52, "the " * 30)]


def test_leaks_equal_brute_force(spark):
    from medloom.llm.leakage import leaked

    docs, items = passages()
    d = spark.createDataFrame(docs + docs[:9], "doc_id long, text string").withColumn("item_id", F.lit(7))
    i = spark.createDataFrame(items + items[:2], "item_id long, text string").withColumn("doc_id", F.lit(7))
    want = set()
    for a, text in docs:
        grams = {tuple(w[k : k + 20]) for w in [folded_words(text or "")] for k in range(len(w) - 19)}
        for b, item in items:
            w = folded_words(item or "")
            if any(tuple(w[k : k + 20]) in grams for k in range(len(w) - 19)):
                want.add((a, b))
    rows = leaked(d, i).collect()
    assert len(rows) == len(want) > 10 and {(r.doc_id, r.item_id) for r in rows} == want
    blocks = leaked(d, i, block_items=4).collect()
    assert {(r.doc_id, r.item_id) for r in blocks} == want
    near = {(r.doc_id, r.item_id) for r in leaked(d, i, slack=2).collect()}
    assert near >= want
    assert leaked(d.limit(0), i).count() == 0 and leaked(d, i.limit(0)).count() == 0


def test_leak_in_a_very_long_text(spark, monkeypatch):
    from medloom.llm import leakage

    monkeypatch.setattr(leakage, "CHUNK", 500)
    docs, items = passages(6)
    w = items[1][1].split() + items[2][1].split()
    long = " ".join(f"x{k}" for k in range(2000)) + " " + " ".join(w) + " " + " ".join(f"y{k}" for k in range(2000))
    d, i = spark.createDataFrame([(1, long)], "doc_id long, text string"), spark.createDataFrame(items[1:3], "item_id long, text string")
    rows = {r.item_id: r for r in leakage.leaked(d, i).collect()}
    assert rows.keys() == {b for b, t in items[1:3] if len(t.split()) >= 20}
    for r in rows.values():
        assert r.doc_word == 2000 + (0 if r.item_id == 1 else len(items[1][1].split()))


# --- problem 8 ------------------------------------------------------------------------------------------------------


def mixture(spark, sizes, targets, **how):
    from medloom.llm.mixing import Mixture

    rng = random.Random(1)
    docs = []
    for source, n in sizes:
        docs += [(len(docs) + k, " ".join(rng.choices(["red", "blue", "green", "pill", "dose"], k=rng.randrange(1, 80))), source) for k in range(n)]
    docs += [(9001, None, "a"), (9002, "", "a"), (None, "x", "a")]
    d = spark.createDataFrame(docs + docs[:7], "doc_id long, text string, source string").withColumn("block", F.lit("clash"))
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    return Mixture(d, t, **how)


def test_permutation_is_one():
    from medloom.llm.mixing import permuted

    for n in (1, 2, 3, 10, 64, 1000):
        p = permuted(np.arange(n), n, 7)
        assert sorted(p.tolist()) == list(range(n))
    assert permuted(np.arange(1000), 1000, 7).tolist() != permuted(np.arange(1000), 1000, 8).tolist()


def test_shares_and_caps(spark):
    m = mixture(spark, [("a", 300), ("b", 100), ("c", 5), ("left", 50), (None, 20)], [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 2), ("gone", 0.1, 4)], block_tokens=32, shard_blocks=16)
    usage = m.usage().collect()
    assert {r.source for r in usage} == {"a", "b", "c"}
    assert len({r.doc_id for r in usage}) == len(usage) == 405
    most = {"a": 1, "b": 3, "c": 2}
    assert all(r.times_used <= most[r.source] for r in usage)
    shares = {r.source: r for r in m.shares().collect()}
    assert shares["gone"].actual_share == 0 and not shares["gone"].target_met
    assert not shares["c"].target_met and shares["c"].most_used == 2
    assert shares["c"].tokens_used == 2 * shares["c"].tokens
    for s, t in (("a", 0.5), ("b", 0.3)):
        assert shares[s].target_met and abs(shares[s].share_of_plan - t) < 0.02
    assert sum(r.actual_share for r in shares.values()) == pytest.approx(1, abs=1e-5)
    assert sum(r.tokens_used for r in usage) == sum(r.tokens_used for r in shares.values())
    slots = m.slots().collect()
    assert len(slots) == sum(m.quota.values())
    assert len({(r.source, r.slot) for r in slots}) == len(slots)
    again = sorted(tuple(r) for r in m.usage().collect())
    assert again == sorted(tuple(r) for r in usage)
    # The mix holds what the usage says, in full blocks but for the last of a source.
    rows = m.mixed().collect()
    held = {}
    for r in rows:
        held[r.doc_id] = held.get(r.doc_id, 0) + r.held
    assert held == {r.doc_id: r.tokens_used for r in usage if r.tokens_used}
    per = {}
    for r in rows:
        per[r.source, r.slot] = per.get((r.source, r.slot), 0) + r.held
    assert all(n == 32 or n == m.tokens[s] % 32 for (s, _), n in per.items()) and len(per) == len(slots)
    # Every shard is full and each source is spread over the shards.
    by_shard = {}
    for r in slots:
        by_shard.setdefault(r.shard, []).append(r.source)
    assert all(len(v) == 16 for k, v in by_shard.items() if k != max(by_shard))
    assert sum("a" in v for v in by_shard.values()) > 0.9 * len(by_shard)


def test_shard_counts_are_draws_without_replacement():
    from medloom.llm.mixing import permuted

    counts = np.array([np.bincount(permuted(np.arange(3000), 3000, seed)[:300] < 1000, minlength=2)[1] for seed in range(300)])
    spread = 300 * (1 / 3) * (2 / 3) * (2700 / 2999)  # variance of the hypergeometric law
    assert abs(counts.mean() - 100) < 2 and 0.7 * spread < counts.var() < 1.4 * spread
    big = permuted(np.arange(5), 10**12, 3)
    assert len(set(big.tolist())) == 5 and (0 <= big).all() and (big < 10**12).all()


def test_mixing_nothing(spark):
    assert mixture(spark, [], [("a", 1.0, 1)]).usage().count() == 0
    empty = mixture(spark, [("a", 3)], [])
    assert empty.usage().count() == 0 and empty.shares().count() == 0


# --- problem 9 ------------------------------------------------------------------------------------------------------


def spans_corpus(seed=2):
    rng = random.Random(seed)
    line = lambda n: "".join(rng.choices("abcdeđ êô \n", k=n))
    notices = [line(n) for n in (40, 59, 60, 61, 100, 150)]
    docs = []
    for k in range(60):
        text = line(rng.randrange(0, 200))
        for _ in range(rng.randrange(0, 3)):
            n = rng.choice(notices)
            cut = rng.choice((0, 0, 5))
            text += n[cut:] + line(rng.randrange(0, 50))
        docs.append((k, text))
    docs += [(100, docs[3][1]), (101, docs[3][1]), (102, "a" * 400), (103, "b" + "a" * 300), (104, None), (105, ""), (106, notices[4])]
    return docs


def brute_spans(docs, n):
    where, covered = {}, {}
    for i, t in docs:
        for k in range(len(t or "") - n + 1):
            where.setdefault(t[k : k + n], []).append((i, k))
    pairs = set()
    for hits in where.values():
        ids = sorted({i for i, _ in hits})
        pairs |= {(a, b) for a in ids for b in ids if a < b}
        if len(ids) > 1:
            for i, k in hits:
                covered.setdefault(i, set()).update(range(k, k + n))
    return pairs, {i: len(c) for i, c in covered.items()}


@pytest.mark.parametrize("pairwise", [200, 1])
def test_spans_equal_brute_force(spark, pairwise):
    from medloom.llm.spans import SharedSpans

    docs = spans_corpus()
    pairs, covered = brute_spans(docs, 60)
    assert len(pairs) > 50
    df = spark.createDataFrame(docs + docs[:5], "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("doc", F.lit(1))
    s = SharedSpans(df, min_chars=60, block=24, pairwise=pairwise)
    got = [tuple(r) for r in s.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    length = {i: len(t or "") for i, t in docs}
    assert {r.doc_id: r.shared_chars or length[r.doc_id] for r in s.coverage().collect()} == covered
    # Phrases are what they are copied from, do not overlap and are as long as the spans need.
    texts = dict(docs)
    last = {}
    for r in sorted(s.parse().collect(), key=lambda r: (r.doc, r.start)):
        assert texts[r.doc][r.start : r.start + r.chars] == texts[r.ref][r.ref_start : r.ref_start + r.chars] and r.doc != r.ref
        assert r.start >= last.get(r.doc, 0)
        last[r.doc] = r.start + r.chars
    assert all(f.chars >= 60 and texts[f.doc_a][f.start_a : f.start_a + f.chars] == texts[f.doc_b][f.start_b : f.start_b + f.chars] for f in s.factors().collect())
    classes = {r.doc_id: (r.class_id, r.copies) for r in s.members_of().collect()}
    assert classes.keys() == covered.keys() and classes[100] == classes[101] == classes[3] == (3, 3)


def test_a_factor_is_as_long_as_two_records_agree(spark):
    from medloom.llm.spans import SharedSpans

    rng = random.Random(3)
    line = lambda n: "".join(rng.choices("abcdefgh", k=n))
    common = line(5000)
    other = "".join(rng.choices("ijklmn", k=500))
    docs = [(1, other[:70][::-1] + common + other[:20][::-1]), (2, common), (3, other + common[1000:1100])]
    got = [tuple(r) for r in SharedSpans(spark.createDataFrame(docs, "doc_id long, text string"), min_chars=60, block=24).factors().collect()]
    assert set(got) >= {(1, 70, 2, 0, 5000), (1, 1070, 3, 500, 100), (2, 1000, 3, 500, 100)} and len(got) == 3


def test_spans_in_pieces_and_empty(spark, monkeypatch):
    from medloom.llm import spans

    monkeypatch.setattr(spans, "CHUNK", 97)
    docs = spans_corpus(8)
    pairs, covered = brute_spans(docs, 60)
    s = spans.SharedSpans(spark.createDataFrame(docs, "doc_id long, text string"), min_chars=60, block=24)
    assert {tuple(r) for r in s.pairs().collect()} == pairs
    length = {i: len(t or "") for i, t in docs}
    assert {r.doc_id: r.shared_chars or length[r.doc_id] for r in s.coverage().collect()} == covered
    none = spans.SharedSpans(spark.createDataFrame([], "doc_id long, text string"))
    assert none.pairs().count() == 0 and none.coverage().count() == 0


# --- queries --------------------------------------------------------------------------------------------------------

COLUMNS = {
    "p1_found": ["image_a", "image_b"],
    "p2_found": ["group_id", "field_name", "kept_id"],
    "p4_found": ["left_tbl", "left_id", "right_tbl", "right_id"],
    "p6_found": ["field_name", "row_key", "entry_id"],
    "p7_found": ["doc_id", "item_id"],
    "p9_found": ["doc_a", "doc_b"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_found_queries(name, spark, data):
    df = registry.queries()[name](spark, data)
    assert df.columns == COLUMNS[name]
    assert df.count() == df.distinct().count()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(name, spark, data, duck, same):
    same(registry.queries()[name](spark, data).toPandas(), duck.execute(registry.oracle_sql()[name]).df())
