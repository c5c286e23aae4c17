import json

from pyspark.sql import functions as F

from medloom.operators import dedupe, layout, matching, pairs, profiles, quality, resolve, schedule, sessions


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_upsert_keeps_note_and_overwrites_status(spark):
    log = spark.createDataFrame([("o", 1, "skipped", "x"), ("o", 2, "taken", None), ("p", 1, "missed", None)], "id string, seq int, status string, note string")
    assert rows(dedupe.upsert(log, ["id"], ["seq"], ["status"], ["note"])) == [("o", "taken", "x"), ("p", "missed", None)]


def test_upsert_overwrites_with_null(spark):
    log = spark.createDataFrame([("o", 1, "t"), ("o", 2, None)], "id string, seq int, taken string")
    assert rows(dedupe.upsert(log, ["id"], ["seq"], ["taken"], [])) == [("o", None)]


def test_first_and_last(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), (None, 5, "n")], "k string, n int, v string")
    assert rows(dedupe.last_wins(df, ["k"], ["n"])) == [(None, 5, "n"), ("a", 2, "y")]
    assert rows(dedupe.first_wins(df, ["k"], ["n"])) == [(None, 5, "n"), ("a", 1, "x")]
    assert dedupe.last_wins(df.limit(0), ["k"], ["n"]).count() == 0


def test_merges_and_deltas(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 1)], "k int, v string, n int")
    assert rows(dedupe.merge_into(base, new, ["k"], "n")) == [(1, "a", 1), (2, "c", 1), (3, "d", 1)]
    assert rows(dedupe.snapshot_changes(base, new, ["k"])) == [(1, "removed"), (2, "changed"), (3, "added")]
    assert rows(dedupe.key_delta(base, new, ["k"])) == [(1, "cancel"), (3, "create")]
    assert rows(dedupe.patch(base, spark.createDataFrame([(1, None), (2, "z")], "k int, v string"), ["k"])) == [(1, "a", 1), (2, "z", 1)]
    assert rows(dedupe.replace_children(base, new.limit(0), "k")) == rows(base)
    assert rows(dedupe.manual_over_auto(base, new, ["k"], "n"))[1] == (2, "c", 1)


def test_interaction_of_two_drugs(spark):
    drugs = spark.createDataFrame([("r", "warfarin-drug", "warfarin"), ("r", "aspirin-drug", "aspirin"), ("r", "aspirin-drug", "warfarin")], "request string, drug string, ingredient string")
    rule = spark.createDataFrame([("warfarin", "aspirin", "Nghiêm trọng", "k1")], "ingredient_a string, ingredient_b string, severity_text string, dedupe_key string")
    found = pairs.ingredient_pairs(drugs, rule)
    assert [(r.drug_a, r.drug_b, r.severity) for r in found.collect()] == [("warfarin-drug", "aspirin-drug", "major")]
    summary = pairs.severity_summary(found, "request").first()
    assert (summary.total, summary.n_major, summary.n_minor, summary.highest) == (1, 1, 0, "major")


def test_trigram_join_equals_brute_force(spark):
    from medloom.functions.similarity import trigram_similarity

    names = spark.createDataFrame([(n,) for n in ("red ring", "red rings", "blue plate", "", "đỏ thẫm")], "n string")
    asked = spark.createDataFrame([("red rng",), ("plate",), ("",)], "q string")
    got = {(r.q, r.n): round(r.sim, 9) for r in resolve.trigram_join(asked, "q", names, "n", 0.2).collect()}
    brute = asked.crossJoin(names).withColumn("s", trigram_similarity(F.col("q"), F.col("n"))).where("s >= 0.2")
    assert got == {(r.q, r.n): round(r.s, 9) for r in brute.collect()}


def test_schedule(spark):
    plans = spark.createDataFrame([("P", "2026-03-10", "2026-03-11"), ("Q", "2026-03-12", "2026-03-11")], "plan string, a string, b string").select("plan", F.to_date("a").alias("a"), F.to_date("b").alias("b"))
    doses = schedule.expand(plans, F.array(F.lit("08:00"), F.lit("20:00")), F.col("a"), F.col("b"))
    assert doses.count() == 4
    open_ended = spark.createDataFrame([("x", "2026-01-01", None)], "p string, start_date string, end_date string")
    assert schedule.active_on(open_ended, F.lit("2026-03-01")).count() == 1


def test_sessions(spark):
    items = spark.createDataFrame(
        [("s", "a", "unmapped", 0.5, 0.1, "", "GOOD", 1), ("s", "a", "confirmed", 0.9, 0.2, "A", "WARN", 2), ("s", "b", "unmapped", 0.4, 0.3, None, "GOOD", 3)],
        "session string, key string, status string, confidence double, score double, text string, quality string, n int",
    )
    merged = sessions.merge_items(items, "session", "key", ["n"])
    assert rows(merged) == [("s", "a", 2, 0.9, 0.2, "confirmed", "A", "GOOD,WARN"), ("s", "b", 1, 0.4, 0.3, "unmapped", None, "GOOD")]
    assert sessions.signature(merged, "session", "key").first().signature == "a:confirmed|b:unmapped"
    bad = sessions.all_of_last(items, "session", [F.desc("n")], 3, F.col("status") == "unmapped")
    assert bad.count() == 0


def test_layout_queries_take_every_day(spark, tmp_path):
    from medloom.plans import registry

    events = [(5, 1, "2024-01-04 08:00:00"), (6, 1, "2024-01-04 09:30:00"), (7, 1, "2024-01-05 08:00:00"), (76, 1, "2024-01-05 08:30:00"), (10, 2, "2024-01-03 08:00:00")]
    df = spark.createDataFrame(events, "event_id long, user_id long, ts string")
    df.withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/events.parquet")
    ask = lambda name: registry.queries()[name](spark, str(tmp_path))
    assert {(r.page, r.edge, r.next) for r in ask("q40_gaps").collect()} == {("1:2024-01-04", 486, 570), ("1:2024-01-05", 488, 510)}
    assert {(r.page, r.block, r.anchor) for r in ask("q41_nearest_anchor").collect()} == {
        ("1:2024-01-04", 5, 5), ("1:2024-01-04", 6, 5), ("1:2024-01-05", 7, None), ("1:2024-01-05", 76, None), ("2:2024-01-03", 10, 10),
    }
    assert {(r.page, r.src, r.dst, r.dir) for r in ask("q42_neighbours").collect()} == {("1:2024-01-04", 5, 6, "right"), ("1:2024-01-05", 7, 76, "right")}


def test_layout(spark):
    blocks = spark.createDataFrame([(1, 1, 0, 10, 0, 10), (1, 2, 12, 20, 2, 8), (1, 3, 0, 9, 20, 30), (1, 4, 12, 20, 10, 12)], "page int, block int, x1 int, x2 int, y1 int, y2 int")
    assert rows(layout.neighbours(blocks, "page", "block", "x1", "x2", "y1", "y2")) == [(1, 1, 2, "right"), (1, 1, 3, "below"), (1, 2, 4, "below")]
    anchors = spark.createDataFrame([(1, 7, 0), (1, 8, 20)], "page int, anchor int, ay int")
    assert [(r.block, r.anchor) for r in layout.nearest_anchor(blocks, anchors, "page", "y1", "ay", "anchor").orderBy("block").collect()] == [(1, 7), (2, 7), (3, 8), (4, 7)]
    titles = spark.createDataFrame([(1, 1, 0, 20), (1, 2, 80, 100), (1, 3, 110, 130)], "page int, block int, top int, bottom int")
    assert [r.band for r in layout.bands(titles, "page", "top", "bottom", "block").orderBy("block").collect()] == [1, 2, 2]
    text = spark.createDataFrame([(1, 1, 0, 5, "b", 0, 5, 4, 9, 0.8), (1, 1, 0, 1, "a", 0, 1, 4, 4, 0.6), (1, 1, 1, 2, "c", 5, 2, 9, 4, 1.0)], "page int, band int, col int, y int, t string, x1 int, y1 int, x2 int, y2 int, conf double")
    line = layout.roll_up(text, ["page", "band"], "col", "y", "t", ["x1", "y1", "x2", "y2"], "conf").first()
    assert (line.line, line.x1, line.y1, line.x2, line.y2, line.confidence) == ("a b | c", 0, 1, 9, 9, 0.8)


def test_matching(spark):
    bank = spark.createDataFrame([("A", [1.0, 0.0]), ("A", [0.9, 0.1]), ("B", [0.0, 1.0])], "label string, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "vec_id int, embedding array<double>")
    best = matching.score_candidates(asked, bank, "vec_id", "embedding", "label", 1)
    assert rows(best) == [(1, "A", 1.0, 1), (2, "B", 1.0, 1)]
    assert rows(matching.score_candidates(asked, bank, "vec_id", "embedding", "label", 1, block=1)) == rows(best)
    assert matching.score_candidates(asked, bank.limit(0), "vec_id", "embedding", "label").count() == 0
    found = spark.createDataFrame([("P", 1, "assigned", 0.9, 1), ("P", 2, "assigned", 0.8, 1), ("P", 3, "unknown", 0.1, 1)], "plan string, id int, status string, confidence double, expected int")
    marked = matching.mark_extra(found, "plan", "expected", [F.desc("confidence"), F.col("id")])
    assert [(r.id, r.status) for r in marked.orderBy("id").collect()] == [(1, "assigned"), (2, "extra"), (3, "unknown")]
    wanted = spark.createDataFrame([("P", 1), ("Q", 2)], "plan string, n int")
    assert rows(matching.count_summary(wanted, marked, "plan", "n")) == [("P", 1, 1, 1, 0), ("Q", 2, 0, 0, 2)]


def test_html(spark):
    page = """<title>Para 500</title><meta property="og:image" content="u1"/><meta property="og:image" content="u2"/>
    <div><span>Thương hiệu: </span><span>DHG &amp; Co</span></div><p>Số đăng ký: VD-1</p><p>Hoạt chất<!-- -->:</p><div>Paracetamol; Caffein</div>
    <p>Quy cách</p></div><div><div x="y">Hộp 10</div></div><span data-test-id="sku">00022</span>
    <script id="__NEXT_DATA__" type="x">{"a": {"b": 5}}</script>"""
    df = spark.createDataFrame([(page,)], "h string").select(profiles.unescaped(F.col("h")).alias("h"))
    got = df.select(
        profiles.page_title(F.col("h")), profiles.og_values(F.col("h"), "og:image"), profiles.inline_value(F.col("h"), "Thương hiệu:"), profiles.inline_value(F.col("h"), "Số đăng ký:"),
        profiles.label_value(F.col("h"), "Hoạt chất"), profiles.label_value(F.col("h"), "Quy cách"), profiles.attribute_text(F.col("h"), "data-test-id", "sku"), profiles.embedded_json(F.col("h"), "$.a.b"),
    ).first()
    assert tuple(got) == ("Para 500", ["u1", "u2"], "DHG & Co", "VD-1", "Paracetamol; Caffein", "Hộp 10", "00022", "5")


def test_profile_merge_and_votes(spark):
    records = spark.createDataFrame([("k", 2, "late", ["b", "c"]), ("k", 1, "", ["a", "b"]), ("k", 3, "later", None)], "key string, rank int, name string, images array<string>")
    assert tuple(profiles.merge_first_filled(records, "key", "rank", ["name"], ["images"]).first())[:2] == ("k", "late")
    texts = spark.createDataFrame([("g", 1, "paracetamol", 0.9), ("g", 2, "paracetamol", 0.7), ("g", 2, "vitamin c", 0.5), ("g", 3, "abc", 0.5)], "g string, image int, text string, c double")
    assert [tuple(r) for r in profiles.consensus(texts, "g", "image", "text", "c").collect()] == [("g", "paracetamol", 2, 2, 0.8)]
    tags = profiles.bio_tags(spark.createDataFrame([(1, "Para 500mg", True)], "b int, t string, d boolean"), "b", F.col("t"), F.col("d"))
    assert [r.tag for r in tags.orderBy("pos").collect()] == ["B-DRUG", "I-DRUG"]


def test_quality(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, n int")
    assert {r.k: r.pct for r in quality.distribution(df, "k").collect()} == {"a": 66.6667, None: 33.3333}
    assert [r.errors for r in quality.validate(df, {"k": F.col("k") == "a", "n": F.col("n") < 3}).orderBy("n").collect()] == [[], [], ["k", "n"]]
    assert quality.page(df, [F.col("n")], 2, 2).count() == 1
    assert json.loads(quality.precision_recall(df, F.col("n") < 3, F.col("n") > 1).toJSON().first())["precision"] == 0.5


def test_aliases_and_fallbacks(spark):
    left = spark.createDataFrame([(1, "Paracetamol"), (2, "abc"), (3, " ")], "l int, alias string")
    right = spark.createDataFrame([(7, "paracetamol 500"), (8, "ABC"), (9, "xabcx")], "r int, alias string")
    assert rows(resolve.alias_pairs(left, "l", right, "r")) == [(1, 7), (2, 8)]
    one = spark.createDataFrame([("abcdefgh-x", "abcdefgh"), ("abc", "abd"), ("", "a")], "a string, b string")
    assert [r[0] for r in one.select(resolve.starts_either(F.col("a"), F.col("b"))).collect()] == [True, False, False]
    refs = spark.createDataFrame([("P", "One", 5), ("Q", "two", 6)], "plan string, name string, v int")
    asked = spark.createDataFrame([("P", "x"), ("Z", "TWO"), ("Z", "none")], "plan string, name string")
    assert {(r.plan, r.name): r.v for r in resolve.with_fallback(asked, refs, "plan", "name", "v").collect()} == {("P", "x"): 5, ("Z", "TWO"): 6, ("Z", "none"): None}


def test_scanned_name_finds_its_entry(spark):
    names = spark.createDataFrame([("losartan 50mg",), ("cozaar 50mg",), ("cozaar",), ("viên nén khác",)], "search_key string")
    asked = spark.createDataFrame([("Losartan ( Cozaar 50 mg ) 50 mg",), ("zzz",)], "q string")
    best = resolve.best_variant(asked, "q", names, "search_key").collect()
    assert len(best) == 1 and best[0].search_key in {"losartan 50mg", "cozaar 50mg", "cozaar"} and best[0].score >= 0.65


def test_severity_groups_are_in_order(spark):
    from medloom.operators.pairs import severity_groups, severity_per_item

    rows = [("r", "a", "b", "Nghiêm trọng", "major"), ("r", "a", "c", "Đặc biệt", "unknown"), ("r", "c", "d", "Dè dặt", "unknown"), ("r", "a", "d", "Đặc biệt", "unknown"), ("s", "x", "y", "Em", "unknown")]
    found = spark.createDataFrame(rows, "request string, drug_a string, drug_b string, severity_text string, severity string")
    got = [(r.request, r.place, r.severity_text, r.n, [tuple(i) for i in r.interactions]) for r in severity_groups(found, "request").orderBy("request", "place").collect()]
    # d comes before đ in Vietnamese, and both before e.
    assert got == [("r", 1, "Nghiêm trọng", 1, [("a", "b")]), ("r", 2, "Dè dặt", 1, [("c", "d")]), ("r", 3, "Đặc biệt", 2, [("a", "c"), ("a", "d")]), ("s", 1, "Em", 1, [("x", "y")])]
    assert {(r.drug, r.highest, r.n) for r in severity_per_item(found.where("request = 'r'"), "request").collect()} == {("a", "major", 3), ("b", "major", 1), ("c", "unknown", 2), ("d", "unknown", 2)}


def test_two_scorers(spark):
    from medloom.operators.resolve import catalogue_with_fallback, two_scorers

    names = spark.createDataFrame([("paracetamol 500mg",), ("panadol extra",), ("losartan",), (None,)], "entry string")
    asked = spark.createDataFrame([("500mg Paracetamol",), ("Losartan 50",), ("xyz",), ("no such thing",), (None,), ("Losartan 50",)], "q string")
    got = {r.q: (r.entry, r.score) for r in two_scorers(asked, "q", names, "entry").collect()}
    assert got["500mg Paracetamol"] == ("paracetamol 500mg", 100.0) and got["Losartan 50"][0] == "losartan" and len(got) == 2
    cached = spark.createDataFrame([("Losartan", "2026-02-01"), ("Panadol", "2025-01-01")], "name string, t string").select("name", F.to_timestamp("t").alias("expires_at"))
    wanted = spark.createDataFrame([("losartan",), ("panadol",), ("zzz",)], "q string")
    tiers = {r.q: (r.name, r.tier) for r in catalogue_with_fallback(wanted, "q", cached, "name", F.lit("2026-01-01").cast("timestamp")).collect()}
    assert tiers == {"losartan": ("Losartan", 0), "panadol": ("Panadol", 1)}


def test_inference_interface(spark):
    from medloom.operators import inference

    def load():
        import pandas as pd

        def model(batch):
            out = batch.loc[batch.index.repeat(2)]
            return pd.DataFrame({"label": out["text"].str.upper(), "confidence": [0.5] * len(out)}, index=out.index)

        return model

    df = spark.createDataFrame([(k, f"t{k}", "z") for k in range(150)], "id long, text string, label string")
    got = inference.apply(df, load, ["text"], "text_classify", keep=["id"], batch=7)
    assert got.columns == ["id", "label", "confidence"] and got.count() == 300
    assert {(r.id, r.label) for r in got.collect()} == {(k, f"T{k}") for k in range(150)}
    assert inference.apply(df.limit(0), load, ["text"], "text_classify", keep=["id"]).count() == 0


def test_convergence_reasons(spark):
    from medloom.operators.sessions import convergence

    scans = [("bad", k, True) for k in range(3)] + [("good", k, False) for k in range(3)] + [("new", k, False) for k in range(2)] + [("one", 0, False)]
    items = [("good", k, "x", "confirmed", 0.9) for k in range(3)] + [("new", 0, "x", "confirmed", 0.8), ("new", 1, "x", "confirmed", 0.9)] + [("one", 0, "x", "confirmed", 0.9)]
    s = spark.createDataFrame(scans, "session string, scan int, rejected boolean")
    i = spark.createDataFrame(items, "session string, scan int, key string, status string, confidence double")
    got = {r.session: (r.converged, r.reason) for r in convergence(s, i, "session", "scan", [F.desc("scan")]).collect()}
    assert got == {"bad": (False, "repeated_bad_images"), "good": (True, "stable_high_confidence"), "new": (False, None), "one": (False, None)}
    assert convergence(s.limit(0), i, "session", "scan", [F.desc("scan")]).count() == 0


def test_candidates_in_blocks_are_the_same(spark):
    import numpy as np

    from medloom.operators.matching import score_candidates

    rng = np.random.default_rng(0)
    rows = [(k, f"l{k % 7}", [float(v) for v in rng.normal(size=6) / 3]) for k in range(60)]
    bank = spark.createDataFrame(rows, "id long, label string, v array<float>")
    asked = bank.select("id", "v").union(spark.createDataFrame([(900, [1.0]), (901, None)], "id long, v array<float>"))
    whole, parts = (sorted(map(tuple, score_candidates(asked, bank, "id", "v", "label", 3, block).collect())) for block in (1000, 8))
    assert whole == parts and len(whole) == 180
    assert score_candidates(asked, bank.limit(0), "id", "v", "label").count() == 0


def _interactions(spark):
    """Drugs of requests, and rules, with spellings, nulls and repeated rows; and the interactions, by brute force."""
    from itertools import product

    drugs = [("r", "A", "x"), ("r", "A", "y"), ("r", "a", "y"), ("r", "B", "y"), ("r", "B", "x"), ("r", "B", "x"), ("s", "A", "x"), ("s", "C", "z"), ("s", None, "z"), ("t", "A", "x"), (None, "B", "y"), ("s", "D", None), ("u", "?", "x"), ("u", "C", "z")]
    rules = [("x", "y", "Nghiêm trọng", "k1"), ("y", "x", "Nhẹ", "k1"), ("x", "z", "Nhẹ", "k2"), ("x", "x", "Nhẹ", None), (None, "z", "Nhẹ", "k3")]
    best = {}
    for (r, a, i), (q, b, j), (m, n, text, key) in product(drugs, drugs, rules):
        if r is not None and r == q and None not in (a, b) and i is not None and (i, j) == (m, n):
            one, other = ("" if d == "?" else d.lower() for d in (a, b))
            if one != other:
                group = r, min(one, other), max(one, other), key
                best[group] = min(best.get(group, (r, a, b, i, j, text)), (r, a, b, i, j, text))
    frames = spark.createDataFrame(drugs, "request string, drug string, ingredient string"), spark.createDataFrame(rules, "ingredient_a string, ingredient_b string, severity_text string, dedupe_key string")
    return *frames, sorted(best.values())


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_interactions_equal_brute_force(spark):
    drugs, rules, expected = _interactions(spark)
    for n in (None, 3):
        found = pairs.ingredient_pairs(drugs, rules, partitions=n).select("request", "drug_a", "drug_b", "ingredient_a", "ingredient_b", "severity_text")
        assert sorted(map(tuple, found.collect())) == expected


def test_interaction_groups_shuffle_only_the_drugs(spark):
    drugs, rules, _ = _interactions(spark)
    assert _shuffles(pairs.severity_groups(pairs.ingredient_pairs(drugs, rules), "request")) == 1


def test_severity_per_drug_shuffles_only_the_drugs(spark):
    drugs, rules, expected = _interactions(spark)
    found = pairs.severity_per_item(pairs.ingredient_pairs(drugs, rules), "request")
    assert _shuffles(found) == 1
    ends = [(r, d) for r, a, b, *_ in expected for d in (a, b)]
    assert {(r.request, r.drug, r.n) for r in found.collect()} == {(*e, ends.count(e)) for e in ends}
