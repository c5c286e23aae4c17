from datetime import date

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from medloom.functions import dates, numeric, rules, similarity, text
from medloom.functions.quantity import Quantity, bare_number, number, quantities, unit_beside, unit_named


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("written", "found"),
    [
        ("1.000mg", [("ug", 1_000_000)]),
        ("625/750mg", [("ug", 625_000), ("ug", 750_000)]),
        ("2,5 %", [("ug/ml", 25_000)]),
        ("0,15 gam + 4.2 mg", [("ug", 150_000), ("ug", 4_200)]),
        ("1 viên 2.000\xa0mg x 2 lần/ngày", [("ug", 2_000_000)]),
        ("1500 đơn vị/5cc", [("iu/ml", 300)]),
        ("0,5 triệu UI", [("iu", 500_000)]),
        ("9mg / ml", [("ug/ml", 9_000)]),
        ("500mg trong 100ml", [("ug/ml", 5_000)]),
        ("0.25 L", [("ul", 250_000)]),
        ("1.500.000 đvqt", [("iu", 1_500_000)]),
        ("sáng 1 chiều 1", []),
        ("10 giọt", []),
        ("1-1-1", []),
        ("ngày 2 lần", []),
        ("6ul trong tên goxe6ul", [("ul", 6)]),
        ("", []),
        (None, []),
        ("750", []),
    ],
)
def test_quantities(written, found):
    assert quantities(written) == [Quantity(*q) for q in found]


def test_numbers():
    assert [number(t) for t in ("1.500", "1,5", "2.5", "1.250.000")] == [1500, 1.5, 2.5, 1_250_000]
    assert bare_number(" 62,5 ") == 62.5
    assert bare_number("62,5mg") is None
    assert unit_beside("Abc 62,5MG", bare_number("62,5")) == "mg"
    assert unit_beside("Abc 60MG", bare_number("62,5")) is None
    assert unit_named("ghi theo mg / lần") == "mg"
    assert unit_named("đơn vị ml") == "ml"
    assert unit_named("ghi theo đơn vị") == "don vi"
    assert unit_named("uống với 200ml nước") is None


@given(st.integers(1, 999), st.integers(0, 999))
def test_grouped_thousands(a, b):
    assert number(f"{a}.{b:03d}") == a * 1000 + b
    assert quantities(f"{a}.{b:03d} mg") == [Quantity("ug", (a * 1000 + b) * 1000)]


def test_keys(spark):
    assert value(spark, text.name_key(F.lit("  Đường-Huyết  Ổn (5MG) "))) == "duong huyet on 5mg"
    assert value(spark, text.strip_accents_col(F.lit("Đau Ổn é"))) == "Dau On e"
    assert value(spark, text.fold_col(F.lit("é"))) == "e"
    assert value(spark, text.ascii_key(F.lit("Đau 5"))) == "au5"
    assert value(spark, text.first_filled(F.lit(" "), F.lit(None), F.lit(" x "))) == "x"
    assert value(spark, text.first_filled(F.lit(None))) == ""
    assert value(spark, text.pair_key(F.lit("b"), F.lit("a"))) == "a || b"
    assert value(spark, text.pair_key(F.lit("b"), F.lit(""))) == "b"


@given(st.text(alphabet="aăâđêôơưáàảãạắằẳẵặấầẩẫậéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ XYZĐ19", max_size=12))
def test_fold_is_plain(word):
    folded = text.fold(word)
    assert folded.isascii() and folded == folded.lower() and len(folded) == len(word)


def test_tokens(spark):
    assert value(spark, text.strength_tokens(F.lit("A 5,5mg / 10 ml 5.5MG"))) == ["5.5 mg", "10 ml"]
    assert value(spark, text.strength_fits(F.lit("A 5mg"), F.lit("B"))) is True
    assert value(spark, text.strength_fits(F.lit("A 5mg"), F.lit("B 6mg"))) is False
    assert value(spark, text.shares_root(F.lit("Ginkgo viên"), F.lit("viên tanakan ginkgo"))) is True
    assert value(spark, text.shares_root(F.lit("viên nén"), F.lit("viên sủi"))) is False
    assert value(spark, text.clean_scanned(F.lit("3 Losartan 50 mg viên 10"))) == "losartan viên"
    assert value(spark, text.in_parentheses(F.lit("Losartan ( Cozaar 50 mg ) 50"))) == "Cozaar 50 mg"
    assert value(spark, text.without_parentheses(F.lit("Losartan ( Cozaar ) 50"))) == "Losartan 50"
    assert value(spark, text.list_number(F.lit("12) Abc"))) == "12"
    assert value(spark, text.without_list_number(F.lit("12) Abc"))) == "Abc"
    assert value(spark, text.query_tokens(F.lit("Hộp 10 viên Paracetamol 500"))) == ["paracetamol", "500"]
    assert value(spark, text.truncated(F.lit("x" * 600)))[-4:] == "x..."
    near = value(spark, text.slug_score(F.lit("paracetamol 500"), F.lit("https://x.vn/paracetamol-500-hop.html")))
    far = value(spark, text.slug_score(F.lit("paracetamol 500"), F.lit("https://x.vn/vitamin-c.html")))
    assert near > far == 0


def test_similarity(spark):
    assert value(spark, similarity.trigram_similarity(F.lit("word"), F.lit("two words"))) == pytest.approx(4 / 11)
    assert value(spark, similarity.trigram_similarity(F.lit(""), F.lit(""))) == 0
    assert value(spark, similarity.token_sort_ratio(F.lit("b a"), F.lit("a b"))) == 100
    assert value(spark, similarity.indel_ratio(F.lit("abc"), F.lit("axc"))) == pytest.approx(200 * 2 / 6)
    pairs = spark.createDataFrame([("abc", "xxabcxx"), ("abcd", "abcd"), (None, "a")], "a string, b string")
    assert [r[0] for r in pairs.select(similarity.partial_ratio("a", "b")).collect()] == [100.0, 100.0, None]
    assert [r[0] for r in pairs.select(similarity.sequence_ratio("a", "b")).collect()][1:] == [1.0, None]


def test_rules(spark):
    assert value(spark, rules.severity(F.lit("Không nghiêm trọng"))) == "major"
    assert value(spark, rules.severity(F.lit(None).cast("string"))) == "unknown"
    assert value(spark, rules.high_alert(F.lit("major"))) is True
    assert value(spark, rules.shape_of_form(F.lit("Viên nang mềm"))) == "capsule"
    assert value(spark, rules.color_of_excipients(F.lit("Titan dioxyd, sắt oxyd đỏ"))) == "red"
    keep = ["Ginkgo Biloba Tanakan 40mg", "Paracetamol"]
    drop = ["10ml", "Viên sủi", "uống sau ăn", "12", "Bệnh viện A", "abc"]
    df = spark.createDataFrame([(t,) for t in keep + drop], "t string")
    assert [r.t for r in df.where(rules.likely_drug(F.col("t"))).collect()] == keep
    assert value(spark, rules.plausible_name(F.lit("Paracetamol"), F.lit(0.8))) is True
    assert value(spark, rules.plausible_name(F.lit("Paracetamol"), F.lit(0.7))) is False
    assert value(spark, rules.mapping_tier(F.lit(None).cast("string"), F.lit(0.9), F.lit(False))) == "unmapped_candidate"
    row = value(spark, rules.split_row(F.lit("1 | Para 500mg | x | 10 | viên")))
    assert (row.number, row.content, row.quantity, row.unit) == ("1", "Para 500mg x", "10", "viên")
    assert value(spark, rules.title_like(F.lit("Uống 2 viên"))) is False
    assert value(spark, rules.image_quality(F.lit(60), F.lit(0.0), F.lit(False))).state == "WARNING"
    assert value(spark, rules.phone_quality(F.lit(9), F.lit(0.0), F.lit(False), F.lit(2000))) == "REJECT"
    assert value(spark, rules.color_of_hsv(F.lit(100.0), F.lit(200.0), F.lit(200.0))) == "blue"
    assert value(spark, rules.shape_of_contour(F.lit(1.0), F.lit(0.9))) == "round"
    hints = rules.visual_hints(F.array(F.lit(" Red ")), F.lit("round"), F.lit("viên nén"))
    assert value(spark, rules.visual_adjustment(hints, F.lit("red"), F.lit("round"), F.lit("tablet"))) == pytest.approx(0.19)
    assert value(spark, rules.visual_reasons(hints, F.lit("red"), F.lit("round"), F.lit("tablet"))) == ["màu khớp: red", "dáng khớp: round", "dạng bào chế khớp: tablet"]
    assert value(spark, rules.visual_reasons(hints, F.lit("gray"), F.lit(None).cast("string"), F.lit("capsule"))) == ["dạng bào chế lệch: capsule"]
    assert [value(spark, rules.color_of_hsv(*map(F.lit, c))) for c in ((3.0, 99.0, 99.0), (175.0, 99.0, 99.0), (40.0, 99.0, 99.0), (160.0, 99.0, 99.0), (160.0, 20.0, 220.0), (160.0, 20.0, 100.0), (1.0, 99.0, 60.0))] == ["red", "red", "green", "pink", "white", "gray", "brown"]
    assert value(spark, rules.visual_adjustment(hints, F.lit("gray"), F.lit("capsule"), F.lit(None).cast("string"))) == pytest.approx(-0.03)


def test_numeric(spark):
    assert value(spark, numeric.clamp(F.lit(1.7))) == 1
    assert value(spark, numeric.quarter_angle(F.lit(-80.0))) == 10
    poly = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((5, 1), (9, 2), (8, 7), (4, 6))])
    assert value(spark, numeric.box_of(poly)) == [4, 1, 9, 7]
    assert value(spark, numeric.corners(poly)) == [[5, 1], [9, 2], [8, 7], [4, 6]]
    assert value(spark, numeric.number_or(F.lit("x"), 3.0)) == 3
    assert value(spark, numeric.is_json_list(F.lit("[1]"))) is True
    assert value(spark, numeric.is_json_list(F.lit("{"))) is False
    assert value(spark, numeric.json_or(F.lit("{bad"), "array<int>", F.array(F.lit(1)))) == [1]
    assert value(spark, numeric.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)))) == 11


def test_dates(spark):
    assert value(spark, dates.date_key(F.lit("2026-03-10"))) == date(2026, 3, 10)
    assert value(spark, dates.date_key(F.lit("2026-13-10"))) is None
    assert value(spark, dates.clock(F.lit("08:00:59"))) == "08:00"
    assert value(spark, dates.clock(F.lit("25:00"))) is None
    assert value(spark, dates.instant(F.lit("2026-03-10").cast("date"), F.lit("08:00")).cast("string")) == "2026-03-10 01:00:00"
    assert value(spark, dates.span_text(F.lit("7d"))) == 7 * 86400
    at, now = F.lit("2026-03-10 08:00:00").cast("timestamp"), F.lit("2026-03-10 08:45:00").cast("timestamp")
    assert value(spark, dates.effective_status(F.lit("pending"), at, now)) == "pending"
    assert value(spark, dates.effective_status(F.lit("pending"), at, now + F.expr("INTERVAL 1 SECOND"))) == "missed"
    assert value(spark, dates.due(at, now)) is True
    assert value(spark, dates.resolved_end(F.lit("2026-03-10").cast("date"), F.lit(None).cast("date"), F.lit(7))) == date(2026, 3, 16)
    assert value(spark, dates.occurrence_id(F.lit(" "), F.lit("P"), F.lit("2026-03-10 01:00:00").cast("timestamp"))) == "P:2026-03-10:08:00"
