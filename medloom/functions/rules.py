"""Ordered rule cascades over texts and metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from medloom.functions.text import name_key, squeeze

# Severity classes by the first rule that holds, in this order; rank is the place in the list.
SEVERITY = {
    "contraindicated": ("chong chi dinh", "contraindicated", "khong duoc khuyen cao"),
    "major": ("nghiem trong", "major", "nguy co cao"),
    "moderate": ("trung binh", "moderate"),
    "minor": ("nhe", "minor"),
    "caution": ("than trong", "khong nen phoi hop", "khong nen dung", "khong khuyen cao", "can phai chu y", "nen tranh", "can can nhac", "can xem xet", "caution"),
    "unknown": (),
}
# Dosage form to shape, first match in this order.
SHAPES = {
    "viên nén": "round",
    "viên nén dài": "oblong",
    "viên nén bao phim": "oval",
    "viên nén bao đường": "round",
    "viên nén sủi": "round",
    "viên nén phân tán": "round",
    "viên nén nhai": "round",
    "viên nang cứng": "capsule",
    "viên nang mềm": "capsule",
    "viên nang": "capsule",
    "viên bao phim": "oval",
    "viên bao đường": "round",
    "thuốc cốm": "granule",
    "thuốc bột": "powder",
    "dung dịch": "liquid",
    "hỗn dịch": "liquid",
    "siro": "liquid",
    "nhũ tương": "liquid",
    "thuốc tiêm": "injection",
    "thuốc nhỏ mắt": "eye drops",
    "thuốc nhỏ mũi": "nasal drops",
    "thuốc mỡ": "ointment",
    "kem bôi": "cream",
    "gel bôi": "gel",
    "thuốc đặt": "suppository",
    "thuốc dán": "patch",
    "nén": "round",
    "nang": "capsule",
}
# Colorants named among excipients, with their color.
COLORANTS = {
    "titan dioxyd": "white",
    "titanium dioxide": "white",
    "titan dioxide": "white",
    "erythrosin": "red",
    "ponceau 4r": "red",
    "allura red": "red",
    "màu đỏ": "red",
    "sắt oxyd đỏ": "red",
    "red iron oxide": "red",
    "ferric oxide red": "red",
    "iron oxide red": "red",
    "iron oxide black": "black",
    "ferrosoferric oxide": "black",
    "sắt oxyd vàng": "yellow",
    "iron oxide yellow": "yellow",
    "yellow iron oxide": "yellow",
    "quinoline yellow": "yellow",
    "sunset yellow": "orange",
    "tartrazine": "yellow",
    "indigotine": "blue",
    "indigo carmine": "blue",
    "brilliant blue": "blue",
    "patent blue": "blue",
    "màu xanh": "blue",
    "chlorophyll": "green",
    "màu nâu": "brown",
    "chocolate": "brown",
    "caramel": "brown",
}
# What tells a scanned line from a drug name.
USAGE_WORDS = r"uống|ngày\s+\d|lần\s*,|sau\s*ăn|trước\s*ăn|sáng\s+uống|trưa\s+uống|tối\s+uống|mỗi\s+lần|hòa\s+tan|nhỏ\s+mắt"
HEADER_WORDS = r"đơn\s+thuốc|bhyt|bệnh\s+viện|phòng\s+khám|họ\s+tên|giới\s+tính|địa\s+chỉ|chẩn\s+đoán|thuốc\s+điều\s+trị|mã\s+số|số\s+phiếu|bộ\s+y\s+tế|sở\s+y\s+tế|xem\s+tiếp"
INSTRUCTION_STARTS = ("ngày uống", "uống ", "mỗi ", "sau ăn", "trước ăn", "khi đau", "buổi sáng", "buổi tối")
FORM_WORDS = ("viên", "ống", "gói", "chai", "lọ")
REJECTED_PHRASES = ("ngày uống", "buổi sáng", "buổi tối", "sau ăn", "trước ăn", "viên", "ống", "lọ")


def cascade(rules: list[tuple[Column, object]], otherwise: object) -> Column:
    """The value of the first condition that holds."""
    out = F.when(rules[0][0], rules[0][1])
    for condition, value in rules[1:]:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


def severity(text: Column) -> Column:
    key = F.coalesce(name_key(text), F.lit(""))
    rules = [(reduce(Column.__or__, [key.contains(w) for w in words]), name) for name, words in SEVERITY.items() if words]
    return cascade(rules, "unknown")


def severity_rank(name: Column) -> Column:
    return cascade([(name == s, k) for k, s in enumerate(SEVERITY)], len(SEVERITY) - 1)


def high_alert(name: Column) -> Column:
    return severity_rank(name) <= 1


def shape_of_form(form: Column) -> Column:
    low = F.lower(F.trim(form))
    return cascade([(low.contains(k), v) for k, v in SHAPES.items()], "")


def color_of_excipients(text: Column) -> Column:
    """The one color named; of several the first that is not white."""
    low = F.lower(text)
    found = F.array_distinct(F.array_compact(F.array(*[F.when(low.contains(k), v) for k, v in COLORANTS.items()])))
    other = F.filter(found, lambda c: c != "white")
    return F.when(F.size(found) == 0, "").when(F.size(found) == 1, found[0]).otherwise(F.coalesce(F.try_element_at(other, F.lit(1)), F.lit("white")))


# Lines that are no drug names: whole lines, a bare number, a form with a count, a dosage.
NOT_NAMES = ("viên sủi", "vien sui")
NUMBER_LINE = r"^[\d\s.,]+$"
FORM_LINE = r"(?iu)^(viên\s+sủi|viên|ống|lọ|tab|gói)(\s+[\d\s]*)?$"
DOSAGE_LINE = r"(?i)^[\d\s.,]*(mg|ml|mcg|g|iu)\b"


def likely_drug(text: Column) -> Column:
    """Whether a scanned line can be a drug name, rather than usage, a number, a unit, a dosage or a header."""
    t = F.trim(F.coalesce(text, F.lit("")))
    bad = (
        (F.length(t) < 4)
        | F.lower(t).isin(*NOT_NAMES)
        | t.rlike(f"(?iu)({USAGE_WORDS})")
        | t.rlike(NUMBER_LINE)
        | t.rlike(FORM_LINE)
        | t.rlike(DOSAGE_LINE)
        | t.rlike(f"(?iu)({HEADER_WORDS})")
    )
    return ~bad


def plausible_name(text: Column, confidence: Column, least: float = 0.75) -> Column:
    """A likely drug name, read with confidence, that holds a word with a letter and is no stock phrase."""
    t = squeeze(text)
    words = F.exists(F.split(t, r"[^A-Za-zÀ-ỹ0-9]+"), lambda w: w.rlike(r"\p{L}"))
    return F.coalesce((confidence >= least) & (F.length(t) >= 4) & likely_drug(t) & words & ~F.lower(t).isin(*REJECTED_PHRASES), F.lit(False))


def mapping_tier(name: Column, score: Column, plausible: Column) -> Column:
    sure = name.isNotNull() & (score >= 0.85)
    return F.when(sure, "confirmed").when((score >= 0.65) | plausible, "unmapped_candidate").otherwise("rejected_noise")


def instruction_like(text: Column) -> Column:
    low = F.lower(squeeze(F.coalesce(text, F.lit(""))))
    return reduce(Column.__or__, [low.startswith(w) for w in INSTRUCTION_STARTS])


def title_like(text: Column) -> Column:
    """Whether a text block can be the title of a drug row."""
    t = squeeze(F.coalesce(text, F.lit("")))
    short_number = t.rlike(r"^\d") & (F.size(F.split(t, " ")) <= 2)
    return (t != "") & ~instruction_like(t) & t.rlike(r"\p{L}") & ~F.lower(t).isin(*FORM_WORDS) & ~short_number


def split_row(text: Column) -> Column:
    """number, content, quantity and unit of a ' | ' separated line."""
    p = F.transform(F.split(text, r" \| "), F.trim)
    n = F.size(p)
    content = F.when(n >= 4, F.array_join(F.slice(p, 2, F.greatest(n - 3, F.lit(0))), " ")).when(n == 3, p[1]).otherwise(text)
    return F.struct(
        F.when(n >= 3, p[0]).alias("number"),
        content.alias("content"),
        F.when(n >= 4, F.element_at(p, -2)).when(n == 3, p[2]).alias("quantity"),
        F.when(n >= 4, F.element_at(p, -1)).alias("unit"),
    )


# Colors by hue (from, below), saturation (at most) and value (from, at most); the first that fits, else pink.
HSV = (
    ("white", None, None, 35, 210, None),
    ("brown", None, None, None, None, 70),
    ("gray", None, None, 35, None, None),
    ("red", None, 8, None, None, None),
    ("red", 172, None, None, None, None),
    ("orange", None, 18, None, None, None),
    ("yellow", None, 35, None, None, None),
    ("green", None, 78, None, None, None),
    ("blue", None, 120, None, None, None),
    ("purple", None, 150, None, None, None),
)
# Shapes by aspect (from, at most) and circularity (from); the first that fits, else tablet.
CONTOURS = (("capsule", 1.85, None, 0.65), ("round", None, 1.2, 0.82), ("oblong", 1.35, None, None))
# Sharpness below, and glare above, which an image is rejected or warned of.
IMAGE_LIMITS = {"reject_blur": 55, "reject_glare": 0.22, "warn_blur": 90, "warn_glare": 0.12}
# The same of the phone's own gate, by edge strength; cut images need more, short sides are warned of.
PHONE_LIMITS = {"reject_edge": 10, "reject_edge_cut": 14, "reject_glare": 0.2, "warn_edge": 16, "warn_glare": 0.1, "warn_side": 1000}


def _all(*conditions: Column | None) -> Column:
    return reduce(Column.__and__, [c for c in conditions if c is not None], F.lit(True))


def color_of_hsv(hue: Column, sat: Column, val: Column) -> Column:
    bound = lambda limit, test: None if limit is None else test(limit)
    fits = lambda r: _all(bound(r[1], hue.__ge__), bound(r[2], hue.__lt__), bound(r[3], sat.__le__), bound(r[4], val.__ge__), bound(r[5], val.__le__))
    return cascade([(fits(row), row[0]) for row in HSV], "pink")


def shape_of_contour(aspect: Column, circularity: Column) -> Column:
    bound = lambda limit, test: None if limit is None else test(limit)
    return cascade([(_all(bound(low, aspect.__ge__), bound(high, aspect.__le__), bound(least, circularity.__ge__)), name) for name, low, high, least in CONTOURS], "tablet")


def image_quality(blur: Column, glare: Column, cut: Column) -> Column:
    """GOOD, WARNING or REJECT, with the reason."""
    t = IMAGE_LIMITS
    blurred, glaring = blur < t["reject_blur"], glare > t["reject_glare"]
    state = cascade([(blurred | glaring, "REJECT"), (cut | (blur < t["warn_blur"]) | (glare > t["warn_glare"]), "WARNING")], "GOOD")
    reason = cascade([(blurred, "BLURRY_IMAGE"), (glaring, "GLARE_IMAGE"), (cut, "CONTENT_CUTOFF")], F.lit(None).cast("string"))
    return F.struct(state.alias("state"), reason.alias("reason"))


def phone_quality(edge: Column, glare: Column, cut: Column, side: Column) -> Column:
    """The phone's own, coarser gate."""
    t = PHONE_LIMITS
    reject = (edge < t["reject_edge"]) | (glare > t["reject_glare"]) | (cut & (edge < t["reject_edge_cut"]))
    return F.when(reject, "REJECT").when((edge < t["warn_edge"]) | (glare > t["warn_glare"]) | (side < t["warn_side"]), "WARNING").otherwise("GOOD")


def visual_hints(colors: Column, shape_text: Column, form: Column) -> Column:
    """Lower-cased colors, shape hints and the dosage-form hint of a product's metadata."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    has = lambda t, *words: reduce(Column.__or__, [t.contains(w) for w in words])
    each = lambda t: F.array(
        F.when(has(t, "capsule", "viên nang"), "capsule"),
        F.when(has(t, "oblong", "oval", "caplet"), "oblong"),
        F.when(has(t, "round", "tròn"), "round"),
        F.when(has(t, "tablet", "viên nén", "coated"), "tablet"),
    )
    shapes = F.array_distinct(F.array_compact(F.concat(each(low(shape_text)), each(low(form)))))
    kind = F.when(has(low(form), "capsule", "viên nang"), "capsule").when(has(low(form), "tablet", "viên nén", "coated"), "tablet")
    clean = F.filter(F.transform(F.coalesce(colors, F.array().cast("array<string>")), lambda c: F.lower(F.trim(c))), lambda c: c != "")
    return F.struct(clean.alias("colors"), shapes.alias("shapes"), kind.alias("form"))


# What an agreement or difference of seen and listed color, shape and form adds to a match score, and how it is
# worded ('{}' is what was seen).
OUTCOMES = {
    "color": {"same": (0.08, "màu khớp: {}"), "other": (-0.04, "màu lệch: {}")},
    "shape": {"same": (0.06, "dáng khớp: {}"), "near capsule": (0.02, "dáng gần giống capsule"), "near tablet": (0.01, "dáng gần giống viên nén"), "other": (-0.03, "dáng lệch: {}")},
    "form": {"same": (0.05, "dạng bào chế khớp: {}"), "other": (-0.05, "dạng bào chế lệch: {}")},
}


def _outcomes(hints: Column, color: Column, shape: Column, form: Column) -> dict[str, tuple[Column, Column]]:
    """Per aspect how seen and listed compare (null where either is unknown or the difference says nothing), and what was seen."""
    colors, shapes, kind = hints["colors"], hints["shapes"], hints["form"]
    by_color = F.when((F.size(colors) > 0) & color.isNotNull(), F.when(F.array_contains(colors, color), "same").when(~color.isin("gray", "white"), "other"))
    near = F.when((shape == "oblong") & F.array_contains(shapes, "capsule"), "near capsule").when((shape == "tablet") & F.array_contains(shapes, "round"), "near tablet")
    by_shape = F.when((F.size(shapes) > 0) & shape.isNotNull(), F.when(F.array_contains(shapes, shape), "same").otherwise(F.coalesce(near, F.lit("other"))))
    by_form = F.when(form.isNotNull() & kind.isNotNull(), F.when(form == kind, "same").otherwise("other"))
    return {"color": (by_color, color), "shape": (by_shape, shape), "form": (by_form, form)}


def visual_adjustment(hints: Column, color: Column, shape: Column, form: Column) -> Column:
    """What seen color, shape and form add to or take from a match score; nothing where either side is unknown."""
    found = _outcomes(hints, color, shape, form)
    points = [cascade([(found[aspect][0] == name, p) for name, (p, _) in table.items()], 0.0) for aspect, table in OUTCOMES.items()]
    return F.round(reduce(Column.__add__, points), 4)


def visual_reasons(hints: Column, color: Column, shape: Column, form: Column) -> Column:
    """Why a score is adjusted, in words; empty where nothing is known."""
    found = _outcomes(hints, color, shape, form)
    none = F.lit(None).cast("string")
    said = [cascade([(found[aspect][0] == name, F.replace(F.lit(words), F.lit("{}"), found[aspect][1])) for name, (_, words) in table.items()], none) for aspect, table in OUTCOMES.items()]
    return F.array_compact(F.array(*said))
