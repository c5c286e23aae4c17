"""Text normalisation, as plain functions (for Arrow batches) and as Columns."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_MARKS = re.compile("[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]+")


def fold(text: str) -> str:
    """Lower case without diacritics; đ is d."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFD", text.lower())
    return _MARKS.sub("", text).replace("đ", "d")


def _accented() -> tuple[str, str]:
    """The precomposed small Latin letters and their base letters."""
    letters = [chr(c) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(c, fold(c)) for c in letters if c == c.lower()]
    pairs = [(c, base) for c, base in pairs if len(base) == 1 and base.isascii()]
    return "".join(c for c, _ in pairs), "".join(base for _, base in pairs)


_FROM, _TO = _accented()


def fold_col(text: Column) -> Column:
    """``fold`` on the JVM side, for Latin letters: precomposed ones map to their base, combining marks go."""
    return F.regexp_replace(F.translate(F.lower(text), _FROM, _TO), r"\p{Mn}+", "")


def name_key(text: Column) -> Column:
    """Words of a-z and 0-9 with one space between, without diacritics and case."""
    return F.trim(F.regexp_replace(fold_col(text), "[^a-z0-9]+", " "))


def strip_accents_col(text: Column) -> Column:
    """Diacritics removed, case kept (đ is d, Đ is D)."""
    upper = "".join(c.upper() if len(c.upper()) == 1 else c for c in _FROM)
    both, base = _FROM + upper, _TO + "".join(b.upper() if len(c.upper()) == 1 else b for c, b in zip(_FROM, _TO))
    return F.regexp_replace(F.translate(text, both, base), r"\p{Mn}+", "")


def squeeze(text: Column) -> Column:
    """Trimmed, with single spaces."""
    return F.trim(F.regexp_replace(text, r"[\s\x{00a0}]+", " "))


def ascii_key(text: Column) -> Column:
    """Only a-z and 0-9 of the lower-cased text; accented letters are dropped, not folded."""
    return F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]", "")


def first_filled(*columns: Column | str) -> Column:
    """The first value that is not blank, trimmed; '' where all are."""
    trimmed = [F.trim(F.col(c) if isinstance(c, str) else c) for c in columns]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in trimmed], F.lit(""))


def pair_key(a: Column, b: Column) -> Column:
    """Two keys in order, joined by ' || '; empty ones are left out."""
    return F.array_join(F.array_sort(F.filter(F.array(a, b), lambda k: k.isNotNull() & (k != ""))), " || ")


def split_list(text: Column, pattern: str = r"[;,/]|\s{2,}") -> Column:
    """The trimmed, non-empty parts of a delimited text."""
    return F.filter(F.transform(F.split(text, pattern), F.trim), lambda p: p != "")


# Words and units that a name search leaves out.
QUERY_STOP = ("mg", "ml", "vi", "x", "hop", "goi", "vien", "thuoc")
ROOT_STOP = ("", "mg", "ml", "mcg", "g", "iu", "tab", "cap", "viên", "ống", "lọ", "chai", "gói", "sủi", "thuốc", "và", "the", "for")
DOSAGE_NOISE = ("mg", "ml", "mcg", "g", "ug", "10", "20", "40", "50", "80", "100", "200", "250", "300", "400", "500", "750", "800", "1000", "1500", "tablet", "capsule", "vien", "ong", "goi", "chai")


def query_tokens(text: Column) -> Column:
    """Words of the folded text without stop words and numbers of one or two digits."""
    return F.filter(F.split(name_key(text), " "), lambda t: (t != "") & ~t.isin(*QUERY_STOP) & ~t.rlike(r"^\d{1,2}$"))


def root_tokens(text: Column) -> Column:
    """Words of at least three letters that are no units, forms or stop words."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda t: ~t.isin(*ROOT_STOP) & (F.length(t) >= 3))


def significant_tokens(text: Column) -> Column:
    """ASCII words without dosage noise."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: (t != "") & ~t.isin(*DOSAGE_NOISE))


def shares_root(a: Column, b: Column) -> Column:
    """Whether two names have a meaningful word in common."""
    return F.arrays_overlap(root_tokens(a), root_tokens(b))


def strength_tokens(text: Column) -> Column:
    """Distinct 'number unit' tokens, with a decimal point."""
    pattern = r"(\d+(?:[.,]\d+)?)\s*(mg|ml|mcg|g|iu)"
    low = F.lower(text)
    numbers, units = (F.regexp_extract_all(low, F.lit(pattern), F.lit(k)) for k in (1, 2))
    return F.array_distinct(F.zip_with(numbers, units, lambda n, u: F.concat(F.replace(n, F.lit(","), F.lit(".")), F.lit(" "), u)))


def strength_fits(a: Column, b: Column) -> Column:
    """True where either side names no strength, or both share one."""
    x, y = strength_tokens(a), strength_tokens(b)
    return (F.size(x) == 0) | (F.size(y) == 0) | F.arrays_overlap(x, y)


def clean_scanned(text: Column) -> Column:
    """A scanned name without quantities and edge numbers, lower-cased."""
    bare = F.regexp_replace(text, r"(?iU)\b\d+\s*(mg|ml|tab|cap|iu|mcg|g|viên|ống|lọ)?\b", " ")
    return F.lower(squeeze(F.regexp_replace(F.regexp_replace(bare, r"^\d{1,3}\s+", ""), r"\s+\d{1,3}$", "")))


def in_parentheses(text: Column) -> Column:
    return F.trim(F.regexp_extract(text, r"\(([^)]*)\)", 1))


def without_parentheses(text: Column) -> Column:
    return squeeze(F.regexp_replace(text, r"\([^)]*\)", " "))


def list_number(text: Column) -> Column:
    """The leading number of a list line ('3) ...', '3. ...', '3 ...'); '' without one."""
    return F.regexp_extract(text, r"^\s*(\d+)(?:[).\-]|(?=\s))", 1)


def without_list_number(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"^\s*\d+(?:[).\-]|(?=\s))\s*", ""))


# What containment, each shared word, the first word and a short address add to the fit of an address.
SLUG_POINTS = {"contains": 4.0, "word": 1.4, "first": 0.8, "short": 0.4}


def slug_score(query: Column, url: Column) -> Column:
    """How well a product address fits a query: containment, shared words, first word, compactness."""
    slug = name_key(F.regexp_replace(F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1), r"\.html?$", ""))
    asked = query_tokens(query)
    has = F.split(slug, " ")
    shared = F.size(F.filter(asked, lambda t: F.array_contains(has, t)))
    first = F.coalesce(F.array_contains(has, F.try_element_at(asked, F.lit(1))), F.lit(False))
    score = (
        F.when(slug.contains(name_key(query)), SLUG_POINTS["contains"]).otherwise(0.0)
        + shared * SLUG_POINTS["word"]
        + F.when(first, SLUG_POINTS["first"]).otherwise(0.0)
        + F.when((shared > 0) & (F.size(has) <= F.size(asked) + 6), SLUG_POINTS["short"]).otherwise(0.0)
    )
    return F.when(F.size(asked) == 0, 0.0).otherwise(F.round(score, 4))


def file_stem(text: Column, longest: int = 60) -> Column:
    """A text made safe for file names and cut."""
    return F.substring(F.regexp_replace(text, r"[^\p{L}\p{N}._-]+", "_"), 1, longest)


def truncated(text: Column, longest: int = 500) -> Column:
    """A text cut to ``longest`` characters, the last three of them dots."""
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest - 3), F.lit("..."))).otherwise(text)


def frequency_label(slots: Column) -> Column:
    """How often a day, by the number of slots."""
    return F.when(slots == 1, "daily").when(slots == 2, "twice daily").when(slots == 3, "three times daily").otherwise(F.concat(slots.cast("string"), F.lit(" times daily")))


def number_in(text: Column) -> Column:
    """The first number of a text."""
    return F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
