"""Reading quantities from dosage texts.

Results are in one unit per kind: 'ug' for masses, 'ul' for volumes, 'iu' for
activity, 'ug/ml' or 'iu/ml' for an amount in a volume. Numbers: a comma is
the decimal mark; a dot is too, unless exactly three digits follow each dot,
when it groups thousands.
"""

from __future__ import annotations

import re
import unicodedata
from fractions import Fraction
from typing import NamedTuple

# Spellings of units (folded) with their kind and size in the kind's base unit.
UNITS = {
    "kg": ("mass", 10**9),
    "g": ("mass", 10**6),
    "gr": ("mass", 10**6),
    "gam": ("mass", 10**6),
    "gram": ("mass", 10**6),
    "grams": ("mass", 10**6),
    "mg": ("mass", 10**3),
    "mgr": ("mass", 10**3),
    "mgs": ("mass", 10**3),
    "miligam": ("mass", 10**3),
    "miligram": ("mass", 10**3),
    "milligram": ("mass", 10**3),
    "milligrams": ("mass", 10**3),
    "mcg": ("mass", 1),
    "ug": ("mass", 1),
    "microgam": ("mass", 1),
    "microgram": ("mass", 1),
    "micrograms": ("mass", 1),
    "l": ("volume", 10**6),
    "lit": ("volume", 10**6),
    "liter": ("volume", 10**6),
    "litre": ("volume", 10**6),
    "ml": ("volume", 10**3),
    "cc": ("volume", 10**3),
    "mililit": ("volume", 10**3),
    "milliliter": ("volume", 10**3),
    "millilitre": ("volume", 10**3),
    "ul": ("volume", 1),
    "microlit": ("volume", 1),
    "iu": ("activity", 1),
    "ui": ("activity", 1),
    "dvqt": ("activity", 1),
    "don vi quoc te": ("activity", 1),
    "don vi": ("activity", 1),
    "%": ("percent", 1),
}
MULTIPLIERS = {"trieu": 10**6, "nghin": 10**3, "ngan": 10**3}
BASE = {"mass": "ug", "volume": "ul", "activity": "iu"}

_UNIT = "|".join(sorted(map(re.escape, UNITS), key=len, reverse=True))
_NUMBER = r"\d+(?:[.,]\d+)*"
_TOKEN = re.compile(
    rf"(?<![a-z])(?P<number>{_NUMBER})\s*(?:(?P<times>{'|'.join(MULTIPLIERS)})\s*)?(?P<unit>(?:{_UNIT})(?![a-z]))?"
    rf"|(?<![a-z])(?P<bare>(?:{_UNIT})(?![a-z]))"
)
_SHARE = re.compile(r"\s*(?:[/+&,;-]|va|and)\s*")
_PER = re.compile(r"\s*(?:/|trong|per|in)\s*(?:moi\s*)?")
_BARE = re.compile(rf"\s*({_NUMBER})\s*")


class Quantity(NamedTuple):
    unit: str
    amount: int


def plain(text: str) -> str:
    """Folded text with micro signs as u and any white space as a space."""
    text = unicodedata.normalize("NFD", text.lower().replace("µ", "u").replace("μ", "u").replace("đ", "d"))
    return "".join(" " if c.isspace() else c for c in text if not unicodedata.combining(c))


def number(text: str) -> Fraction | None:
    """The value of a written number; None where the marks make no sense."""
    whole, comma, decimals = text.partition(",")
    if "," in decimals:
        return None
    groups = whole.split(".")
    if len(groups) > 1:
        if all(len(g) == 3 for g in groups[1:]) and groups[0].strip("0"):
            whole = "".join(groups)
        elif comma or len(groups) > 2:
            return None
        else:
            whole, decimals = groups
    if "." in decimals:
        return None
    return Fraction(f"{whole}.{decimals}" if decimals else whole)


def _whole(value: Fraction) -> int:
    return int(value + Fraction(1, 2))


def bare_number(text: str | None) -> Fraction | None:
    """The value of a text that is one number without a unit."""
    if text is None or not (m := _BARE.fullmatch(plain(text))):
        return None
    return number(m[1])


def of(value: Fraction, unit: str) -> Quantity:
    """``value`` of a written unit in the base unit of its kind."""
    kind, size = UNITS[unit]
    if kind == "percent":
        return Quantity("ug/ml", _whole(value * 10**4))
    return Quantity(BASE[kind], _whole(value * size))


def quantities(text: str | None) -> list[Quantity]:
    """The quantities of a text in order of writing; counts, drops, times and frequencies are none.

    Numbers joined by / + & and the like share the unit of the last; an amount followed by '/' or 'trong' and a volume
    is an amount in a volume. Null, blank and unit-less texts give an empty list.
    """
    if not text or not any(c.isdigit() for c in text):
        return []
    text = plain(text)
    tokens = list(_TOKEN.finditer(text))
    units: list[str | None] = [t["unit"] or t["bare"] for t in tokens]
    factors = [MULTIPLIERS.get(t["times"], 1) if t["number"] else 1 for t in tokens]
    for k in range(len(tokens) - 2, -1, -1):
        t, after = tokens[k], tokens[k + 1]
        if t["number"] and not units[k] and after["number"] and units[k + 1] and _SHARE.fullmatch(text, t.end(), after.start()):
            units[k], factors[k] = units[k + 1], factors[k] * (1 if t["times"] else factors[k + 1])
    found: list[Quantity] = []
    k = 0
    while k < len(tokens):
        t, unit = tokens[k], units[k]
        value = number(t["number"]) if t["number"] else None
        if value is None or not unit:
            k += 1
            continue
        kind, size = UNITS[unit]
        value *= factors[k]
        per = tokens[k + 1] if k + 1 < len(tokens) else None
        if per is not None and kind in ("mass", "activity") and units[k + 1] and UNITS[units[k + 1]][0] == "volume":
            volume = number(per["number"]) if per["number"] else Fraction(1)
            if volume and _PER.fullmatch(text, t.end(), per.start()):
                ml = volume * UNITS[units[k + 1]][1] / 1000
                found.append(Quantity(BASE[kind] + "/ml", _whole(value * size / ml)))
                k += 2
                continue
        found.append(of(value, unit))
        k += 1
    return found


def unit_beside(text: str | None, value: Fraction) -> str | None:
    """The unit that ``text`` writes beside the same number."""
    if not text:
        return None
    text = plain(text)
    for t in _TOKEN.finditer(text):
        if t["number"] and t["unit"] and number(t["number"]) == value:
            return t["unit"]
    return None


def unit_named(text: str | None) -> str | None:
    """The unit that ``text`` names without a number of its own. 'đơn vị' (unit) is a unit only where no other follows."""
    if not text:
        return None
    named = [t["bare"] for t in _TOKEN.finditer(plain(text)) if t["bare"]]
    return next((u for u in named if u != "don vi"), named[0] if named else None)
