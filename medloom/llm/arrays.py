"""Vectorised text primitives for Arrow batches: code points, folding, words, rolling hashes."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in one array, and where each text starts (with the end appended)."""
    parts = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    starts = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) // 4 for p in parts], out=starts[1:])
    return np.frombuffer(b"".join(parts), dtype=np.uint32), starts


def chunks(texts: Sequence[str], most: int) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` with about ``most`` characters each."""
    start, held = 0, 0
    for k, t in enumerate(texts):
        if held and held + len(t) > most:
            yield start, k
            start, held = k, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def _power(which: str, n: int) -> np.ndarray:
    """The first ``n`` powers of the hash base, or of its inverse, modulo 2**64."""
    if len(_powers.get(which, ())) < n:
        base = _BASE if which == "up" else _INVERSE
        steps = np.full(max(n, 1 << 16), base, dtype=U64)
        steps[0] = 1
        _powers[which] = np.cumprod(steps, dtype=U64)
    return _powers[which][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash: those of any range follow from two of them (``range_hashes``)."""
    values = codes.astype(U64) + U64(0x632BE59BD9B4E019)
    values ^= values << U64(23)
    values *= U64(0xD6E8FEB86659FD93)
    out = np.zeros(len(codes) + 1, dtype=U64)
    np.cumsum(values * _power("up", len(codes)), out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [start, end): equal for equal contents wherever they lie."""
    return mix((prefix[end] - prefix[start]) * _power("down", len(prefix))[start])


def _folded(code: int) -> int:
    """One code point without case and diacritics: 0 for a separator, 1 for a mark that goes."""
    c = chr(code)
    if unicodedata.combining(c):
        return 1
    low = c.lower()
    if low[:1] == "đ":
        return ord("d")
    base = "".join(x for x in unicodedata.normalize("NFD", low) if not unicodedata.combining(x))
    if len(base) == 1 and base.isalnum():
        return ord(base)
    return code if c.isalnum() else 0


_TABLE = np.array([_folded(c) for c in range(0x3000)], dtype=np.uint32)


def fold_codes(codes: np.ndarray) -> np.ndarray:
    """Folded code points (see ``_folded``)."""
    low = codes < len(_TABLE)
    out = _TABLE[np.where(low, codes, 0)]
    if not low.all():
        high, back = np.unique(codes[~low], return_inverse=True)
        out[~low] = np.array([_folded(int(c)) for c in high], dtype=np.uint32)[back]
    return out


def words(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's words start (with the end appended).

    Words are runs of letters and digits, without case and diacritics.
    """
    codes, starts = code_points(texts)
    folded = fold_codes(codes)
    kept = folded != 1
    before = np.concatenate([[0], np.cumsum(kept)])
    folded, starts = folded[kept], before[starts]
    inside = folded != 0
    edge = np.zeros(len(folded) + 1, dtype=bool)
    edge[starts] = True
    shifted = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
    first = np.flatnonzero(inside & (~shifted | edge[:-1]))
    following = np.concatenate([inside[1:], [False]]) if len(inside) else inside
    last = np.flatnonzero(inside & (~following | edge[1:])) + 1
    return range_hashes(prefix_hashes(folded), first, last), np.searchsorted(first, starts)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the rightmost least value in each window of ``width``."""
    n = len(values) - width + 1
    best, at = values, np.arange(len(values), dtype=np.int64)
    span = 1
    while span < width:
        step = min(span, width - span)
        m = len(best) - step
        right = best[step:] <= best[:m]
        at = np.where(right, at[step:], at[:m])
        best = np.where(right, best[step:], best[:m])
        span += step
    return at[:n]
