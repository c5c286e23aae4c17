"""Numbers, vectors, boxes and tolerant JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, digits: int | None = None) -> Column:
    """Into [0, 1], rounded."""
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return inside if digits is None else F.round(inside, digits)


def dot(a: Column, b: Column) -> Column:
    """The dot product, summed in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, p: s + p)


def unit_vector(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") / F.sqrt(dot(v, v)))


def match_status(score: Column, assigned: float = 0.8, uncertain: float = 0.62) -> Column:
    return F.when(score >= assigned, "assigned").when(score >= uncertain, "uncertain").otherwise("unknown")


def quarter_angle(degrees: Column) -> Column:
    """An angle modulo 90 in [-45, 45)."""
    return F.pmod(degrees + 45, F.lit(90.0)) - 45


def number_or(text: Column, fallback: float | int) -> Column:
    """A number however it is written, else the fallback."""
    return F.coalesce(text.try_cast("double"), F.lit(fallback))


def box_of(polygon: Column) -> Column:
    """x1, y1, x2, y2 around a polygon of [x, y] corners."""
    xs, ys = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def shifted_box(box: Column, dx: Column, dy: Column) -> Column:
    return F.array(box[0] + dx, box[1] + dy, box[2] + dx, box[3] + dy)


def corners(points: Column) -> Column:
    """Four points as top left, top right, bottom right, bottom left."""
    by = lambda key: F.array_sort(points, lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0))
    total, skew = (lambda p: p[0] + p[1]), (lambda p: p[1] - p[0])
    return F.array(by(total)[0], by(skew)[0], by(total)[3], by(skew)[3])


def boxes_meet(a: Column, b: Column) -> Column:
    """Whether two boxes touch or overlap."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def json_or(text: Column, schema: str, fallback: Column) -> Column:
    """A parsed JSON text, the fallback where it is absent or broken."""
    parsed = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    return F.when(F.try_parse_json(text).isNotNull(), F.coalesce(parsed, fallback)).otherwise(fallback)


def is_json_list(text: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("ARRAY"), F.lit(False))
