"""Which body parts stand for the nose, the centre and the front of a mouse, by the parts that a table has.

A choice is made by available columns, not row by row, so that a plan has one expression for a whole bucket of videos.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column]


def point(part: str, prefix: str = "") -> Point:
    return F.col(f"{prefix}{part}_x"), F.col(f"{prefix}{part}_y")


def middle(a: Point, b: Point) -> Point:
    return (a[0] + b[0]) / 2, (a[1] + b[1]) / 2


def centre(parts: Iterable[str], prefix: str = "") -> Point | None:
    have = set(parts)
    for part in ("body_center", "neck"):
        if part in have:
            return point(part, prefix)
    for front in ("nose", "head"):
        if {front, "tail_base"} <= have:
            return middle(point(front, prefix), point("tail_base", prefix))
    return middle(point("ear_left", prefix), point("ear_right", prefix)) if {"ear_left", "ear_right"} <= have else None


def nose(parts: Iterable[str], prefix: str = "") -> Point | None:
    have = set(parts)
    for part in ("nose", "head"):
        if part in have:
            return point(part, prefix)
    return middle(point("ear_left", prefix), point("ear_right", prefix)) if {"ear_left", "ear_right"} <= have else None


def front_name(parts: Iterable[str]) -> str | None:
    """Name of the front anchor: `ears` is the middle of both."""
    have = set(parts)
    return "nose" if "nose" in have else "head" if "head" in have else "ears" if {"ear_left", "ear_right"} <= have else None


def ok(part: str, prefix: str = "") -> Column:
    x, y = point(part, prefix)
    return x.isNotNull() & y.isNotNull()


def nose_ok(parts: Iterable[str], prefix: str = "") -> Column:
    have = set(parts)
    for part in ("nose", "head"):
        if part in have:
            return ok(part, prefix)
    return ok("ear_left", prefix) & ok("ear_right", prefix) if {"ear_left", "ear_right"} <= have else F.lit(False)


def centre_ok(parts: Iterable[str], prefix: str = "") -> Column:
    have = set(parts)
    for part in ("body_center", "neck"):
        if part in have:
            return ok(part, prefix)
    for front in ("nose", "head"):
        if {front, "tail_base"} <= have:
            return ok(front, prefix) & ok("tail_base", prefix)
    return ok("ear_left", prefix) & ok("ear_right", prefix) if {"ear_left", "ear_right"} <= have else F.lit(False)
