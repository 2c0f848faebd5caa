"""Expressions over scene objects: distance, volume, direction, placeholders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_distance(a, b) -> Column:
    """Squared distance of two positions (struct fields px, py, pz); orders like the distance."""
    dx, dy, dz = (a[c] - b[c] for c in ("px", "py", "pz"))
    return dx * dx + dy * dy + dz * dz


def volume(o) -> Column:
    """Volume of the box with half-extents hx, hy, hz."""
    return F.lit(8.0) * o["hx"] * o["hy"] * o["hz"]


def direction(target, reference) -> Column:
    """Where the target is, by the axis of the largest difference; the first of x, y, z on ties, zero counts as negative."""
    dx, dy, dz = (target[c] - reference[c] for c in ("px", "py", "pz"))
    ax, ay, az = F.abs(dx), F.abs(dy), F.abs(dz)
    return (
        F.when((ax >= ay) & (ax >= az), F.when(dx > 0, "to the right of").otherwise("to the left of"))
        .when(ay >= az, F.when(dy > 0, "above").otherwise("below"))
        .otherwise(F.when(dz > 0, "in front of").otherwise("behind"))
    )


def fill_placeholders(template: Column, names: Column) -> Column:
    """Put the names (array of struct placeholder, name) in place of ``[placeholder]``, one after another."""
    return F.aggregate(names, template, lambda text, o: F.replace(text, F.concat(F.lit("["), o["placeholder"], F.lit("]")), o["name"]))


def abstract_names(text: Column, names: Column) -> Column:
    """Put ``[obj_i]`` in place of each whole-word occurrence of the i-th name, any case, in the order of the names.

    Names are escaped for the regular expression; word boundaries are Java's, so use ASCII names where engines are compared.
    """
    quoted = lambda n: F.regexp_replace(n, r"([\\\^\$\.\|\?\*\+\(\)\[\]\{\}])", r"\\$1")
    pairs = F.transform(names, lambda n, i: F.struct(quoted(n).alias("q"), i.alias("i")))
    return F.aggregate(pairs, text, lambda t, p: F.regexp_replace(t, F.concat(F.lit(r"(?i)\b"), p["q"], F.lit(r"\b")), F.concat(F.lit("[obj_"), p["i"].cast("string"), F.lit("]"))))


def option_labels(choices: Column) -> Column:
    """``(A) text``, ``(B) text`` and so on."""
    return F.transform(choices, lambda c, i: F.concat(F.lit("("), F.char(i + 65), F.lit(") "), c))


def category(kind: Column, distance_type: Column) -> Column:
    """The task category: the kind, an underscore, and the distance type if there is one."""
    return F.concat(kind, F.lit("_"), F.coalesce(distance_type, F.lit("")))


def plain_category(kind: Column, distance_type: Column) -> Column:
    """The category without a trailing underscore; ``unknown`` without a kind."""
    known = F.coalesce(distance_type, F.lit("")) != ""
    return F.when(F.coalesce(kind, F.lit("")) == "", "unknown").otherwise(F.when(known, F.concat(kind, F.lit("_"), distance_type)).otherwise(kind))
