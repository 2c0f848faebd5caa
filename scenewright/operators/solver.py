"""Placement of scene descriptions by rejection sampling: one description is solved in one place, many in parallel."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..enums import BOUNDS, DIRECTIONAL, GAP, GROUND, RADIAL, REACH, SIZES, VERTICAL

ATTEMPTS = 1000
Box = tuple[np.ndarray, np.ndarray]


def placement_order(names: list[str], relations: list[tuple[str, str, str]]) -> list[str]:
    """References before their subjects, first in first out; members of a cycle last, in their own order."""
    waits = dict.fromkeys(names, 0)
    after: dict[str, list[str]] = {n: [] for n in names}
    for subject, _, reference in relations:
        if subject in waits and reference in waits:
            after[reference].append(subject)
            waits[subject] += 1
    order = [n for n in names if not waits[n]]
    for n in order:  # grows as it goes
        for m in after[n]:
            waits[m] -= 1
            if not waits[m]:
                order.append(m)
    return order + [n for n in names if n not in set(order)]


def fits(at: np.ndarray, half: np.ndarray, placed: list[Box]) -> bool:
    """Whether a box is inside the bounds and meets no placed one, contact of stacked boxes aside."""
    if at[1] - half[1] < -GROUND or abs(at[0]) + half[0] > BOUNDS or abs(at[2]) + half[2] > BOUNDS:
        return False
    for centre, other in placed:
        away, reach = np.abs(at - centre), half + other
        over = away[0] < max(half[0], other[0]) and away[2] < max(half[2], other[2])
        if over and abs(away[1] - reach[1]) < 3 * GAP:
            continue
        if (away < reach + GAP).all():
            return False
    return True


def _around(rng, centre: np.ndarray, far: float) -> tuple[float, float]:
    turn = rng.uniform(0, 2 * math.pi)
    return centre[0] + math.cos(turn) * far, centre[2] + math.sin(turn) * far


def _beside(rng, centre: np.ndarray, spread: float) -> tuple[float, float]:
    dx, dz = rng.uniform(-1, 1, 2) * spread
    return centre[0] + dx, centre[2] + dz


def draw(rng, half: np.ndarray, upright: tuple[str, Box] | None, level: tuple[str, Box] | None) -> np.ndarray:
    """A position by the first vertical and the first horizontal or radial relation."""
    wide = max(half[0], half[2])
    y = half[1]
    if upright:
        kind, (centre, other) = upright
        if kind == "on":
            y = centre[1] + other[1] + half[1]
        else:
            rise = rng.uniform(*REACH[kind]) * (half[1] + other[1])
            if kind == "above":
                y = centre[1] + rise
    if level:
        kind, (centre, other) = level
        span = wide + max(other[0], other[2])
        if kind in DIRECTIONAL:
            far = rng.uniform(*REACH[kind]) * span
            dx, dz = DIRECTIONAL[kind]
            x, z = centre[0] + dx * far, centre[2] + dz * far
        elif kind == "at the center of":
            x, z = _beside(rng, centre, 0.2 * span)
        else:
            x, z = _around(rng, centre, rng.uniform(*REACH[kind]) * span)
    else:
        kind, (centre, other) = upright
        base = max(other[0], other[2])
        if kind == "on":
            room = 0.8 * max(0.0, base - wide)
            x, z = _around(rng, centre, rng.uniform(0, room)) if room > 0 else _beside(rng, centre, 0.2 * wide)
        elif kind == "above":
            x, z = _beside(rng, centre, 0.3 * base)
        else:
            x, z = _around(rng, centre, rng.uniform(1.2, 2.0) * (math.hypot(half[0], half[2]) + math.hypot(other[0], other[2])))
    return np.array([x, y, z])


def solve(objects: list[tuple[str, str, float]], relations: list[tuple[str, str, str]], seed: int, attempts: int = ATTEMPTS) -> list[tuple] | None:
    """(place_idx, name, x, y, z, hx, hy, hz, rotation) in the order of placement; None if an object finds no place."""
    rng = np.random.default_rng(seed)
    halves = {n: rng.uniform(*SIZES[size], 3) for n, size, _ in objects}
    turn = {n: r for n, _, r in objects}
    placed: dict[str, Box] = {}
    for name in placement_order([n for n, _, _ in objects], relations):
        own = [(k, ref) for s, k, ref in relations if s == name]
        upright = next(((k, ref) for k, ref in own if k in VERTICAL), None)
        level = next(((k, ref) for k, ref in own if k in DIRECTIONAL or k in RADIAL), None)
        if any(r and r[1] not in placed for r in (upright, level)):
            return None  # its reference comes in a cycle: no attempt could succeed
        bound = [r and (r[0], placed[r[1]]) for r in (upright, level)]
        half = halves[name]
        for _ in range(attempts):
            if upright or level:
                at = draw(rng, half, *bound)
            else:
                x, z = (rng.uniform(-(BOUNDS - half[c]), BOUNDS - half[c]) for c in (0, 2))
                at = np.array([x, half[1], z])
            if fits(at, half, list(placed.values())):
                placed[name] = (at, half)
                break
        else:
            return None
    return [(k, n, *map(float, at), *map(float, half), float(turn[n])) for k, (n, (at, half)) in enumerate(placed.items())]


LAYOUT = "template_id long, variant int, solved boolean, place_idx int, name string, x double, y double, z double, hx double, hy double, hz double, rotation double"


def solve_templates(templates: DataFrame, variants: int, seed: int, attempts: int = ATTEMPTS) -> DataFrame:
    """Layouts of ``templates`` (template_id, scene) as rows of placed objects; a failure is one row with ``solved`` false.

    The seed of a layout depends on the template and the variant only, so results don't depend on partitions.
    """
    rows = templates.select(F.col("template_id").cast("long").alias("template_id"), "scene.objects", "scene.relations", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))).alias("variant"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                objects = [(o["name"], o["size"], o["rotation"]) for o in r.objects]
                relations = [(x["subject"], x["relation"], x["reference"]) for x in r.relations]
                made = solve(objects, relations, seed + int(r.template_id) * 1000 + int(r.variant), attempts)
                if made is None:
                    out.append((r.template_id, r.variant, False, None, None, *[None] * 7))
                else:
                    out += [(r.template_id, r.variant, True, *m) for m in made]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in LAYOUT.split(", ")])

    return rows.mapInPandas(each, LAYOUT)
