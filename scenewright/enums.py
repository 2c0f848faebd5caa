"""Fixed vocabularies of scenes: sizes, relations, and the counts of number scenes."""

from __future__ import annotations

ATTRIBUTES = ("material", "color", "shape", "texture")

#: Half-extents in each axis, least and most, of a size category.
SIZES = dict(zip("largest large medium small smallest".split(), ((1.5, 1.8), (1.2, 1.5), (0.9, 1.2), (0.7, 0.9), (0.55, 0.7))))

#: Unit vectors (x, z) of the directions.
DIRECTIONAL = dict(zip("in front of|behind|to the left of|to the right of".split("|"), ((0, 1), (0, -1), (-1, 0), (1, 0))))
RADIAL = "beside|next to|near|far from|surrounding|at the center of".split("|")
VERTICAL = "on above below under".split()
RELATIONS = (*DIRECTIONAL, *RADIAL[:4], *VERTICAL, *RADIAL[4:])

#: Distance of a relation in sums of extents, least and most.
_REACH = """
    in front of 1.2 2.0; behind 1.2 2.0; to the left of 1.2 2.0; to the right of 1.2 2.0; beside 1.2 2.0; under 1.2 2.0
    next to 1.1 1.8; near 1.5 2.5; above 1.5 2.5; below 1.5 2.5; surrounding 2.0 3.0; far from 3.0 4.5; on 1 1; at the center of 0 0
"""
REACH = {" ".join(w): (float(a), float(b)) for *w, a, b in (x.split() for x in _REACH.replace("\n", ";").split(";") if x.strip())}

LEAST_OBJECTS, MOST_OBJECTS = 2, 9
BOUNDS, GAP, GROUND = 8.0, 0.05, 0.05


def count_splits() -> dict[int, list[tuple[int, ...]]]:
    """How so many objects split into kinds with one most and one least frequent kind.

    All splits into 2 kinds, all into 3 with a middle one, and, for 9, the one into 4.
    """
    made: dict[int, list[tuple[int, ...]]] = {}
    for n in range(3, MOST_OBJECTS + 1):
        two = [(a, n - a) for a in range(1, n) if a < n - a]
        three = [(a, b, n - a - b) for a in range(1, n) for b in range(a + 1, n) if b < n - a - b]
        made[n] = two + three + ([(1, 2, 2, 4)] if n == 9 else [])
    # the largest class of pairs is thinned where one kind would be nearly all
    made[7].remove((1, 6))
    made[8] = [s for s in made[8] if s not in ((1, 7), (2, 6))]
    made[9] = [s for s in made[9] if s not in ((1, 8), (2, 7), (3, 6))]
    return made
