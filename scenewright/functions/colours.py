"""Colours of points as expressions: closed forms of the usual scales, palettes by number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients, lowest power first, of polynomials of degree six for red, green and blue; they follow the tables of the scales to about a hundredth.
SCALES = {
    "viridis": (
        (0.2777273272234177, 0.1050930431085774, -0.3308618287255563, -4.634230498983486, 6.228269936347081, 4.776384997670288, -5.435455855934631),
        (0.005407344544966578, 1.404613529898575, 0.214847559468213, -5.799100973351585, 14.17993336680509, -13.74514537774601, 4.645852612178535),
        (0.3340998053353061, 1.384590162594685, 0.09509516302823659, -19.33244095627987, 56.69055260068105, -65.35303263337234, 26.3124352495832),
    ),
    "plasma": (
        (0.05873234392399702, 2.176514634195958, -2.689460476458034, 6.130348345893603, -11.10743619062271, 10.02306557647065, -3.658713842777788),
        (0.02333670892565664, 0.2383834171260182, -7.455851135738909, 42.3461881477227, -82.66631109428045, 71.41361770095349, -22.93153465461149),
        (0.5433401826748754, 0.7539604599784036, 3.110799939717086, -28.51885465332158, 60.13984767418263, -54.07218655560067, 18.19190778539828),
    ),
}
#: Points (value, red, green, blue) between which colours are linear.
RAMPS = {
    "hot": ((0.0, 0.0416, 0.0, 0.0), (0.365079, 1.0, 0.0, 0.0), (0.746032, 1.0, 1.0, 0.0), (1.0, 1.0, 1.0, 1.0)),
    "hsv": ((0.0, 1.0, 0.0, 0.0), (1 / 6, 1.0, 1.0, 0.0), (2 / 6, 0.0, 1.0, 0.0), (3 / 6, 0.0, 1.0, 1.0), (4 / 6, 0.0, 0.0, 1.0), (5 / 6, 1.0, 0.0, 1.0), (1.0, 1.0, 0.0, 0.09375)),
}


def _hex(text: str) -> list[tuple[float, ...]]:
    return [tuple(int(c[i : i + 2], 16) / 255 for i in (0, 2, 4)) for c in text.split()]


#: Soft colours for clusters, and strong ones for objects and clouds.
SOFT = _hex("8dd3c7 ffffb3 bebada fb8072 80b1d3 fdb462 b3de69 fccde5 d9d9d9 bc80bd ccebc5 ffed6f")
STRONG = _hex("e6194b 3cb44b 4363d8 f58231 911eb4 46f0f0 f032e6 bcf60c fabebe 008080")
GREY, GROUND = (0.5, 0.5, 0.5), (0.9, 0.9, 0.9)


def scale(value: Column, name: str) -> tuple[Column, Column, Column]:
    """Red, green and blue of a value in [0, 1]."""
    if name in SCALES:
        made = []
        for terms in SCALES[name]:
            c = F.lit(terms[-1])
            for t in reversed(terms[:-1]):
                c = c * value + F.lit(t)
            made.append(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))
        return tuple(made)
    points = RAMPS[name]
    made = []
    for k in (1, 2, 3):
        c = F.lit(points[-1][k])
        for a, b in reversed(list(zip(points, points[1:]))):
            c = F.when(value <= b[0], a[k] + (value - a[0]) / (b[0] - a[0]) * (b[k] - a[k])).otherwise(c)
        made.append(c)
    return tuple(made)


def scale_sql(value: str, name: str) -> tuple[str, ...]:
    """The same as SQL text."""
    if name in SCALES:
        made = []
        for terms in SCALES[name]:
            c = f"({terms[-1]!r})::DOUBLE"
            for t in reversed(terms[:-1]):
                c = f"({c} * {value} + ({t!r})::DOUBLE)"
            made.append(f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {c}))")
        return tuple(made)
    points = RAMPS[name]
    made = []
    for k in (1, 2, 3):
        c = f"{points[-1][k]!r}::DOUBLE"
        for a, b in reversed(list(zip(points, points[1:]))):
            c = f"CASE WHEN {value} <= {b[0]!r}::DOUBLE THEN {a[k]!r}::DOUBLE + ({value} - {a[0]!r}::DOUBLE) / ({b[0] - a[0]!r})::DOUBLE * ({b[k] - a[k]!r})::DOUBLE ELSE {c} END"
        made.append(c)
    return tuple(made)


def palette(number: Column, colours: list[tuple[float, ...]] = STRONG) -> tuple[Column, ...]:
    """Red, green and blue of the number's place in the palette, round and round."""
    at = F.pmod(number, F.lit(len(colours))).cast("int")
    return tuple(F.get(F.array(*[F.lit(float(c[k])) for c in colours]), at) for k in range(3))


def palette_sql(number: str, colours: list[tuple[float, ...]] = STRONG) -> tuple[str, ...]:
    return tuple("[" + ", ".join(f"{float(c[k])!r}::DOUBLE" for c in colours) + f"][({number}) % {len(colours)} + 1]" for k in range(3))
