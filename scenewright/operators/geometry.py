"""Boxes and point clouds as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..enums import BOUNDS, GAP, GROUND
from .numbering import few


def in_bounds() -> Column:
    """Whether the box x, y, z, hx, hy, hz is above ground and inside the scene."""
    return (F.col("y") - F.col("hy") >= -GROUND) & (F.abs("x") + F.col("hx") <= BOUNDS) & (F.abs("z") + F.col("hz") <= BOUNDS)


def collisions(boxes: DataFrame) -> DataFrame:
    """(scene_id, idx_a, idx_b): pairs of boxes of a scene that overlap, unless one is stacked on the other."""
    side = lambda p: boxes.select("scene_id", *[F.col(c).alias(p + c) for c in ("idx", "x", "y", "z", "hx", "hy", "hz")])
    p = side("a_").join(side("b_"), "scene_id").filter("a_idx < b_idx")
    away = {c: F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in "xyz"}
    reach = {c: F.col(f"a_h{c}") + F.col(f"b_h{c}") for c in "xyz"}
    meet = (away["x"] < reach["x"] + GAP) & (away["y"] < reach["y"] + GAP) & (away["z"] < reach["z"] + GAP)
    over = (away["x"] < F.greatest("a_hx", "b_hx")) & (away["z"] < F.greatest("a_hz", "b_hz"))
    stacked = over & (F.abs(away["y"] - reach["y"]) < GAP * 3)
    return p.filter(meet & ~stacked).select("scene_id", F.col("a_idx").alias("idx_a"), F.col("b_idx").alias("idx_b"))


def cloud_bounds(points: DataFrame) -> DataFrame:
    """One row a cloud: points, least and greatest coordinates, and extents."""
    made = points.groupBy("cloud_id").agg(F.count("*").alias("n_points"), *[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])
    return made.select("*", *[(F.col(f"max_{c}") - F.col(f"min_{c}")).alias(f"extent_{c}") for c in "xyz"])


def normalize(points: DataFrame) -> DataFrame:
    """Each cloud moved and scaled to [-0.5, 0.5] in each axis; an extent of 1e-6 or less counts as 1."""
    b = cloud_bounds(points).drop("n_points")
    j = points.join(b, "cloud_id")
    one = lambda c: (F.col(c) - F.col(f"min_{c}")) / F.when(F.col(f"extent_{c}") > 1e-6, F.col(f"extent_{c}")).otherwise(1.0) - 0.5
    return j.select("cloud_id", "pt", *[one(c).alias(c) for c in "xyz"], *_colours(points))


def _colours(points: DataFrame) -> list[str]:
    return [c for c in "rgb" if c in points.columns]


def center_scale(points: DataFrame) -> DataFrame:
    """Each cloud around its centroid, scaled to a largest radius of 1; a radius of zero isn't scaled."""
    c = points.groupBy("cloud_id").agg(*[F.avg(a).alias(f"c{a}") for a in "xyz"])
    moved = points.join(c, "cloud_id").select("cloud_id", "pt", *[(F.col(a) - F.col(f"c{a}")).alias(a) for a in "xyz"])
    r = moved.groupBy("cloud_id").agg(F.max(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))).alias("r"))
    scale = F.when(F.col("r") > 0, F.col("r")).otherwise(1.0)
    return moved.join(r, "cloud_id").select("cloud_id", "pt", *[(F.col(a) / scale).alias(a) for a in "xyz"])


def rotate_y(points: DataFrame, degrees: Column) -> DataFrame:
    """Rotated about the vertical axis."""
    a = F.radians(degrees)
    return points.withColumns({"x": F.col("x") * F.cos(a) + F.col("z") * F.sin(a), "z": F.col("z") * F.cos(a) - F.col("x") * F.sin(a)})


def rotate_x(points: DataFrame, degrees: Column) -> DataFrame:
    """Rotated about the x axis."""
    a = F.radians(degrees)
    return points.withColumns({"y": F.col("y") * F.cos(a) - F.col("z") * F.sin(a), "z": F.col("y") * F.sin(a) + F.col("z") * F.cos(a)})


def translate(points: DataFrame, dx: Column, dy: Column) -> DataFrame:
    return points.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy})


def scene_points(objects: DataFrame, points: DataFrame) -> DataFrame:
    """The points of every scene object: the cloud ``cloud_id`` of the object normalised, scaled to twice the half-extents, turned and moved.

    ``objects`` has scene_id, idx, cloud_id, px, py, pz, hx, hy, hz, rotation. Colours of the points stay.
    """
    j = objects.join(normalize(points), "cloud_id")
    return j.select("scene_id", "idx", "pt", *placed(), *_colours(points))


def scene_centres(objects: DataFrame, points: DataFrame) -> DataFrame:
    """(scene_id, idx, n_points, x, y, z): how many points ``scene_points`` gives each object, and their means, without making them.

    A placed coordinate is linear in those of the point, so its mean is that of the cloud's means. A mean of x and z is of points
    that have both, as one that lacks either has neither when it is turned.
    """
    both = lambda c, other: F.avg(F.when(F.col(other).isNotNull(), F.col(c))).alias(c)
    means = normalize(points).groupBy("cloud_id").agg(F.count("*").alias("n_points"), both("x", "z"), F.avg("y").alias("y"), both("z", "x"))
    j = objects.join(few(means), "cloud_id")
    return j.select("scene_id", "idx", "n_points", *placed())


def placed() -> list[Column]:
    """x, y and z of a normalised point in its object: scaled to twice the half-extents, turned and moved."""
    x, y, z = (F.col(c) * 2 * F.col(f"h{c}") for c in "xyz")
    a = F.radians("rotation")
    return [(x * F.cos(a) + z * F.sin(a) + F.col("px")).alias("x"), (y + F.col("py")).alias("y"), (z * F.cos(a) - x * F.sin(a) + F.col("pz")).alias("z")]


def scaled(points: DataFrame, value: Column, name: str) -> DataFrame:
    """The value brought to [0, 1] within each cloud; 0 where all are equal. A cloud's range is aggregated, then joined."""
    own = points.withColumn(name, value)
    r = own.groupBy("cloud_id").agg(F.min(name).alias("lo_"), F.max(name).alias("hi_"))
    return own.join(r, "cloud_id").withColumn(name, F.when(F.col("hi_") > F.col("lo_"), (F.col(name) - F.col("lo_")) / (F.col("hi_") - F.col("lo_"))).otherwise(0.0)).drop("lo_", "hi_")


def details(points: DataFrame) -> DataFrame:
    """One row a cloud, and one with a null id for all together: points, whether there are colours and normals, bounds and centre."""
    has = lambda *names: F.max(F.lit(set(names) <= set(points.columns)) & (F.col(names[0]).isNotNull() if set(names) <= set(points.columns) else F.lit(False)))
    sums = [F.count("*").alias("n_points"), has("r", "g", "b").alias("has_colors"), has("nx", "ny", "nz").alias("has_normals")]
    return points.rollup("cloud_id").agg(*sums, *[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max), ("center", F.avg))])


def per_cloud():
    return Window.partitionBy("cloud_id")


def rainbow(points: DataFrame) -> DataFrame:
    """The place of each point in its cloud, from 0 to 1."""
    return points.withColumn("shade", F.percent_rank().over(Window.partitionBy("cloud_id").orderBy("pt")))
