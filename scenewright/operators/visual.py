"""Coloured clouds, layouts as visual scenes, and their reports. Everything but clusters and normals is a column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import colours
from ..rng import order_key, uniform
from . import clouds, geometry
from .numbering import few, once

CUBE_POINTS = 8192
GROUND_SIZE, GROUND_DENSITY = 10.0, 0.3
SCHEMES = ("original", "uniform", "height", "depth", "density", "cluster", "rainbow", "normal")


def _with(points: DataFrame, rgb) -> DataFrame:
    return points.withColumns(dict(zip("rgb", rgb)))


def coloured(points: DataFrame, scheme: str = "original", number: Column | None = None) -> DataFrame:
    """``points`` (cloud_id, pt, x, y, z) with r, g, b by a scheme; an unknown one counts as ``uniform``.

    ``number`` is the cloud's place among the clouds, by which uniform colours go. ``original`` keeps the colours that there are,
    and gives those without any the uniform one.
    """
    number = F.lit(0) if number is None else number
    uniform_ = colours.palette(number)
    if scheme == "original":
        if not {"r", "g", "b"} <= set(points.columns):
            return _with(points, uniform_)
        bare = F.col("r").isNull() | F.col("g").isNull() | F.col("b").isNull()
        return points.withColumns({c: F.when(bare, u).otherwise(F.col(c)) for c, u in zip("rgb", uniform_)})
    plain = points.select("cloud_id", "pt", "x", "y", "z")
    if scheme == "height":
        made = geometry.scaled(plain, F.col("z"), "shade")
        return _with(made, colours.scale(F.col("shade"), "viridis")).drop("shade")
    if scheme == "depth":
        made = geometry.scaled(plain, F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")), "shade")
        return _with(made, colours.scale(F.col("shade"), "plasma")).drop("shade")
    if scheme == "rainbow":
        return _with(geometry.rainbow(plain), colours.scale(F.col("shade"), "hsv")).drop("shade")
    if scheme in ("density", "cluster", "normal"):
        found = {"density": clouds.density, "cluster": clouds.clusters, "normal": clouds.normals}[scheme](plain).withColumnsRenamed({"cloud_id": "c_", "pt": "p_"})
        j = plain.join(found, (F.col("cloud_id") == F.col("c_")) & (F.col("pt") == F.col("p_")))
        if scheme == "normal":
            rgb = tuple((F.col(f"n{c}") + 1) / 2 for c in "xyz")
        elif scheme == "density":
            few = F.count("*").over(geometry.per_cloud()) < 10
            rgb = tuple(F.when(few, F.lit(x)).otherwise(c) for x, c in zip(colours.GREY, colours.scale(F.col("density"), "hot")))
        else:
            k = F.max("cluster").over(geometry.per_cloud()) + 1
            place = F.floor(F.col("cluster") / k * len(colours.SOFT))
            rgb = tuple(F.when(F.col("cluster") < 0, F.lit(x)).otherwise(c) for x, c in zip(colours.GREY, colours.palette(place, colours.SOFT)))
        return _with(j, rgb).select("cloud_id", "pt", "x", "y", "z", "r", "g", "b")
    return _with(plain, uniform_)


def cube_points(ids: DataFrame, n: int = CUBE_POINTS, seed: int = 42) -> DataFrame:
    """(cloud_id, pt, x, y, z): n hashed points in the unit cube around the origin for each of ``ids`` (cloud_id)."""
    rows = ids.select("cloud_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("pt"))
    return rows.select("*", *[(uniform(seed, c, F.col("cloud_id"), F.col("pt")) - 0.5).alias(c) for c in "xyz"])


def ground_points(ids: DataFrame, size: float = GROUND_SIZE, density: float = GROUND_DENSITY, seed: int = 42) -> DataFrame:
    """(scene_id, pt, x, y, z, r, g, b): hashed points of the ground under each of ``ids`` (scene_id)."""
    n = int((2 * size) ** 2 * density)
    rows = ids.select("scene_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("pt"))
    at = lambda c: ((uniform(seed, "ground", c, F.col("scene_id"), F.col("pt")) * 2 - 1) * size).alias(c)
    return rows.select("*", at("x"), F.lit(0.0).alias("y"), at("z"), *[F.lit(v).alias(c) for c, v in zip("rgb", colours.GROUND)])


def resampled(points: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Each cloud with n points: the first n by a hash, or, if it has fewer, all of them and then hashed draws with replacement."""
    from pyspark.sql import Window

    w = Window.partitionBy("cloud_id").orderBy(order_key(seed, F.col("cloud_id"), F.col("pt")), "pt")
    ranked = points.withColumn("at_", F.row_number().over(w) - 1)
    few = points.groupBy(F.col("cloud_id").alias("c_")).agg(F.count("*").alias("have_")).filter(F.col("have_") < n)
    draws = few.select("c_", "have_", F.explode(F.sequence(F.col("have_"), F.lit(n - 1))).alias("draw_"))
    draws = draws.select("c_", F.col("draw_").alias("place_"), F.floor(uniform(seed, "again", F.col("c_"), F.col("draw_")) * F.col("have_")).alias("of_"))
    again = ranked.join(draws, (F.col("cloud_id") == F.col("c_")) & (F.col("at_") == F.col("of_"))).withColumn("at_", F.col("place_"))
    return ranked.filter(F.col("at_") < n).unionByName(again.select(*ranked.columns)).withColumnRenamed("at_", "place")


def visual_names(places: DataFrame, names: list[str]) -> DataFrame:
    """``places`` (..., idx) with ``display``: the name of each place, round and round."""
    return places.withColumn("display", F.get(F.array(*map(F.lit, names)), (F.col("idx") % len(names)).cast("int")))


def _cubes(places: DataFrame, n: int, seed: int) -> DataFrame:
    """``places`` (..., cloud_id), n rows each, with pt, x, y and z: the points of ``cube_points``, normalised. They are made and normalised where the place is."""
    one = lambda c, i: uniform(seed, c, F.col("cloud_id"), i) - 0.5
    numbers = F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    rows = once(places, **{f"{c}_": F.transform(numbers, lambda i: one(c, i)) for c in "xyz"})  # noqa: B023
    rows = once(rows, **{f"{f}{c}_": g(f"{c}_") for c in "xyz" for f, g in (("min", F.array_min), ("max", F.array_max))})
    rows = rows.select(*places.columns, *[f"{f}{c}_" for c in "xyz" for f in ("min", "max")], F.inline(F.arrays_zip(numbers.alias("pt"), *[F.col(f"{c}_").alias(c) for c in "xyz"])).alias("pt", "x", "y", "z"))
    extent = lambda c: F.col(f"max{c}_") - F.col(f"min{c}_")
    return rows.select(*places.columns, "pt", *[((F.col(c) - F.col(f"min{c}_")) / F.when(extent(c) > 1e-6, extent(c)).otherwise(1.0) - 0.5).alias(c) for c in "xyz"])


def visual_scene(places: DataFrame, mapping: DataFrame | None = None, points: DataFrame | None = None, n: int = CUBE_POINTS, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """(scene_id, idx, display, pt, x, y, z, r, g, b) of layouts ``places`` (scene_id, idx, placeholder, px, py, pz, hx, hy, hz, rotation).

    ``mapping`` (scene_id, placeholder, name, cloud_id) says which cloud of ``points`` stands for a place; places without one, and clouds that aren't
    there, are cubes. A cloud without colours has that of its place in the layout. Columns ``keep`` of ``places`` come with each point.
    Cubes are made where their place is; the clouds are few, with n points each, and are joined to the places.
    """
    if mapping is None:
        named = places.withColumns({"name": F.lit(None).cast("string"), "cloud_id": F.lit(None).cast("string")})
    else:
        m = mapping.select(F.col("scene_id").alias("m_scene"), F.col("placeholder").alias("m_place"), "name", F.col("cloud_id").cast("string").alias("cloud_id"))
        named = places.join(m, (F.col("scene_id") == F.col("m_scene")) & (F.col("placeholder") == F.col("m_place")), "left").drop("m_scene", "m_place")
    named = named.withColumn("display", F.coalesce("name", "placeholder"))
    if points is not None:
        held = points.select(F.col("cloud_id").cast("string").alias("held_")).distinct()
        named = named.join(few(held), F.col("cloud_id") == F.col("held_"), "left")
    else:
        named = named.withColumn("held_", F.lit(None).cast("string"))
    cube = F.concat(F.lit("cube:"), F.col("scene_id").cast("string"), F.lit(":"), F.col("idx").cast("string"))
    named = named.withColumn("cloud_id", F.coalesce("held_", cube)).drop("name")
    own = [c for c in "rgb" if points is not None and c in points.columns]
    made = _cubes(named.filter(F.col("held_").isNull()), n, seed).withColumns({c: F.lit(None).cast("double") for c in own})
    if points is not None:
        some = resampled(points.withColumn("cloud_id", F.col("cloud_id").cast("string")), n, seed).withColumn("pt", F.col("place").cast("long"))
        some = geometry.normalize(some.select("cloud_id", "pt", "x", "y", "z", *own))
        made = made.unionByName(named.filter(F.col("held_").isNotNull()).join(few(some), "cloud_id"))
    kept = [c for c in keep if c not in "xyz"]
    made = made.select("scene_id", "idx", "display", F.col("idx").alias("cloud_id"), "pt", *kept, *geometry.placed(), *own)
    return coloured(made, "original", F.col("idx")).select("scene_id", "idx", "display", "pt", "x", "y", "z", "r", "g", "b", *kept)


def object_line(name: Column, position: list[Column], size: list[Column], rotation: Column) -> Column:
    """``- name: pos=(x, y, z), size=(a, b, c), rot=d°``, to the nearest hundredth; a size of one value is that value alone."""
    two = lambda c: F.format_string("%.2f", F.floor(c * 100 + 0.5) / 100)
    many = F.concat(F.lit("("), F.concat_ws(", ", *map(two, size)), F.lit(")")) if len(size) > 1 else two(size[0])
    return F.concat(F.lit("- "), name, F.lit(": pos=("), F.concat_ws(", ", *map(two, position)), F.lit("), size="), many, F.lit(", rot="), F.format_string("%.0f", rotation), F.lit("°"))


def layout_report(places: DataFrame) -> DataFrame:
    """(scene_id, report): a line for each object of a layout, in its order."""
    line = object_line(F.col("placeholder"), [F.col(c) for c in ("px", "py", "pz")], [F.col(c) for c in ("hx", "hy", "hz")], F.col("rotation"))
    by = places.groupBy("scene_id").agg(F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))).alias("lines"))
    return by.select("scene_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("report"))


def one_layout(layouts: DataFrame, seed: int) -> DataFrame:
    """One layout (id) by a hash of the seed: a top-one, not a sort."""
    return layouts.orderBy(order_key(seed, "layout", F.col("id")), "id").limit(1)
