"""Scenes: objects in layouts, their attribute values, samples of the catalog, and number scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..enums import ATTRIBUTES, LEAST_OBJECTS, MOST_OBJECTS
from ..rng import order_key, uniform
from .numbering import FEW


def component_values(components: DataFrame) -> DataFrame:
    """(object_name, attribute, value) for the attributes of components that aren't missing, null or empty; distinct."""
    pairs = ", ".join(f"'{a}', {a}" for a in ATTRIBUTES)
    long = components.select("object_name", F.expr(f"stack({len(ATTRIBUTES)}, {pairs}) AS (attribute, value)"))
    return long.filter("coalesce(value, '') <> ''").distinct()


def vocabulary(values: DataFrame) -> DataFrame:
    """(attribute, values, n_values): every attribute's distinct values over all objects, sorted."""
    return values.groupBy("attribute").agg(F.array_sort(F.collect_set("value")).alias("values")).withColumn("n_values", F.size("values").cast("long"))


def object_values(values: DataFrame) -> DataFrame:
    """(object_name, attribute, vals): the sorted distinct values of each object and attribute that has any."""
    return values.groupBy("object_name", "attribute").agg(F.array_sort(F.collect_set("value")).alias("vals"))


def in_range(objects: DataFrame, least: int = LEAST_OBJECTS, most: int = MOST_OBJECTS) -> DataFrame:
    """Only the scenes with so many objects."""
    n = F.count("*").over(Window.partitionBy("scene_id"))
    return objects.withColumn("n_", n).filter(F.col("n_").between(least, most)).drop("n_")


def layout_classes(objects: DataFrame) -> DataFrame:
    """(layout_class, n_scenes): ``all`` scenes, ``standard`` ones of 2 to 9 objects, and ``special`` ones of 3 to 9."""
    sizes = objects.groupBy("scene_id").agg(F.count("*").alias("n"))
    total = sizes.agg(
        F.count("*").alias("all"),
        F.count_if(F.col("n").between(LEAST_OBJECTS, MOST_OBJECTS)).alias("standard"),
        F.count_if(F.col("n").between(LEAST_OBJECTS + 1, MOST_OBJECTS)).alias("special"),
    )
    return total.select(F.expr("stack(3, 'all', `all`, 'standard', standard, 'special', special) AS (layout_class, n_scenes)"))


def sample_objects(scenes: DataFrame, catalog: DataFrame, wanted, seed: int, draws: int = 24, keep: tuple[str, ...] = ()) -> DataFrame:
    """(scene_id, type_idx, object_id, object_name): ``wanted`` different catalog objects for each scene, in random order, with the columns ``keep`` of the scene.

    The catalog has (ord, object_id, object_name) with ord from 0; its size is read once. ``draws`` hashed draws a scene
    are made and repeats dropped; where they give too few, those after the first draw follow in order, so a scene has fewer objects
    only if the catalog, or ``draws``, is smaller. The cost doesn't depend on the catalog: a small one is broadcast, as its few numbers would
    bring all scenes into as few tasks; the numbers of a large one spread.
    """
    size = catalog.count()
    if not size:
        return scenes.limit(0).select("scene_id", *keep, F.lit(0).cast("long").alias("type_idx"), *[F.lit(None).cast(catalog.schema[c].dataType).alias(c) for c in ("object_id", "object_name")])
    drawn = draws_of(size, draws, lambda i: uniform(seed, F.col("scene_id"), i))
    picked = scenes.select("scene_id", *keep, F.posexplode(F.slice(drawn, F.lit(1), wanted)).alias("type_idx", "ord"))
    picked = picked.join(F.broadcast(catalog) if size <= FEW else catalog, "ord")
    return picked.select("scene_id", *keep, F.col("type_idx").cast("long").alias("type_idx"), "object_id", "object_name")


def draws_of(size: int, draws: int, number) -> Column:
    """Different numbers below ``size``: ``draws`` of ``number(i)`` in [0, 1), then those that follow the first. The first is made once, not for each that follows."""
    at = lambda i: F.floor(number(i) * size).cast("long")
    hashed = F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), at)
    after = F.flatten(F.transform(F.array(at(F.lit(0))), lambda a: F.transform(F.sequence(F.lit(1), F.lit(draws)), lambda j: (a + j) % size)))
    return F.array_distinct(F.concat(hashed, after))


def number_scenes(scenes: DataFrame, catalog: DataFrame, splits: DataFrame, seed: int) -> DataFrame:
    """(scene_id, n, type_idx, object_id, object_name, cnt, first_idx, last_idx): scenes whose kinds have different counts.

    A scene of n objects draws one of the splits of n (n, cfg, counts); its counts are shuffled over the sampled kinds, whose
    placeholders follow one another from first_idx to last_idx. There is a row for each scene_id in ``scenes``. The splits are a few constants; as they
    are broadcast, scenes stay where they are, and not all those of one n come into one task.
    """
    per = splits.groupBy("n").agg(F.count("*").alias("n_cfg"))
    chosen = scenes.filter(F.col("scene_id").isNotNull()).join(F.broadcast(per), "n").withColumn("cfg", F.floor(uniform(seed, "cfg", F.col("scene_id")) * F.col("n_cfg")).cast("long"))
    chosen = chosen.join(F.broadcast(splits), ["n", "cfg"]).select("scene_id", "n", "counts")
    keyed = F.transform("counts", lambda c, i: F.struct(order_key(seed, "count", F.col("scene_id"), i).alias("h"), c.alias("c")))
    chosen = chosen.withColumn("mixed", F.transform(F.array_sort(keyed), lambda s: s["c"]))
    rows = sample_objects(chosen, catalog, F.size("counts"), seed, draws=12, keep=("n", "mixed")).withColumn("cnt", F.element_at("mixed", (F.col("type_idx") + 1).cast("int")).cast("long"))
    w = Window.partitionBy("scene_id").orderBy("type_idx")
    end = F.sum("cnt").over(w)
    rows = rows.withColumn("last_idx", end - 1).withColumn("first_idx", F.col("last_idx") - F.col("cnt") + 1)
    return rows.select("scene_id", "n", "type_idx", "object_id", "object_name", "cnt", "first_idx", "last_idx")
