"""The fifteen question generators as plans: ground truth for every scene, reference and attribute.

Each takes scene objects as rows (scene_id, idx, object_id, object_name, px, py, pz, hx, hy, hz), or the kinds of number scenes, and
returns rows with ``question`` and ``answer``. Ties go to the object that comes first in the scene. Types are checked
when the plan is built.

Extremes are first values of one sorted window: the pairs of a scene are hash-partitioned by scene once, and neither the
windows by (scene, reference) nor those by scene shuffle again. Attributes come as a flag each (``having``), so that one sort
serves all four; the values are joined to the chosen targets only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..enums import ATTRIBUTES
from ..functions.relations import direction, squared_distance, volume


_IN_SCENE = "s {}in the components of the {} {}object in the scene?"


def _one_of(name: str, value: str, allowed: tuple[str, ...]) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {allowed}, not {value!r}")


def _far(kind: str) -> bool:
    _one_of("distance_type", kind, ("closest", "farthest"))
    return kind == "farthest"


def _big(kind: str) -> bool:
    _one_of("size_type", kind, ("largest", "smallest"))
    return kind == "largest"


def _frequent(kind: str) -> bool:
    _one_of("frequency_type", kind, ("most", "least"))
    return kind == "most"


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


_PLACE = ("px", "py", "pz")


def _struct(prefix: str, *names: str) -> Column:
    return F.struct(*[F.col(prefix + n).alias(n) for n in names])


def with_flags(objects: DataFrame, object_values: DataFrame, key: str = "object_name") -> DataFrame:
    """The objects with ``has_material`` and so on: whether their ``key`` has values of the attribute."""
    flags = object_values.groupBy(F.col("object_name").alias("f_key")).agg(*[F.max(F.col("attribute") == a).alias(f"has_{a}") for a in ATTRIBUTES])
    return objects.join(flags, objects[key] == F.col("f_key"), "left").drop("f_key")


def _pairs(objects: DataFrame, least: int) -> DataFrame:
    """Each reference r_... with each other object t_... of its scene, in scenes of ``least`` objects or more, and ``d2``."""
    rows = objects.withColumn("n_", F.count("*").over(Window.partitionBy("scene_id"))).filter(F.col("n_") >= least) if least > 2 else objects
    own = ("idx", "object_id", "object_name", *_PLACE)
    r = rows.select("scene_id", *[F.col(c).alias(f"r_{c}") for c in own])
    t = rows.select("scene_id", *[F.col(c).alias(f"t_{c}") for c in (*own, *[f"has_{a}" for a in ATTRIBUTES if f"has_{a}" in objects.columns])])
    p = r.join(t, "scene_id").filter("r_idx <> t_idx")
    at = lambda x: {c: F.col(f"{x}_{c}") for c in _PLACE}
    return p.withColumn("d2", squared_distance(at("t"), at("r")))


def _first(order: list[Column], *keys: str):
    """The first value that isn't null in the order within the keys, and the window that numbers it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return w, lambda c: F.first(c, ignorenulls=True).over(whole)


def _by_distance(objects: DataFrame, kind: str, least: int) -> DataFrame:
    d2 = F.desc("d2") if _far(kind) else F.asc("d2")
    w = Window.partitionBy("scene_id", "r_idx").orderBy(d2, "t_idx")
    return _pairs(objects, least).withColumn("rank_", F.row_number().over(w)).filter("rank_ = 1")


def _found(rows: DataFrame, question: Column, answer: Column, *more: str) -> DataFrame:
    return rows.select("scene_id", F.col("r_idx").alias("ref_idx"), F.col("t_idx").alias("target_idx"), *more, question.alias("question"), answer.alias("answer"))


def what_distance(objects: DataFrame, distance_type: str, ids: bool = False) -> DataFrame:
    """Scenes of three objects or more: which object is closest to, or farthest from, each reference. ``ids`` adds ref_id and target_id."""
    rows = _by_distance(objects, distance_type, 3).withColumns({"ref_id": F.col("r_object_id"), "target_id": F.col("t_object_id")})
    q = _text(f"What is the object that is {distance_type} from the ", F.col("r_object_name"), "?")
    return _found(rows, q, F.col("t_object_name"), *(("ref_id", "target_id") if ids else ()))


def where_distance(objects: DataFrame, distance_type: str) -> DataFrame:
    """Where that object is from the reference, in scenes of two objects or more."""
    q = _text(f"Where is the object that is {distance_type} from the ", F.col("r_object_name"), "?")
    at = lambda x: {c: F.col(f"{x}_{c}") for c in _PLACE}
    return _found(_by_distance(objects, distance_type, 2), q, direction(at("t"), at("r")))


def _each_attribute(rows: DataFrame, object_values: DataFrame) -> DataFrame:
    """A row for each attribute with a target a_<attribute> (idx, key), with the target's ``vals``."""
    pairs = ", ".join(f"'{a}', a_{a}" for a in ATTRIBUTES)
    kept = [c for c in rows.columns if not c.startswith("a_")]
    long = rows.select(*kept, F.expr(f"stack({len(ATTRIBUTES)}, {pairs}) AS (attribute, target)")).filter("target is not null")
    values = object_values.select(F.col("object_name").alias("v_key"), F.col("attribute").alias("v_attribute"), "vals")
    return long.join(values, (F.col("target.key") == F.col("v_key")) & (F.col("attribute") == F.col("v_attribute")))


def _attribute_distance(objects: DataFrame, object_values: DataFrame, kind: str, key: str) -> DataFrame:
    d2 = F.desc("d2") if _far(kind) else F.asc("d2")
    w, first = _first([d2, F.asc("t_idx")], "scene_id", "r_idx")
    p = _pairs(with_flags(objects, object_values, key), 2)
    chosen = {f"a_{a}": first(F.when(F.col(f"t_has_{a}"), F.struct(F.col("t_idx").alias("idx"), F.col(f"t_{key}").alias("key")))) for a in ATTRIBUTES}
    rows = p.select("scene_id", "r_idx", "r_object_name", F.row_number().over(w).alias("rank_"), *[c.alias(n) for n, c in chosen.items()]).filter("rank_ = 1")
    return _each_attribute(rows, object_values).withColumn("t_idx", F.col("target.idx"))


def list_attribute_distance(objects: DataFrame, object_values: DataFrame, distance_type: str, key: str = "object_name") -> DataFrame:
    """The attribute's values of the closest or farthest other object that has the attribute; ``key`` is the column its values go by."""
    q = _text("List all ", F.col("attribute"), f"s in the components of the object {distance_type} from the ", F.col("r_object_name"), ".")
    return _found(_attribute_distance(objects, object_values, distance_type, key), q, F.array_join("vals", ", "), "attribute")


def count_attribute_distance(objects: DataFrame, object_values: DataFrame, distance_type: str, key: str = "object_name") -> DataFrame:
    """How many values those are."""
    q = _text("How many ", F.col("attribute"), f"s are in the components of the object {distance_type} from the ", F.col("r_object_name"), "?")
    return _found(_attribute_distance(objects, object_values, distance_type, key), q, F.size("vals").cast("string"), "attribute")


def what_attribute(components: DataFrame) -> DataFrame:
    """(object_name, component, attribute, question, answer) for each value of a component."""
    pairs = ", ".join(f"'{a}', {a}" for a in ATTRIBUTES)
    long = components.select("object_name", "component", F.expr(f"stack({len(ATTRIBUTES)}, {pairs}) AS (attribute, answer)")).filter("coalesce(answer, '') <> ''")
    q = _text("What is the ", F.col("attribute"), " of the ", F.col("component"), " in the ", F.col("object_name"), "?")
    return long.select("object_name", "component", "attribute", q.alias("question"), "answer")


def list_attribute(object_values: DataFrame) -> DataFrame:
    """(object_name, attribute, question, answer): all values of an object's attribute, sorted."""
    q = _text("List all ", F.col("attribute"), "s in the components of the ", F.col("object_name"), ".")
    return object_values.select("object_name", "attribute", q.alias("question"), F.array_join("vals", ", ").alias("answer"))


def count_attribute(object_values: DataFrame) -> DataFrame:
    """How many those are."""
    q = _text("How many ", F.col("attribute"), "s are in the components of the ", F.col("object_name"), "?")
    return object_values.select("object_name", "attribute", q.alias("question"), F.size("vals").cast("string").alias("answer"))


def named_counts(kinds: DataFrame) -> DataFrame:
    """Kinds of number scenes by name: equal names are one, which comes where its first kind did."""
    made = kinds.groupBy("scene_id", "object_name").agg(F.sum("cnt").alias("cnt"), F.min("type_idx").alias("type_idx"))
    return made


def count_object(kinds: DataFrame) -> DataFrame:
    """How many there are of each kind in each number scene."""
    q = _text("How many ", F.col("object_name"), " in the scene?")
    return named_counts(kinds).select("scene_id", "object_name", q.alias("question"), F.col("cnt").cast("string").alias("answer"))


def _frequent_kind(kinds: DataFrame, frequency_type: str) -> DataFrame:
    most = _frequent(frequency_type)
    key = F.struct((-F.col("cnt") if most else F.col("cnt")).alias("c"), "type_idx", "object_name")
    by = named_counts(kinds).groupBy("scene_id").agg(F.count_distinct("cnt").alias("different"), F.min(key).alias("k"))
    return by.filter("different >= 2").select("scene_id", F.col("k.object_name").alias("object_name"))


def frequent_object(kinds: DataFrame, frequency_type: str) -> DataFrame:
    """The most or least frequent kind of each number scene with different counts."""
    found = _frequent_kind(kinds, frequency_type)
    return found.select("scene_id", F.lit(f"What is the {frequency_type} frequent object in the scene?").alias("question"), F.col("object_name").alias("answer"))


def list_attribute_frequent(kinds: DataFrame, object_values: DataFrame, frequency_type: str) -> DataFrame:
    """The values of each attribute that kind has."""
    q = _text("List all ", F.col("attribute"), _IN_SCENE.format("", frequency_type, "frequent "))
    found = _frequent_kind(kinds, frequency_type).join(object_values, "object_name")
    return found.select("scene_id", "attribute", q.alias("question"), F.array_join("vals", ", ").alias("answer"))


def count_attribute_frequent(kinds: DataFrame, object_values: DataFrame, frequency_type: str) -> DataFrame:
    """How many those are."""
    q = _text("How many ", F.col("attribute"), _IN_SCENE.format("are ", frequency_type, "frequent "))
    found = _frequent_kind(kinds, frequency_type).join(object_values, "object_name")
    return found.select("scene_id", "attribute", q.alias("question"), F.size("vals").cast("string").alias("answer"))


def _sized(objects: DataFrame, size_type: str) -> tuple[DataFrame, list[Column]]:
    v = objects.withColumn("vol_", volume({c: F.col(c) for c in ("hx", "hy", "hz")}))
    v = v.withColumn("n_", F.count("*").over(Window.partitionBy("scene_id"))).filter("n_ >= 2")
    return v, [F.desc("vol_") if _big(size_type) else F.asc("vol_"), F.asc("idx")]


def what_size(objects: DataFrame, size_type: str, names: bool = False) -> DataFrame:
    """The largest or smallest object of each scene of two objects or more. ``names`` adds ``own``, the set of the scene's names."""
    rows, order = _sized(objects, size_type)
    if names:
        rows = rows.withColumn("own", F.collect_set("object_name").over(Window.partitionBy("scene_id")))
    top = rows.withColumn("rank_", F.row_number().over(Window.partitionBy("scene_id").orderBy(*order))).filter("rank_ = 1")
    return top.select("scene_id", F.col("idx").alias("target_idx"), F.lit(f"What is the {size_type} object in the scene?").alias("question"), F.col("object_name").alias("answer"), *(["own"] if names else []))


def _attribute_size(objects: DataFrame, object_values: DataFrame, size_type: str, key: str) -> DataFrame:
    rows, order = _sized(with_flags(objects, object_values, key), size_type)
    w, first = _first(order, "scene_id")
    chosen = [first(F.when(F.col(f"has_{a}"), F.struct(F.col("idx").alias("idx"), F.col(key).alias("key")))).alias(f"a_{a}") for a in ATTRIBUTES]
    return _each_attribute(rows.select("scene_id", F.row_number().over(w).alias("rank_"), *chosen).filter("rank_ = 1"), object_values)


def list_attribute_size(objects: DataFrame, object_values: DataFrame, size_type: str, key: str = "object_name") -> DataFrame:
    """The attribute's values of the largest or smallest object that has the attribute."""
    q = _text("List all ", F.col("attribute"), _IN_SCENE.format("", size_type, ""))
    return _attribute_size(objects, object_values, size_type, key).select("scene_id", "attribute", F.col("target.idx").alias("target_idx"), q.alias("question"), F.array_join("vals", ", ").alias("answer"))


def count_attribute_size(objects: DataFrame, object_values: DataFrame, size_type: str, key: str = "object_name") -> DataFrame:
    """How many those are."""
    q = _text("How many ", F.col("attribute"), _IN_SCENE.format("are ", size_type, ""))
    return _attribute_size(objects, object_values, size_type, key).select("scene_id", "attribute", F.col("target.idx").alias("target_idx"), q.alias("question"), F.size("vals").cast("string").alias("answer"))


def where_size(objects: DataFrame, size_type: str, reference_mode: str = "with_reference") -> DataFrame:
    """Where the largest or smallest object is from each other object, or the other way round (``reference_to_target``)."""
    _one_of("reference_mode", reference_mode, ("with_reference", "reference_to_target", "no_reference"))
    rows, order = _sized(objects, size_type)
    _, first = _first(order, "scene_id")
    found = rows.withColumn("t", first(_struct("", "idx", *_PLACE))).filter(F.col("idx") != F.col("t.idx"))
    top = f"{size_type} object in the scene"
    t, r, name = F.col("t"), {c: F.col(c) for c in _PLACE}, F.col("object_name")
    if reference_mode == "no_reference":
        q, a = _text("Where is the ", top, "?"), direction(t, r)
    elif reference_mode == "with_reference":
        q, a = _text("Where is the ", top, " with respect to the ", name, "?"), direction(t, r)
    else:
        q, a = _text("Where is the ", name, " with respect to the ", top, "?"), direction(r, t)
    return found.select("scene_id", F.col("idx").alias("ref_idx"), t["idx"].alias("target_idx"), q.alias("question"), a.alias("answer"))


def first_seen(tasks: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first task of each key, in the given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return tasks.withColumn("rank_", F.row_number().over(w)).filter("rank_ = 1").drop("rank_")
