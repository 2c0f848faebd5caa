"""Task sets from a catalog and layouts: attempts as rows, accepted by rules, numbered and written.

An attempt is a scene: a layout, and for each of its placeholders a catalog object, drawn without replacement by hashes of
(seed, attempt). The number of attempts grows fourfold until enough tasks are accepted or a larger range adds none. Points are joined
only to the accepted tasks. Wrong answers come from the scene; others only make up what is short.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..enums import ATTRIBUTES, LEAST_OBJECTS, MOST_OBJECTS, count_splits
from ..functions import distractors, relations
from ..operators import generators as g
from ..operators import geometry
from ..operators import scenes as s
from ..operators.numbering import FEW, WIDTH
from ..rng import uniform
from ..schema import KINDS, TaskPlan
from ..session import scratch
from ..sources import sinks
from ..sources.files import catalog_components, layout_objects


#: Drawn layouts that are asked for by a list of their ids.
_LISTED = 10_000


class Inputs:
    """A catalog (object_id, object_name, components) and layouts, prepared once for many plans.

    The catalog is numbered and kept in memory while it is used. Of the layouts only ids, numbers and sizes are written: ``standard`` and ``special``. A scan
    brings the layouts that some attempts drew, and these are written for the plans that use them. ``sizes`` (id, n) are the layouts' ids and
    numbers of objects, where they can be had without making the layouts.
    """

    def __init__(self, spark: SparkSession, catalog: DataFrame, layouts: DataFrame, sizes: DataFrame | None = None):
        self.spark = spark
        w = Window.partitionBy(F.lit(0)).orderBy("object_id")
        self.catalog = catalog.select((F.row_number().over(w) - 1).cast("long").alias("ord"), "object_id", "object_name").cache()
        by_object = catalog_components(catalog)
        #: Values by object id, under the name that the scene operators join on.
        self.values = s.component_values(by_object.drop("object_name").withColumnRenamed("object_id", "object_name")).cache()
        self.components = by_object
        self.vocabulary = s.vocabulary(self.values).select("attribute", F.col("values").alias("vocab")).cache()
        #: The first object of each name: questions about kinds ask for its attributes.
        self.by_name = self.catalog.groupBy(F.col("object_name").alias("target_name")).agg(F.min_by("object_id", "ord").alias("target_id"))
        self._layouts = layouts.select(F.col("id").alias("layout_id"), "description", "objects", F.size("objects").cast("long").alias("n")).filter(F.col("n").between(LEAST_OBJECTS, MOST_OBJECTS))
        numbers = self._numbered(self._layouts.select("layout_id", "n") if sizes is None else sizes.select(F.col("id").alias("layout_id"), "n"))
        #: (layout_ord, layout_id, n): a layout's number in the order of ids, and its objects.
        self.standard = numbers.select(F.col("standard_").alias("layout_ord"), "layout_id", "n")
        self.special = numbers.filter(F.col("n") > LEAST_OBJECTS).select(F.col("special_").alias("layout_ord"), "layout_id", "n")
        self._sizes: dict[int, int] = {}
        self._drawn: dict[tuple[int, int], tuple[int, DataFrame]] = {}

    def size(self, layouts: DataFrame) -> int:
        """How many layouts there are, counted once."""
        if id(layouts) not in self._sizes:
            self._sizes[id(layouts)] = layouts.count()
        return self._sizes[id(layouts)]

    def _numbered(self, sizes: DataFrame) -> DataFrame:
        """(layout_id, n, standard_, special_): the numbers of the standard layouts, and those of the special ones. Ids are ranked within ranges, as in ``numbered``; null comes first."""
        at = scratch(self.spark, "layouts")
        rows = sizes.filter(F.col("n").between(LEAST_OBJECTS, MOST_OBJECTS))
        rows.write.parquet(f"{at}/sizes")
        kept = self.spark.read.schema(rows.schema).parquet(f"{at}/sizes")
        if kept.isEmpty():  # asked of what is written, as a question to ``layouts`` would make them all once more
            raise ValueError(f"no layout has {LEAST_OBJECTS} to {MOST_OBJECTS} objects")
        ranged = kept.select("layout_id", "n", F.coalesce(F.floor(F.col("layout_id") / WIDTH), F.lit(-(1 << 60))).alias("range_"))
        w = Window.partitionBy("range_").orderBy(F.asc_nulls_first("layout_id"), "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        special = (F.col("n") > LEAST_OBJECTS).cast("long")
        ranked = ranged.select("range_", "layout_id", "n", F.count("*").over(w).alias("a_"), F.sum(special).over(w).alias("b_"))
        ahead = Window.partitionBy(F.lit(0)).orderBy("r_").rowsBetween(Window.unboundedPreceding, -1)
        by = ranged.groupBy(F.col("range_").alias("r_")).agg(F.count("*").alias("n_a"), F.sum(special).alias("n_b"))
        starts = by.select("r_", *[F.coalesce(F.sum(f"n_{x}").over(ahead), F.lit(0)).alias(f"ahead_{x}") for x in "ab"])
        made = ranked.join(starts, F.col("range_") == F.col("r_"))
        made = made.select("layout_id", "n", (F.col("ahead_a") + F.col("a_") - 1).alias("standard_"), (F.col("ahead_b") + F.col("b_") - 1).alias("special_"))
        made.write.parquet(f"{at}/numbers")
        return self.spark.read.schema(made.schema).parquet(f"{at}/numbers")

    def draw(self, wanted: list[tuple[DataFrame, int, int]]) -> None:
        """The layouts of the attempts up to ``last`` of each (layouts, seed, last), by one scan of all layouts; some more attempts are drawn, as they cost little next to the scan."""
        lasts: dict[tuple[int, int], tuple[DataFrame, int]] = {}
        for layouts, seed, last in wanted:
            key = (id(layouts), seed)
            if self._drawn.get(key, (0, None))[0] < last:
                lasts[key] = (layouts, max(last, min(16 * last, 4096), lasts.get(key, (None, 0))[1]))
        if not lasts:
            return
        small = sum(last for _, last in lasts.values()) <= FEW
        hint = F.broadcast if small else lambda df: df
        picked = None
        for own in (self.standard, self.special):
            ids = None
            for k, ((of, seed), (_, last)) in enumerate(lasts.items()):
                if of == id(own) and self.size(own):
                    one = self.spark.range(last).select(F.lit(k).alias("draw_"), F.col("id").alias("scene_id"), F.floor(uniform(seed, "layout", F.col("id")) * self.size(own)).cast("long").alias("layout_ord"))
                    ids = one if ids is None else ids.unionByName(one)
            if ids is not None:
                made = own.join(hint(ids), "layout_ord").select("draw_", "scene_id", "layout_id")
                picked = made if picked is None else picked.unionByName(made)
        at = scratch(self.spark, "drawn")
        if picked is None:
            picked = self.spark.createDataFrame([], "draw_ int, scene_id long, layout_id long")
        picked.write.parquet(f"{at}/picked")
        picked = self.spark.read.schema(picked.schema).parquet(f"{at}/picked")
        rows = self._layouts
        ids = [r.layout_id for r in picked.select("layout_id").distinct().limit(_LISTED + 1).collect() if r.layout_id is not None]
        if len(ids) <= _LISTED and all(isinstance(i, int) for i in ids):  # a list of ids, unlike a join, reaches the tables that layouts are made from
            rows = rows.filter(f"layout_id IN ({', '.join(map(str, ids)) or 'NULL'})")
        rows = rows.join(hint(picked), "layout_id")
        at = f"{at}/rows"
        rows.write.parquet(at)
        kept = self.spark.read.schema(rows.schema).parquet(at)
        for k, (key, (_, last)) in enumerate(lasts.items()):
            self._drawn[key] = (last, kept.filter(F.col("draw_") == k).drop("draw_"))

    def drawn(self, layouts: DataFrame, seed: int, last: int) -> DataFrame:
        """(layout_id, description, objects, n, scene_id) of the attempts before ``last``."""
        self.draw([(layouts, seed, last)])
        return self._drawn[id(layouts), seed][1].filter(F.col("scene_id") < last)


def attempts(inputs: Inputs, layouts: DataFrame, seed: int, first: int, last: int) -> DataFrame:
    """(scene_id, layout_id, description, n, idx, ..., object_id, object_name): scenes of the attempts from ``first`` to before ``last``."""
    chosen = inputs.drawn(layouts, seed, last).filter(F.col("scene_id") >= first)
    objects = s.sample_objects(chosen, inputs.catalog, F.col("n").cast("int"), seed, draws=36)
    places = layout_objects(chosen.select(F.col("scene_id").alias("id"), "objects")).withColumnRenamed("layout_id", "scene_id")
    rows = chosen.select("scene_id", "layout_id", "description", "n").join(objects.withColumnRenamed("type_idx", "idx"), "scene_id").join(places, ["scene_id", "idx"])
    # a catalog with too few objects for the layout leaves the scene out
    return rows.withColumn("have_", F.count("*").over(Window.partitionBy("scene_id"))).filter("have_ = n").drop("have_")


def _ask(inputs: Inputs, plan: TaskPlan, rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """Questions of a plan over scenes, with ``cand`` (wrong answers, best first), and the columns of the dedupe key."""
    kind, c, k = plan.generator_type, plan.generator_config, plan.num_options - 1
    values = s.object_values(inputs.values)
    names = rows.groupBy("scene_id").agg(F.collect_set("object_name").alias("scene_names"), F.collect_list(F.struct("idx", "object_id", "object_name")).alias("members"))

    def with_names(tasks: DataFrame) -> DataFrame:
        """The tasks with the ids and names of their target and, if there is one, their reference."""
        t = tasks.join(names, "scene_id")
        for p in ("target", "ref"):
            if f"{p}_idx" in tasks.columns:
                own = F.get(F.filter("members", _at(p)), F.lit(0))
                t = t.withColumn(f"{p}_id", own["object_id"]).withColumn(f"{p}_name", own["object_name"])
        return t

    def _at(p: str):
        return lambda m: m["idx"] == F.col(f"{p}_idx")

    draws = lambda n: F.transform(F.sequence(F.lit(0), F.lit(3 * plan.num_options)), lambda i: F.array_join(F.array_sort(F.slice(distractors.ranked(F.col("vocab"), plan.seed, F.col("scene_id"), F.col("attribute"), i), F.lit(1), n)), ", "))

    def one_attribute(t: DataFrame, *key: str) -> DataFrame:
        """One of the attributes that an attempt could ask about."""
        w = Window.partitionBy("scene_id", *key).orderBy(F.md5(F.concat_ws(":", F.lit(plan.seed), "scene_id", "attribute")))
        return t.withColumn("r_", F.row_number().over(w)).filter("r_ = 1").drop("r_")

    def one_reference(t: DataFrame) -> DataFrame:
        w = Window.partitionBy("scene_id").orderBy(F.md5(F.concat_ws(":", F.lit(plan.seed), F.lit("ref"), "scene_id", "ref_idx")))
        return t.withColumn("r_", F.row_number().over(w)).filter("r_ = 1").drop("r_")

    if kind in ("what_distance", "where_distance", "what_size", "where_size"):
        made = {
            "what_distance": lambda: g.what_distance(rows, c["distance_type"]),
            "where_distance": lambda: g.where_distance(rows, c["distance_type"]),
            "what_size": lambda: g.what_size(rows, c["size_type"]),
            "where_size": lambda: g.where_size(rows, c["size_type"], c.get("reference_mode", "with_reference")),
        }[kind]()
        has_ref = "ref_idx" in made.columns
        t = with_names(one_reference(made) if has_ref else made)
        if kind.startswith("what"):
            t = t.withColumn("cand", F.filter(F.array_remove("scene_names", F.col("answer")), lambda x: x != (F.col("ref_name") if has_ref else F.lit(""))))
            t = _top_up(inputs, t, plan)
        else:
            t = t.withColumn("cand", distractors.relations(F.col("answer")))
        return t, ["target_id", *(["ref_id"] if has_ref else [])]
    if kind.endswith(("_attribute_distance", "_attribute_size")):
        by = "distance_type" if "distance" in kind else "size_type"
        made = getattr(g, kind)(rows, values, c[by], key="object_id")
        has_ref = "ref_idx" in made.columns
        made = one_attribute(made, *(["ref_idx"] if has_ref else []))
        t = with_names(one_reference(made) if has_ref else made)
        t = _attribute_candidates(inputs, t, kind, k, draws)
        return t, ["target_id", *(["ref_id"] if has_ref else []), "attribute"]
    if kind in ("what_attribute", "list_attribute", "count_attribute"):
        first = rows.filter("idx = 0").select("scene_id", F.col("object_id").alias("target_id"), F.col("object_name").alias("target_name"))
        if kind == "what_attribute":
            pairs = ", ".join(f"'{a}', {a}" for a in ATTRIBUTES)
            long = inputs.components.select(F.col("object_id").alias("target_id"), "component", F.expr(f"stack({len(ATTRIBUTES)}, {pairs}) AS (attribute, answer)")).filter("coalesce(answer, '') <> '' and component is not null")
            t = one_attribute(first.join(long, "target_id"))
            q = F.concat(F.lit("What is the "), "attribute", F.lit(" of the "), "component", F.lit(" in the "), "target_name", F.lit("?"))
            t = t.withColumn("question", q).join(inputs.vocabulary, "attribute").withColumn("cand", F.array_remove("vocab", F.col("answer")))
            return t, ["target_id", "component", "attribute"]
        t = one_attribute(first.join(values.withColumnRenamed("object_name", "target_id"), "target_id"))
        listed = kind == "list_attribute"
        q = F.concat(F.lit("List all " if listed else "How many "), "attribute", F.lit("s in the components of the " if listed else "s are in the components of the "), "target_name", F.lit("." if listed else "?"))
        t = t.withColumn("question", q).withColumn("answer", F.array_join("vals", ", ") if listed else F.size("vals").cast("string"))
        t = _attribute_candidates(inputs, t, kind, k, draws)
        return t, ["target_id", "attribute"]
    return _ask_number(inputs, plan, rows, k, draws, one_attribute)


def _fill(cand: Column, more: Column, k: int) -> Column:
    """The candidates, and as many of ``more`` as they lack of k, in order."""
    return F.concat(cand, F.slice(F.array_except(more, cand), F.lit(1), F.greatest(F.lit(0), F.lit(k) - F.size(cand))))


def _top_up(inputs: Inputs, t: DataFrame, plan: TaskPlan) -> DataFrame:
    """Candidate names of the scene, and others of the catalog only if the scene has too few."""
    more = s.sample_objects(t.select("scene_id").distinct(), inputs.catalog, F.lit(24), plan.seed + 1)
    by = more.groupBy("scene_id").agg(F.array_sort(F.collect_list(F.struct("type_idx", "object_name"))).alias("more_"))
    t = t.join(by, "scene_id", "left")
    names = F.transform(F.coalesce("more_", F.array().cast("array<struct<type_idx:bigint,object_name:string>>")), lambda x: x["object_name"])
    return t.withColumn("cand", _fill(F.array_distinct("cand"), F.array_except(names, "scene_names"), plan.num_options - 1)).drop("more_")


def _attribute_candidates(inputs: Inputs, t: DataFrame, kind: str, k: int, draws) -> DataFrame:
    if kind.startswith("list"):
        t = t.join(inputs.vocabulary, "attribute")
        n = F.size(F.split("answer", ", ")) if "vals" not in t.columns else F.size("vals")
        return t.withColumn("cand", F.array_distinct(F.filter(draws(n), lambda x: x != F.col("answer"))))
    return t.withColumn("cand", distractors.numeric(F.col("answer").cast("int"), k).cast("array<string>"))


def _kinds(inputs: Inputs, plan: TaskPlan, rows: DataFrame) -> DataFrame:
    splits = inputs.spark.createDataFrame([(n, i, list(x)) for n, all_ in count_splits().items() for i, x in enumerate(all_)], "n long, cfg long, counts array<long>")
    return s.number_scenes(rows.select("scene_id", "n").distinct(), inputs.catalog, splits, plan.seed)


def _ask_number(inputs, plan, rows, k, draws, one_attribute) -> tuple[DataFrame, list[str]]:
    kind, c = plan.generator_type, plan.generator_config
    kinds = _kinds(inputs, plan, rows)
    named = g.named_counts(kinds)
    per = named.groupBy("scene_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "object_name", F.col("cnt").cast("string")))), "|").alias("bag"), F.collect_set("cnt").alias("counts"), F.collect_set("object_name").alias("scene_names"))
    if kind == "count_object":
        w = Window.partitionBy("scene_id").orderBy(F.md5(F.concat_ws(":", F.lit(plan.seed), "scene_id", "object_name")))
        t = g.count_object(kinds).withColumn("r_", F.row_number().over(w)).filter("r_ = 1").drop("r_").join(per, "scene_id")
        t = t.withColumn("cand", distractors.other_counts(F.col("answer").cast("long"), F.col("counts")).cast("array<string>"))
        return t, ["object_name", "bag"]
    if kind == "frequent_object":
        t = g.frequent_object(kinds, c["frequency_type"]).join(per, "scene_id").withColumn("cand", F.array_remove("scene_names", F.col("answer")))
        return _top_up(inputs, t, plan), ["bag"]
    # asked about is the first object of the catalog with the name; wrong answers are first what the scene's other kinds have
    listed = kind.startswith("list")
    values = s.object_values(inputs.values).withColumnRenamed("object_name", "target_id")
    found = g._frequent_kind(kinds, c["frequency_type"]).withColumnRenamed("object_name", "target_name").join(inputs.by_name, "target_name").join(values, "target_id")
    q = F.concat(F.lit("List all " if listed else "How many "), "attribute", F.lit(f"s {'' if listed else 'are '}in the components of the {c['frequency_type']} frequent object in the scene?"))
    t = one_attribute(found).withColumn("question", q).withColumn("answer", F.array_join("vals", ", ") if listed else F.size("vals").cast("string")).join(per, "scene_id")
    others = kinds.groupBy("scene_id", "object_name").agg(F.max_by("object_id", "type_idx").alias("o_id"))
    own = t.select("scene_id", "attribute", "target_name", "answer").join(others, "scene_id").filter("object_name <> target_name")
    own = own.join(values.select(F.col("target_id").alias("o_id"), "attribute", F.col("vals").alias("o_vals")), ["o_id", "attribute"], "left")
    said = F.array_join("o_vals", ", ") if listed else F.coalesce(F.size("o_vals"), F.lit(0)).cast("string")
    said = said if listed else F.when(F.col("o_vals").isNull(), "0").otherwise(said)
    first = own.withColumn("said_", said).filter("said_ <> answer").groupBy("scene_id").agg(F.array_sort(F.collect_set("said_")).alias("cand"))
    t = t.join(first, "scene_id", "left").withColumn("cand", F.coalesce("cand", F.array().cast("array<string>")))
    if listed:
        more = F.array_distinct(F.filter(draws(F.size("vals")), lambda x: x != F.col("answer")))
        t = t.join(inputs.vocabulary, "attribute")
    else:
        more = distractors.numeric(F.size("vals"), 2 * k + 9).cast("array<string>")
    return t.withColumn("cand", _fill(F.col("cand"), more, k)), ["attribute", "bag"]


def number_objects(inputs: Inputs, plan: TaskPlan, rows: DataFrame) -> DataFrame:
    """The objects of number scenes: each place of the layout has the kind whose range it is in."""
    kinds = _kinds(inputs, plan, rows).select("scene_id", F.col("object_id").alias("kind_id"), F.col("object_name").alias("kind_name"), "first_idx", "last_idx")
    return rows.join(kinds, "scene_id").filter("idx between first_idx and last_idx").withColumns({"object_id": F.col("kind_id"), "object_name": F.col("kind_name")}).drop("kind_id", "kind_name", "first_idx", "last_idx")


def is_number(kind: str) -> bool:
    return kind == "count_object" or "frequent" in kind


def layouts_for(inputs: Inputs, kind: str) -> DataFrame:
    return inputs.special if kind == "what_distance" or is_number(kind) else inputs.standard


def first_attempts(wanted: int, oversample: int = 4) -> int:
    """How many attempts are made for so many tasks at first."""
    return max(16, wanted * oversample)


def tasks(inputs: Inputs, plan: TaskPlan, wanted: int, oversample: int = 4, rounds: int | None = None) -> DataFrame:
    """Up to ``wanted`` tasks of a plan: question_id, scene_id, point, category, question, options, answer.

    A key is asked once; an attempt with too few wrong answers is dropped before that is decided. The number of attempts grows
    fourfold a round until enough are accepted, a round adds none, or after ``rounds`` of them; a warning says if there are fewer than wanted.
    """
    kind = plan.generator_type
    layouts, last, before, turn = layouts_for(inputs, kind), first_attempts(wanted, oversample), -1, 0
    while True:
        rows = attempts(inputs, layouts, plan.seed, 0, last)
        asked, key = _ask(inputs, plan, rows)
        ready = distractors.with_options(asked.filter("answer <> ''"), "answer", "cand", plan.num_options, plan.seed, F.col("scene_id"))
        kept = g.first_seen(ready, key, ["scene_id"]).orderBy("scene_id").limit(wanted).select("scene_id", "question", "options", "answer").cache()
        n, turn = kept.count(), turn + 1
        if n >= wanted or n == before or turn == rounds:
            break
        kept.unpersist()
        last, before = last * 4, n
    if n < wanted:
        warnings.warn(f"{kind}: {n} of {wanted} tasks from {last} attempts", stacklevel=2)
    # what is numbered is as many rows as were asked for
    number = (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("scene_id")) - 1).cast("long")
    kept = kept.withColumn("question_id", number)
    category = relations.category(F.lit(kind), F.lit(plan.generator_config.get("distance_type")).cast("string"))
    return kept.select("question_id", "scene_id", point_file(F.col("question_id")).alias("point"), category.alias("category"), "question", "options", "answer")


def point_file(number: Column) -> Column:
    """The file of a scene's cloud: its number in six digits or more."""
    text = number.cast("string")
    return F.concat(F.when(F.length(text) < 6, F.lpad(text, 6, "0")).otherwise(text), F.lit(".npy"))


def task_scenes(inputs: Inputs, plan: TaskPlan, made: DataFrame) -> DataFrame:
    """The objects of the scenes of ``made`` (scene_id, question_id): what ``attempts`` gives, in number scenes with the kinds in their places."""
    last = made.agg(F.max("scene_id")).first()[0]
    rows = attempts(inputs, layouts_for(inputs, plan.generator_type), plan.seed, 0, -1 if last is None else last + 1)
    rows = rows.join(made.select("scene_id", "question_id"), "scene_id")
    return number_objects(inputs, plan, rows) if is_number(plan.generator_type) else rows


def scene_metadata(rows: DataFrame) -> DataFrame:
    """(scene_id, point_cloud, layout_id, layout_template, layout_description, objects) of task scenes; the names are put into the template."""
    details = F.sort_array(F.collect_list(F.struct("idx", "placeholder", F.col("object_name").alias("name"), "object_id")))
    by = rows.groupBy("question_id", "layout_id", "description").agg(F.transform(details, lambda o: F.struct(o["name"].alias("name"), o["object_id"].alias("object_id"), o["placeholder"].alias("placeholder"))).alias("objects"))
    text = F.coalesce("description", F.lit(""))
    return by.select(F.col("question_id").alias("scene_id"), point_file(F.col("question_id")).alias("point_cloud"), "layout_id", text.alias("layout_template"), relations.fill_placeholders(text, F.col("objects")).alias("layout_description"), "objects")


def generate(inputs: Inputs, plan: TaskPlan, wanted: int, folder: str, clouds: DataFrame | None = None, documents: bool = False) -> dict:
    """Make a task set and write it below ``folder``; the returned description is written too.

    ``documents`` adds ``tasks.jsonl`` and ``pcd/metadata.json`` as single files, streamed through the driver.

    Every accepted task's scene is described in the metadata. ``clouds`` (cloud_id, pt, x, y, z, and r, g, b if there are colours) are the objects'
    points by object id; with them each scene is written as one cloud.
    """
    made = tasks(inputs, plan, wanted).cache()
    n = made.count()
    sinks.write_tasks(made, folder)
    if n:
        rows = task_scenes(inputs, plan, made)
        described = scene_metadata(rows)
        sinks.write_scene_metadata(described, folder)
        if documents:
            sinks.write_array(made.orderBy("question_id").select(*sinks.TASK_FIELDS), f"{folder}/tasks.jsonl", lines_only=True)
            details = F.struct(F.size("objects").alias("count"), F.col("objects").alias("details"))
            sinks.write_array(described.withColumn("objects", details).orderBy("scene_id"), f"{folder}/pcd/metadata.json")
        if clouds is not None:
            points = geometry.scene_points(rows.withColumn("cloud_id", F.col("object_id")), clouds).join(rows.select("scene_id", "question_id").distinct(), "scene_id")
            sinks.write_scene_clouds(points, folder).count()
    made.unpersist()
    return sinks.task_info(plan, wanted, n, folder)


def all_plans(num_options: int = 4, seed: int = 42) -> list[TaskPlan]:
    """One plan for every question type and configuration: the pool of the evaluation."""
    return [TaskPlan(kind, num_options, seed, dict(c)) for kind, configs in KINDS.items() for c in configs]
