"""Queries over files: what is written by the library is read by the library, and compared with the table that it came from."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..enums import ATTRIBUTES
from ..functions import relations
from ..operators import evaluation, models, visual
from ..operators import scenes as s
from ..schema import TASK
from ..session import scratch
from ..sources import files, providers, sinks
from . import generate, layouts, pool, scene_queries
from .views import SEED, VIEWS_SQL, components, points, scene_objects, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = VIEWS_SQL + sql


# catalogs
def _catalog_lines(sp: SparkSession, d: str) -> DataFrame:
    """The parts as lines of a catalog: an object for each name, whose components are its parts."""
    part = components(sp, d)
    one = F.struct(F.col("component").alias("name"), *ATTRIBUTES)
    by = part.groupBy("object_name").agg(F.sort_array(F.collect_list(one)).alias("components"))
    return by.select(F.to_json(F.create_map(F.concat(F.lit("id_"), F.replace("object_name", F.lit(" "), F.lit("_"))), F.struct(F.col("object_name").alias("object"), "components"))).alias("value"))


def _catalog(sp: SparkSession, d: str) -> DataFrame:
    at = scratch(sp, "catalog")
    _catalog_lines(sp, d).write.text(at)
    return files.read_catalog(sp, at)


_add(
    "catalog_file",
    lambda sp, d: files.catalog_components(_catalog(sp, d)),
    " SELECT 'id_' || replace(object_name, ' ', '_') AS object_id, object_name, component, material, color, shape, texture FROM comp",
)


def _vocabulary_file(sp: SparkSession, d: str) -> DataFrame:
    at = scratch(sp, "vocabulary")
    sinks.write_vocabulary(s.vocabulary(s.component_values(components(sp, d))), f"{at}/attributes.json")
    long = sp.read.schema(", ".join(f"{a} array<string>" for a in ATTRIBUTES)).json(f"{at}/attributes.json", multiLine=True)
    pairs = ", ".join(f"'{a}', {a}" for a in ATTRIBUTES)
    return long.select(F.expr(f"stack(4, {pairs}) AS (attribute, vals)")).select("attribute", F.array_join("vals", "|").alias("vocabulary"))


_add("vocabulary_file", _vocabulary_file, " SELECT attribute, string_agg(DISTINCT value, '|' ORDER BY value) AS vocabulary FROM long_ GROUP BY attribute")


# layouts
def _layouts(sp: SparkSession, d: str, in_range: bool = True) -> DataFrame:
    """Every scene as a layout: its objects are placeholders."""
    one = F.struct(
        "idx",
        F.concat(F.lit("obj_"), F.col("idx").cast("string")).alias("name"),
        F.array("px", "py", "pz").alias("position"),
        ((F.col("idx") * 37) % 360).cast("double").alias("rotation"),
        F.array("hx", "hy", "hz").alias("size"),
    )
    by = scene_objects(sp, d, in_range).groupBy(F.col("scene_id").alias("id")).agg(F.array_sort(F.collect_list(one)).alias("o"))
    objects = F.transform("o", lambda x: F.struct(x["name"].alias("name"), x["position"].alias("position"), x["rotation"].alias("rotation"), x["size"].alias("size")))
    return by.select("id", F.concat(F.lit("Scene "), F.col("id").cast("string"), F.lit(" around the [obj_0].")).alias("description"), objects.alias("objects"), F.array().cast("array<struct<subject:string,relation:string,reference:string>>").alias("relations"))


def _layout_files(sp: SparkSession, d: str, in_range: bool = True) -> DataFrame:
    at = scratch(sp, "layouts")
    _layouts(sp, d, in_range).write.json(at)
    return files.read_layouts(sp, at, lines=True)


_add(
    "layout_file",
    lambda sp, d: files.layout_objects(_layout_files(sp, d)),
    " SELECT scene_id AS layout_id, idx, 'obj_' || idx AS placeholder, px, py, pz, hx, hy, hz, CAST((idx * 37) % 360 AS DOUBLE) AS rotation FROM so",
)


def _splits(sp: SparkSession, d: str) -> DataFrame:
    standard, special = files.split_layouts(_layout_files(sp, d, in_range=False))
    mark = lambda t, x: t.select("id", F.lit(x).alias("layout_class"))
    return mark(standard, "standard").unionByName(mark(special, "special"))


_add(
    "layout_split",
    _splits,
    " SELECT DISTINCT scene_id AS id, 'standard' AS layout_class FROM lines_ WHERE n BETWEEN 2 AND 9 UNION ALL SELECT DISTINCT scene_id, 'special' FROM lines_ WHERE n BETWEEN 3 AND 9",
)


def _places(sp: SparkSession, d: str) -> DataFrame:
    return files.layout_objects(_layouts(sp, d)).withColumnRenamed("layout_id", "scene_id")


_two = lambda c: f"printf('%.2f', floor({c} * 100 + 0.5) / 100)"
_add(
    "layout_report",
    lambda sp, d: visual.layout_report(_places(sp, d)),
    f""" SELECT scene_id, string_agg('- obj_' || idx || ': pos=(' || {_two("px")} || ', ' || {_two("py")} || ', ' || {_two("pz")} || '), size=(' || {_two("hx")} || ', ' || {_two("hy")} || ', ' || {_two("hz")}
        || '), rot=' || printf('%.0f', CAST((idx * 37) % 360 AS DOUBLE)) || '°', chr(10) ORDER BY idx) AS report FROM so GROUP BY scene_id""",
)
_NAMES = ["table", "chair", "lamp", "book", "cup", "shelf"]
_add(
    "visual_names",
    lambda sp, d: visual.visual_names(_places(sp, d), _NAMES).select("scene_id", "idx", "display"),
    f" SELECT scene_id, idx, [{', '.join(repr(n) for n in _NAMES)}][idx % {len(_NAMES)} + 1] AS display FROM so",
)
_add(
    "random_layout",
    lambda sp, d: visual.one_layout(_layouts(sp, d), SEED).select("id", "description"),
    f" SELECT scene_id AS id, 'Scene ' || scene_id || ' around the [obj_0].' AS description FROM so GROUP BY scene_id ORDER BY md5(concat_ws(':', '{SEED}', 'layout', scene_id)), scene_id LIMIT 1",
)


def _visual(sp: SparkSession, d: str) -> DataFrame:
    """Scenes with every third object's cloud missing: it is a cube. A summary of each object's points."""
    places = _places(sp, d)
    mapping = places.filter("idx % 3 <> 2").select("scene_id", "placeholder", F.concat(F.lit("cloud "), (F.col("idx") % 10).cast("string")).alias("name"), (F.col("idx") % 10).alias("cloud_id"))
    inside = visual.visual_scene(places, mapping, points(sp, d), 16, SEED, keep=("px", "py", "pz", "hx", "hy", "hz"))
    far = (F.abs(F.col("y") - F.col("py")) > F.col("hy") + 1e-6) | (F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("z") - F.col("pz"), 2) > F.pow("hx", 2) + F.pow("hz", 2) + 1e-6)
    return inside.groupBy("scene_id", "idx", "display").agg(F.count("*").alias("n_points"), F.count_if(far).alias("outside"), F.round(F.min("r"), 4).alias("r"))


_STRONG = [c[0] for c in visual.colours.STRONG]
_add(
    "visual_scenes",
    _visual,
    f""" SELECT scene_id, idx, CASE WHEN idx % 3 <> 2 THEN 'cloud ' || (idx % 10) ELSE 'obj_' || idx END AS display, CAST(16 AS BIGINT) AS n_points, CAST(0 AS BIGINT) AS outside,
        round([{", ".join(map(repr, _STRONG))}][idx % {len(_STRONG)} + 1]::DOUBLE, 4) AS r FROM so""",
)


# clouds
def _cloud_files(sp: SparkSession, d: str) -> str:
    at = scratch(sp, "clouds")
    p = points(sp, d)
    sinks.write_scene_clouds(p.select(F.col("cloud_id").alias("question_id"), F.lit(0).alias("idx"), "pt", "x", "y", "z"), at).count()
    return f"{at}/pcd"


_PT = ", w AS (SELECT cloud_id, row_number() OVER (PARTITION BY cloud_id ORDER BY pt) - 1 AS pt, x, y, z FROM pts) SELECT lpad(CAST(cloud_id AS VARCHAR), 6, '0') AS cloud_id, pt, x, y, z, r IS NOT NULL AS coloured FROM (SELECT *, NULL AS r FROM w)"
_add("cloud_files", lambda sp, d: files.read_points(sp, _cloud_files(sp, d)).select("cloud_id", "pt", "x", "y", "z", F.col("r").isNotNull().alias("coloured")), _PT)
_add(
    "cloud_list",
    lambda sp, d: files.list_clouds(sp, _cloud_files(sp, d)).select("cloud_id", F.regexp_extract("path", r"[^/]+$", 0).alias("file")),
    " SELECT DISTINCT lpad(CAST(cloud_id AS VARCHAR), 6, '0') AS cloud_id, lpad(CAST(cloud_id AS VARCHAR), 6, '0') || '.npy' AS file FROM pts",
)
_add(
    "cloud_lookup",
    lambda sp, d: files.read_cloud(sp, _cloud_files(sp, d), "000003").select("cloud_id", "pt", "x", "y", "z"),
    ", w AS (SELECT cloud_id, row_number() OVER (PARTITION BY cloud_id ORDER BY pt) - 1 AS pt, x, y, z FROM pts) SELECT '000003' AS cloud_id, pt, x, y, z FROM w WHERE cloud_id = 3",
)


def _exported(sp: SparkSession, d: str) -> DataFrame:
    at = scratch(sp, "export")
    pafs.FileSystem.from_uri(at)[0].create_dir(pafs.FileSystem.from_uri(at)[1])
    own = points(sp, d).filter("cloud_id = 1").withColumns({"r": F.lit(255.0), "g": F.lit(0.0), "b": F.lit(51.0)})
    for kind in ("npy", "ply"):
        sinks.export_cloud(own, f"{at}/a_{kind}.{kind}")
    sinks.export_cloud(own.drop("r", "g", "b"), f"{at}/a_xyz.xyz")
    return files.read_points(sp, at)


_add(
    "cloud_export",
    _exported,
    """, w AS (SELECT row_number() OVER (ORDER BY pt) - 1 AS pt, x, y, z FROM pts WHERE cloud_id = 1)
    SELECT cloud_id, pt, x, y, z, CASE WHEN cloud_id <> 'a_xyz' THEN 1.0::DOUBLE END AS r, CASE WHEN cloud_id <> 'a_xyz' THEN 0.0::DOUBLE END AS g, CASE WHEN cloud_id <> 'a_xyz' THEN 0.2::DOUBLE END AS b
    FROM w, (VALUES ('a_npy'), ('a_ply'), ('a_xyz')) t(cloud_id)""",
)


# task sets
def _task_files(sp: SparkSession, d: str) -> DataFrame:
    at = scratch(sp, "tasks")
    made = QUERIES_OF_SCENES["task_records"](sp, d)
    sinks.write_tasks(made.withColumn("options", F.split("options", r"\|")), at)
    return sp.read.schema(TASK).json(f"{at}/tasks").withColumn("options", F.array_join("options", "|"))


QUERIES_OF_SCENES = scene_queries.QUERIES
QUERIES["task_files"] = _task_files
ORACLES["task_files"] = scene_queries.ORACLES["task_records"]


def _metadata_files(sp: SparkSession, d: str) -> DataFrame:
    at = scratch(sp, "metadata")
    o = scene_objects(sp, d)
    place = F.concat(F.lit("obj_"), F.col("idx").cast("string"))
    rows = o.select(F.col("scene_id").alias("question_id"), F.col("scene_id").alias("layout_id"), F.lit("The [obj_1] is near the [obj_0].").alias("description"), "idx", place.alias("placeholder"), "object_name", "object_id")
    sinks.write_scene_metadata(generate.scene_metadata(rows), at)
    kind = "scene_id long, point_cloud string, layout_id long, layout_template string, layout_description string, objects struct<count:long,details:array<struct<name:string,object_id:long,placeholder:string>>>"
    back = sp.read.schema(kind).json(f"{at}/pcd_metadata")
    return back.select("scene_id", "point_cloud", "layout_id", "layout_description", F.col("objects.count").alias("n_objects"), F.array_join(F.transform("objects.details", lambda x: F.concat(x["placeholder"], F.lit("="), x["name"])), "|").alias("details"))


_add(
    "metadata_files",
    _metadata_files,
    """ SELECT scene_id, CASE WHEN scene_id < 1000000 THEN lpad(CAST(scene_id AS VARCHAR), 6, '0') ELSE CAST(scene_id AS VARCHAR) END || '.npy' AS point_cloud, scene_id AS layout_id,
        'The ' || max(CASE WHEN idx = 1 THEN object_name END) || ' is near the ' || max(CASE WHEN idx = 0 THEN object_name END) || '.' AS layout_description,
        count(*) AS n_objects, string_agg('obj_' || idx || '=' || object_name, '|' ORDER BY idx) AS details FROM so GROUP BY scene_id""",
)


def _inputs(sp: SparkSession, d: str) -> generate.Inputs:
    sizes = scene_objects(sp, d).groupBy(F.col("scene_id").alias("id")).agg(F.count("*").alias("n"))
    return generate.Inputs(sp, _catalog(sp, d), _layouts(sp, d), sizes)


_KIND_LIST = ", ".join(f"('{k}')" for k in sorted(generate.KINDS))


def _pool(sp: SparkSession, d: str) -> DataFrame:
    """A pool of 60 tasks of all question types: how many each type has, with a number of the pool, whose options break a rule, and whose description isn't filled."""
    made = pool.candidate_pool(_inputs(sp, d), 60, SEED)
    broken = (F.size("options") != 4) | (F.size(F.array_distinct("options")) != 4) | ~F.array_contains("options", F.col("answer")) | (F.size("scene_objects") < 2)
    return made.groupBy("generator_type").agg(F.count("*").alias("n_tasks"), F.count_if(F.col("task_id").between(0, 59)).alias("numbered"), F.count_if(broken).alias("broken"), F.count_if(F.contains("layout_text", F.lit("["))).alias("unfilled"))


QUERIES["candidate_pool"] = _pool
ORACLES["candidate_pool"] = f"SELECT generator_type, CAST(4 AS BIGINT) AS n_tasks, CAST(4 AS BIGINT) AS numbered, CAST(0 AS BIGINT) AS broken, CAST(0 AS BIGINT) AS unfilled FROM (VALUES {_KIND_LIST}) t(generator_type)"


def _evaluated(sp: SparkSession, d: str) -> DataFrame:
    """An evaluation of 12 tasks of two types in batches of 5, with the baseline that says A: its document, read back, against its history."""
    at = scratch(sp, "evaluation")
    config = pool.EvalConfig(12, 5, 8, 0.2, SEED)
    done = pool.evaluate(_inputs(sp, d), models.model("first-option"), config, at, kinds=["what_size", "where_distance"])
    result = "struct<task_id:long,question:string,answer:string,model_answer:string,is_correct:boolean,utility:double,category:string,options:array<string>,layout_description:string>"
    kind = f"config struct<budget:long>, stats struct<total:long,errors:long,error_rate:double,error_indices:array<long>>, results array<{result}>"
    back = sp.read.schema(kind).json(f"{at}/results.json", multiLine=True)
    own = back.select("stats.*", F.explode("results").alias("r"))
    right = F.col("r.is_correct") == (F.col("r.answer") == F.col("r.options")[0])
    failed = F.array_contains("error_indices", F.col("r.task_id")) == ~F.col("r.is_correct")
    by = own.groupBy("total").agg(F.count("*").alias("n_results"), F.count_if(right & failed).alias("consistent"), F.sum("r.task_id").alias("numbers"))
    last = done.agg(F.max("step")).first()[0]
    return by.select("total", "n_results", "consistent", "numbers", F.lit(last).cast("long").alias("last_step"))


QUERIES["evaluation_files"] = _evaluated
ORACLES["evaluation_files"] = "SELECT CAST(12 AS BIGINT) AS total, CAST(12 AS BIGINT) AS n_results, CAST(12 AS BIGINT) AS consistent, CAST(66 AS BIGINT) AS numbers, CAST(2 AS BIGINT) AS last_step"


def _hard_files(sp: SparkSession, d: str) -> DataFrame:
    at = scratch(sp, "hard")
    e = table(sp, d, "embeddings").select(F.col("vec_id").alias("task_id"), (~F.col("label").isin(1, 2)).alias("is_correct"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("answer"))
    hard = evaluation.hard_tasks(e)
    file = F.concat(F.lpad(F.col("question_id").cast("string"), 6, "0"), F.lit(".npy"))
    sinks.write_hard_data(hard.select("question_id", file.alias("point"), F.lit("mixed").alias("category"), F.lit("?").alias("question"), F.array("answer").alias("options"), "answer"), SEED, at)
    return sp.read.schema(TASK).json(f"{at}/hard_data/tasks").select("question_id", "point", "answer")


_add(
    "hard_data_files",
    _hard_files,
    ", h AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS question_id, label FROM embeddings WHERE label IN (1, 2)) SELECT question_id, lpad(CAST(question_id AS VARCHAR), 6, '0') || '.npy' AS point, 'label ' || label AS answer FROM h",
)
_add(
    "task_categories",
    lambda sp, d: table(sp, d, "orders").select(F.col("o_orderkey").alias("id"), relations.plain_category(*_category_parts()).alias("category")),
    """ SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' WHEN o_orderkey % 3 = 0 THEN 'what_distance_closest' ELSE 'what_distance' END AS category FROM orders""",
)


def _category_parts():
    key = F.col("o_orderkey")
    return F.when(key % 5 != 0, "what_distance"), F.when(key % 3 == 0, "closest").when(key % 3 == 1, "")


# providers
def _asked(sp: SparkSession, d: str) -> DataFrame:
    """A provider that fails for every seventh prompt and gives an invalid answer to every fifth."""

    def call(prompt: str) -> str:
        n = int(prompt.split()[-1])
        if n % 7 == 0:
            raise OSError("no answer")
        return "" if n % 5 == 0 else prompt.upper()

    rows = table(sp, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("prompt"))
    return providers.ask(rows, call, concurrency=8, retries=2, wait=0.0)


_ANSWERS = " SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 THEN 'ORDER ' || o_orderkey END AS response, CASE WHEN o_orderkey % 7 = 0 THEN 'error' WHEN o_orderkey % 5 = 0 THEN 'invalid' ELSE 'ok' END AS status, CAST(CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 THEN 3 ELSE 1 END AS INTEGER) AS calls FROM orders"
_add("provider_answers", _asked, _ANSWERS)
_add("provider_stats", lambda sp, d: providers.call_stats(_asked(sp, d)), f", a AS ({_ANSWERS}) SELECT CAST(sum(calls) AS BIGINT) AS calls, count(*) FILTER (status <> 'ok') AS errors, CAST(sum(calls - 1) AS BIGINT) AS retries FROM a")
_add(
    "recorded_answers",
    lambda sp, d: providers.recorded(table(sp, d, "customer").select(F.col("c_custkey").alias("id")), table(sp, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderstatus").alias("response"))),
    " SELECT c_custkey AS id, response, CASE WHEN response IS NULL THEN 'missing' ELSE 'ok' END AS status, CAST(0 AS INTEGER) AS calls FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderstatus) AS response FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey",
)


def _messages(sp: SparkSession, d: str) -> DataFrame:
    t = table(sp, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role"))
    return t.select("conv_id", "turn", providers.chat_messages(F.col("text"), F.col("role")).alias("plain"), F.length(providers.chat_messages(F.col("text"), F.col("role"), True)).cast("long").alias("reasoning_size"))


_MESSAGE = "json_object('role', 'system', 'content', coalesce(role, '')), json_object('role', 'user', 'content', coalesce(text, ''))"
QUERIES["chat_messages"] = _messages
ORACLES["chat_messages"] = f"""SELECT conv_id, turn, CAST(json_array({_MESSAGE}) AS VARCHAR) AS plain, CAST(length(CAST(json_array({_MESSAGE}, json_object('role', 'assistant', 'content', '<think>' || chr(10))) AS VARCHAR)) AS BIGINT) AS reasoning_size FROM conversations"""


def _batch(sp: SparkSession, d: str) -> DataFrame:
    """Layouts for every customer's list of names: recorded descriptions of a row of things, two placements each; the written documents' numbers."""
    at = scratch(sp, "batch")
    lists = models.sample_names(table(sp, d, "customer").select(F.col("c_custkey").alias("id")), ["chair", "table", "lamp", "book", "rug"], SEED, count=3)

    def answer(prompts: DataFrame) -> DataFrame:
        named = prompts.join(lists.withColumnRenamed("id", "l_id"), F.col("id") == F.col("l_id"))
        sizes = F.array(*map(F.lit, ("largest", "medium", "smallest")))
        objects = F.transform("names", lambda n, i: F.struct(n.alias("name"), F.get(sizes, i).alias("size"), (i * 90).alias("rotation")))
        near = F.transform(F.slice("names", 2, 2), lambda n: F.struct(n.alias("subject"), F.lit("near").alias("relation"), F.get("names", F.lit(0)).alias("reference")))
        # every tenth has no relations' field: it isn't valid
        text = F.when(F.col("id") % 10 != 0, F.to_json(F.struct(F.array_join("names", " and ").alias("description"), objects.alias("objects"), near.alias("relations")))).otherwise(F.to_json(F.struct(objects.alias("objects"))))
        return named.select("id", text.alias("response"))

    summary = layouts.generate_batch(lists, answer, 2, SEED, at, documents=True)
    text = files.read_array(sp, f"{at}/layouts.json", layouts.LAYOUTS)
    sizes = text.agg(F.count("*").alias("documents"), F.min(F.size("objects")).cast("long").alias("least"), F.max(F.size("objects")).cast("long").alias("most"))
    return sizes.select(F.lit(summary["num_templates"]).cast("long").alias("templates"), F.lit(summary["num_layouts"]).cast("long").alias("layouts"), "documents", "least", "most")


QUERIES["layout_batch"] = _batch
ORACLES["layout_batch"] = "WITH n AS (SELECT count(*) AS n FROM customer WHERE c_custkey % 10 <> 0) SELECT n AS templates, 2 * n AS layouts, 2 * n AS documents, CAST(3 AS BIGINT) AS least, CAST(3 AS BIGINT) AS most FROM n"


def _valid_texts(sp: SparkSession, d: str) -> DataFrame:
    """The rules for one text, as a retry needs them, against those for a table."""
    from .layout_queries import _responses

    made = sp.createDataFrame([(i, providers.scene_error(t)) for i, t in _responses()], "case_ long, error string")
    return table(sp, d, "orders").join(F.broadcast(made), F.col("o_orderkey") % len(_responses()) == F.col("case_")).select(F.col("o_orderkey").alias("id"), F.replace("error", F.lit("lamp"), F.concat(F.lit("lamp"), (F.col("o_custkey") % 9).cast("string"))).alias("error"))


QUERIES["retry_rules"] = _valid_texts


def _retry_sql() -> str:
    from .layout_queries import ORACLES as own

    return f"SELECT id, error FROM ({own['dsl_validate']})"


ORACLES["retry_rules"] = _retry_sql()
