"""Queries over scene descriptions: validation, templates, dependency structure and placement."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..enums import RELATIONS, SIZES
from ..functions import relations
from ..operators import dsl, geometry, solver
from .views import SEED, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _responses() -> list[tuple[int, str]]:
    """Valid descriptions, each rule broken once, and both ways of giving JSON."""
    box = lambda name, size, rotation: dict(name=name, size=size, rotation=rotation)
    way = lambda subject, relation, reference: dict(subject=subject, relation=relation, reference=reference)
    base = dict(description="A lamp on the table.", objects=[box("table", "largest", 0), box("lamp", "smallest", 90.5)], relations=[way("lamp", "on", "table")])

    def but(**change) -> str:
        made = json.loads(json.dumps(base)) | change
        return json.dumps({k: v for k, v in made.items() if v is not None})

    def obj(i: int, drop: str = "", **change) -> str:
        made = [dict(o) for o in base["objects"]]
        made[i] = {k: v for k, v in (made[i] | change).items() if k != drop}
        return but(objects=made)

    def rel(drop: str = "", **change) -> str:
        return but(relations=[{k: v for k, v in (base["relations"][0] | change).items() if k != drop}])

    six = [box(n, z, 15 * i) for i, (n, z) in enumerate(zip("desk chair rug plant shelf cup".split(), ["largest", "large", "medium", "medium", "large", "smallest"]))]
    ways = [("chair", "in front of", "desk"), ("rug", "far from", "chair"), ("plant", "beside", "desk"), ("shelf", "behind", "desk"), ("cup", "on", "desk")]
    room = but(description="A desk, a chair, a rug, a plant, a shelf and a cup.", objects=six, relations=[way(*w) for w in ways])
    many = [box(f"o{i}", "medium", 0) for i in range(10)]
    texts = [
        but(),
        "```json\n" + but() + "\n```",
        "Here it is:\n```\n" + but() + "\n```\nDone.",
        but(description=None, descirption="table and lamp"),
        room,
        "not json",
        "[1, 2]",
        but(description=None),
        but(objects=None),
        but(objects={"a": 1}),
        but(objects=base["objects"][:1]),
        but(objects=many),
        obj(1, drop="rotation"),
        obj(0, drop="name"),
        obj(0, drop="size"),
        obj(0, name="  "),
        obj(0, name=3),
        obj(1, size="huge"),
        obj(1, rotation="0"),
        obj(0, size="medium"),
        obj(1, size="large"),
        but(relations=None),
        but(relations="none"),
        rel(drop="reference"),
        rel(reference="floor"),
        rel(subject="cup"),
        rel(reference="lamp"),
        rel(relation="inside"),
        but(description="Only the table."),
        but(relations=[]),
        but(objects=[base["objects"][0], base["objects"][1] | {"name": "table"}], relations=[]),
    ]
    return list(enumerate(texts))


def _table(spark: SparkSession, d: str) -> DataFrame:
    """A response for every order, one of the cases in turn; its lamp is named by the customer."""
    cases = spark.createDataFrame(_responses(), "case_ long, text_ string")
    rows = table(spark, d, "orders").join(F.broadcast(cases), F.col("o_orderkey") % len(_responses()) == F.col("case_"))
    return rows.select(F.col("o_orderkey").alias("id"), F.replace("text_", F.lit("lamp"), F.concat(F.lit("lamp"), (F.col("o_custkey") % 9).cast("string"))).alias("response"))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_VALUES = "(VALUES " + ", ".join(f"({i}::BIGINT, {_sql_text(t)})" for i, t in _responses()) + ") AS c(case_, text_)"
_VALUES = f"(SELECT o_orderkey AS id, replace(text_, 'lamp', 'lamp' || (o_custkey % 9)) AS response FROM orders JOIN {_VALUES} ON o_orderkey % {len(_responses())} = case_)"
_LIST = lambda names: "[" + ", ".join(f"''{n}''" for n in names) + "]"
_IN = lambda names: "(" + ", ".join(_sql_text(n) for n in names) + ")"

_EXTRACT = r"""
    WITH r AS (SELECT id, response FROM {values}),
    x AS (SELECT id, response, CASE WHEN b <> '' THEN b ELSE response END AS text
          FROM (SELECT *, regexp_extract(response, '```(?:json)?\s*(\{{.*?\}})\s*```', 1, 's') AS b FROM r))
""".format(values=_VALUES)
_DSL = _EXTRACT + """, j AS (SELECT id, CASE WHEN json_valid(text) AND json_type(text) = 'OBJECT' THEN text::JSON END AS d FROM x),
    t AS (SELECT *, coalesce(d->>'description', d->>'descirption', '') AS description, json_type(d, '$.objects') AS ot, json_type(d, '$.relations') AS rt FROM j),
    o AS (SELECT id, i - 1 AS i, json_extract(d, '$.objects[' || (i - 1) || ']') AS o FROM t, LATERAL (SELECT unnest(range(1, json_array_length(d, '$.objects')::BIGINT + 1)) AS i) WHERE ot = 'ARRAY'),
    q AS (SELECT id, i - 1 AS i, json_extract(d, '$.relations[' || (i - 1) || ']') AS q FROM t, LATERAL (SELECT unnest(range(1, json_array_length(d, '$.relations')::BIGINT + 1)) AS i) WHERE rt = 'ARRAY')
"""
_ERRORS = _DSL + f""", n AS (SELECT id, i, o->>'name' AS name, o->>'size' AS size FROM o),
    e AS (
        SELECT id, 0 AS s, 0 AS i, 0 AS k, 'Invalid JSON' AS m FROM t WHERE d IS NULL
        UNION ALL SELECT id, 1, 0, 0, 'Missing required field ''description''' FROM t WHERE json_type(d, '$.description') IS NULL AND json_type(d, '$.descirption') IS NULL
        UNION ALL SELECT id, 2, 0, 0, 'Missing required field ''objects''' FROM t WHERE ot IS NULL
        UNION ALL SELECT id, 3, 0, 0, '''objects'' must be a list' FROM t WHERE ot <> 'ARRAY'
        UNION ALL SELECT id, 4, 0, 0, 'Object count must be between 2 and 9, got ' || json_array_length(d, '$.objects') FROM t WHERE ot = 'ARRAY' AND json_array_length(d, '$.objects') NOT BETWEEN 2 AND 9
        UNION ALL SELECT id, 5, i, 0, 'Object ' || i || ': missing required field ''name''' FROM o WHERE json_type(o, '$.name') IS NULL
        UNION ALL SELECT id, 5, i, 1, 'Object ' || i || ': missing required field ''size''' FROM o WHERE json_type(o, '$.size') IS NULL
        UNION ALL SELECT id, 5, i, 2, 'Object ' || i || ': missing required field ''rotation''' FROM o WHERE json_type(o, '$.rotation') IS NULL
        UNION ALL SELECT id, 5, i, 3, 'Object ' || i || ': ''name'' must be a non-empty string' FROM o WHERE json_type(o, '$.name') <> 'VARCHAR' OR trim(o->>'name') = ''
        UNION ALL SELECT id, 5, i, 4, 'Object ' || i || ': invalid size ''' || (o->>'size') || '''. Must be one of {_LIST(SIZES)}' FROM o WHERE json_type(o, '$.size') <> 'VARCHAR' OR (o->>'size') NOT IN {_IN(SIZES)}
        UNION ALL SELECT id, 5, i, 5, 'Object ' || i || ': ''rotation'' must be a number' FROM o WHERE json_type(o, '$.rotation') NOT IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'BOOLEAN')
        UNION ALL SELECT id, 6, 0, 0, 'Missing required ''largest'' sized object' FROM t WHERE ot = 'ARRAY' AND NOT EXISTS (SELECT 1 FROM n WHERE n.id = t.id AND size = 'largest')
        UNION ALL SELECT id, 7, 0, 0, 'Missing required ''smallest'' sized object' FROM t WHERE ot = 'ARRAY' AND NOT EXISTS (SELECT 1 FROM n WHERE n.id = t.id AND size = 'smallest')
        UNION ALL SELECT id, 8, 0, 0, 'Missing required field ''relations''' FROM t WHERE rt IS NULL
        UNION ALL SELECT id, 9, 0, 0, '''relations'' must be a list' FROM t WHERE rt <> 'ARRAY'
        UNION ALL SELECT id, 10, i, 0, 'Relation ' || i || ': missing required field ''subject''' FROM q WHERE json_type(q, '$.subject') IS NULL
        UNION ALL SELECT id, 10, i, 1, 'Relation ' || i || ': missing required field ''relation''' FROM q WHERE json_type(q, '$.relation') IS NULL
        UNION ALL SELECT id, 10, i, 2, 'Relation ' || i || ': missing required field ''reference''' FROM q WHERE json_type(q, '$.reference') IS NULL
        UNION ALL SELECT id, 10, i, 3, 'Relation ' || i || ': subject ''' || (q->>'subject') || ''' not found in objects' FROM q WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.id = q.id AND name = q->>'subject')
        UNION ALL SELECT id, 10, i, 4, 'Relation ' || i || ': reference ''' || (q->>'reference') || ''' not found in objects' FROM q WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.id = q.id AND name = q->>'reference')
        UNION ALL SELECT id, 10, i, 5, 'Relation ' || i || ': subject and reference cannot be the same object' FROM q WHERE (q->>'subject') = (q->>'reference')
        UNION ALL SELECT id, 10, i, 6, 'Relation ' || i || ': invalid relation ''' || (q->>'relation') || '''. Must be one of {_LIST(RELATIONS)}' FROM q WHERE (q->>'relation') NOT IN {_IN(RELATIONS)}
        UNION ALL SELECT n.id, 11, n.i, 0, 'Description must contain object name ''' || name || '''' FROM n JOIN t USING (id) WHERE NOT contains(lower(description), lower(name))
        UNION ALL SELECT id, 12, 0, 0, 'Object names must be different' FROM n GROUP BY id HAVING count(DISTINCT name) < count(*)
    ),
    v AS (SELECT r.id, arg_min(m, (s, e.i, k)) AS error FROM r LEFT JOIN e USING (id) GROUP BY r.id)
"""

QUERIES["dsl_extract_json"] = lambda sp, d: _table(sp, d).select("id", dsl.extract_json(F.col("response")).alias("json"))
ORACLES["dsl_extract_json"] = _EXTRACT + " SELECT id, text AS json FROM x"
QUERIES["dsl_validate"] = lambda sp, d: dsl.validate(_table(sp, d)).select("id", "is_valid", "error")
ORACLES["dsl_validate"] = _ERRORS + " SELECT id, error IS NULL AS is_valid, error FROM v"


def _valid(sp: SparkSession, d: str) -> DataFrame:
    return dsl.parse(dsl.validate(_table(sp, d)))


QUERIES["layout_in_degree"] = lambda sp, d: dsl.in_degree(_valid(sp, d), "id")
ORACLES["layout_in_degree"] = _ERRORS + """
    SELECT n.id, n.name, count(q.id) AS in_degree FROM n JOIN v ON v.id = n.id AND error IS NULL LEFT JOIN q ON q.id = n.id AND (q.q->>'subject') = n.name GROUP BY n.id, n.name"""


QUERIES["layout_depth"] = lambda sp, d: dsl.depths(_valid(sp, d), "id")
ORACLES["layout_depth"] = _ERRORS.replace("WITH r AS", "WITH RECURSIVE r AS", 1) + """, ob AS (SELECT n.id, name FROM n JOIN v USING (id) WHERE error IS NULL),
    ed AS (SELECT q.id, q->>'reference' AS reference, q->>'subject' AS subject FROM q JOIN v USING (id) WHERE error IS NULL),
    w AS (SELECT id, name, 0::BIGINT AS depth FROM ob UNION ALL SELECT w.id, ed.subject, w.depth + 1 FROM w JOIN ed ON w.id = ed.id AND w.name = ed.reference WHERE w.depth < 9)
    SELECT id, name, max(depth) AS depth FROM w GROUP BY id, name"""
QUERIES["template_abstract"] = lambda sp, d: dsl.abstract(_valid(sp, d)).select("id", "template.description", F.array_join(F.transform("template.objects", lambda o: o["name"]), ",").alias("names"))
ORACLES["template_abstract"] = _ERRORS.replace("WITH r AS", "WITH RECURSIVE r AS", 1) + r""", f AS (
        SELECT t.id, 0::BIGINT AS k, description FROM t JOIN v USING (id) WHERE error IS NULL
        UNION ALL SELECT f.id, k + 1, regexp_replace(f.description, '\b' || n.name || '\b', '[obj_' || k || ']', 'gi') FROM f JOIN n ON n.id = f.id AND n.i = f.k),
    c AS (SELECT id, count(*) AS c, string_agg('obj_' || i, ',' ORDER BY i) AS names FROM n GROUP BY id)
    SELECT f.id, description, names FROM f JOIN c ON c.id = f.id AND f.k = c.c"""


def _fill(sp: SparkSession, d: str) -> DataFrame:
    """Every conversation turn as a template, with its role in place of a marker; null counts as empty."""
    names = F.array(F.struct(F.lit("obj_0").alias("placeholder"), F.col("role").alias("name")), F.struct(F.lit("obj_1").alias("placeholder"), F.lit("table").alias("name")))
    text = F.concat(F.lit("The [obj_0] said at the [obj_1]: "), F.coalesce("text", F.lit("")), F.lit(" [obj_0]"))
    return table(sp, d, "conversations").select("conv_id", "turn", relations.fill_placeholders(text, names).alias("filled"))


QUERIES["placeholder_fill"] = _fill
ORACLES["placeholder_fill"] = """SELECT conv_id, turn, replace(replace('The [obj_0] said at the [obj_1]: ' || coalesce(text, '') || ' [obj_0]', '[obj_0]', role), '[obj_1]', 'table') AS filled
    FROM conversations"""
def _solved(sp: SparkSession, d: str) -> DataFrame:
    """What is wrong with the placements of every different template in eight variants: objects missing, out of bounds, or colliding. An unsolved one has none."""
    texts = F.to_json("template")
    different = _table(sp, d).groupBy("response").agg(F.min("id").alias("id"))  # a response that repeats is validated once
    one = dsl.abstract(dsl.parse(dsl.validate(different))).groupBy(texts.alias("text")).agg(F.min("id").alias("template_id"), F.first("template").alias("scene")).cache()
    placed = solver.solve_templates(one, 8, SEED).cache()
    own = placed.select((F.col("template_id") * 8 + F.col("variant")).alias("scene_id"), F.col("place_idx").alias("idx"), "x", "y", "z", "hx", "hy", "hz")
    out = own.filter(~geometry.in_bounds()).groupBy("scene_id").agg(F.count("*").alias("out"))
    hit = geometry.collisions(own).groupBy("scene_id").agg(F.count("*").alias("collisions"))
    by = placed.groupBy("template_id", "variant").agg(F.min("solved").alias("solved"), F.count("place_idx").alias("n_objects")).withColumn("scene_id", F.col("template_id") * 8 + F.col("variant"))
    made = by.join(one.select("template_id", F.size("scene.objects").alias("wanted")), "template_id").join(out, "scene_id", "left").join(hit, "scene_id", "left")
    wrong = F.when(F.col("solved"), F.abs(F.col("wanted") - F.col("n_objects")) + F.coalesce("out", F.lit(0)) + F.coalesce("collisions", F.lit(0))).otherwise(F.col("n_objects"))
    return made.select("template_id", F.col("variant").cast("long").alias("variant"), wrong.cast("long").alias("wrong"))


QUERIES["solve_layouts"] = _solved
# the first three cases are one template; the other valid ones are one each
ORACLES["solve_layouts"] = _ERRORS + """, te AS (SELECT min(id) AS template_id FROM v WHERE error IS NULL GROUP BY CASE WHEN id % 31 < 3 THEN 0 ELSE id % 31 END)
    SELECT template_id, variant, CAST(0 AS BIGINT) AS wrong FROM te, range(8) r(variant)"""
