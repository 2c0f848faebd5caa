"""Queries over scenes, catalog and number scenes, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..enums import ATTRIBUTES, RELATIONS
from ..functions import distractors, relations
from ..operators import generators as g
from ..operators import scenes as s
from ..operators.numbering import FEW
from ..rng import order_key_sql, uniform, uniform_sql
from .views import SEED, VIEWS_SQL, catalog, components, numbered, scene_objects, splits, splits_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = VIEWS_SQL + sql


def _values(spark, d):
    return s.component_values(components(spark, d))


def _having(spark, d):
    return scene_objects(spark, d), s.object_values(_values(spark, d))


def _kinds(spark, d):
    sizes = scene_objects(spark, d).groupBy("scene_id").agg(F.count("*").alias("n")).filter("n >= 3")
    return s.number_scenes(sizes, catalog(spark, d), splits(spark), SEED)


# catalog and vocabulary
_add("catalog_components", lambda sp, d: components(sp, d), "SELECT * FROM comp")
_add("component_values", lambda sp, d: _values(sp, d), "SELECT DISTINCT object_name, attribute, value FROM long_")
_add(
    "attribute_vocabulary",
    lambda sp, d: s.vocabulary(_values(sp, d)).select("attribute", F.array_join("values", "|").alias("vocabulary"), "n_values"),
    "SELECT attribute, string_agg(DISTINCT value, '|' ORDER BY value) AS vocabulary, count(DISTINCT value) AS n_values FROM long_ GROUP BY attribute",
)
_add(
    "possible_tasks",
    lambda sp, d: _values(sp, d).groupBy("attribute").agg(F.count_distinct("object_name").alias("n_tasks")),
    "SELECT attribute, count(DISTINCT object_name) AS n_tasks FROM long_ GROUP BY attribute",
)
_add(
    "objects_with_attribute",
    lambda sp, d: components(sp, d).select("object_name", F.explode(F.filter(F.array(*[F.when(F.coalesce(F.col(a), F.lit("")) != "", F.lit(a)) for a in ATTRIBUTES]), lambda x: x.isNotNull())).alias("attribute")).distinct(),
    "SELECT DISTINCT object_name, attribute FROM long_",
)

# scenes
_add(
    "layout_classes",
    lambda sp, d: s.layout_classes(scene_objects(sp, d, in_range=False)),
    """, z AS (SELECT scene_id, count(*) AS n FROM lines_ GROUP BY scene_id)
    SELECT 'all' AS layout_class, count(*) AS n_scenes FROM z UNION ALL SELECT 'standard', count(*) FROM z WHERE n BETWEEN 2 AND 9
    UNION ALL SELECT 'special', count(*) FROM z WHERE n BETWEEN 3 AND 9""",
)
_add(
    "scene_volumes",
    lambda sp, d: scene_objects(sp, d).select("scene_id", "idx", "object_name", F.round(relations.volume({c: F.col(c) for c in ("hx", "hy", "hz")}), 4).alias("volume")),
    "SELECT scene_id, idx, object_name, round(vol, 4) AS volume FROM so",
)


def _pairs(sp, d):
    return g._pairs(scene_objects(sp, d), 2)


def _at(p: str) -> dict:
    return {c: F.col(f"{p}_{c}") for c in ("px", "py", "pz")}


_add(
    "scene_pair_distances",
    lambda sp, d: _pairs(sp, d).select("scene_id", F.col("r_idx").alias("ref_idx"), F.col("t_idx").alias("target_idx"), F.round(F.sqrt("d2"), 4).alias("distance")),
    "SELECT scene_id, ref_idx, target_idx, round(sqrt(d2), 4) AS distance FROM pairs",
)
_add(
    "scene_relations",
    lambda sp, d: _pairs(sp, d).select("scene_id", F.col("r_idx").alias("ref_idx"), F.col("t_idx").alias("target_idx"), relations.direction(_at("t"), _at("r")).alias("direction")),
    "SELECT scene_id, ref_idx, target_idx, direction FROM pairs",
)

# distance family
for _t in ("closest", "farthest"):
    _o = "d2, target_idx" if _t == "closest" else "d2 DESC, target_idx"
    _add(
        f"what_distance_{_t}",
        lambda sp, d, t=_t: g.what_distance(scene_objects(sp, d), t),
        f""", b AS (SELECT *, row_number() OVER (PARTITION BY scene_id, ref_idx ORDER BY {_o}) AS r FROM pairs WHERE n >= 3)
        SELECT scene_id, ref_idx, target_idx, 'What is the object that is {_t} from the ' || ref_name || '?' AS question, target_name AS answer FROM b WHERE r = 1""",
    )
    _add(
        f"where_distance_{_t}",
        lambda sp, d, t=_t: g.where_distance(scene_objects(sp, d), t),
        f""", b AS (SELECT *, row_number() OVER (PARTITION BY scene_id, ref_idx ORDER BY {_o}) AS r FROM pairs)
        SELECT scene_id, ref_idx, target_idx, 'Where is the object that is {_t} from the ' || ref_name || '?' AS question, direction AS answer FROM b WHERE r = 1""",
    )
    _with = f""", b AS (
        SELECT p.*, attribute, vals, row_number() OVER (PARTITION BY scene_id, ref_idx, attribute ORDER BY {_o}) AS r
        FROM pairs p JOIN ov ON ov.object_name = p.target_name)"""
    _add(
        f"list_attribute_distance_{_t}",
        lambda sp, d, t=_t: g.list_attribute_distance(*_having(sp, d), t),
        _with
        + f"""
        SELECT scene_id, ref_idx, attribute, target_idx, 'List all ' || attribute || 's in the components of the object {_t} from the ' || ref_name || '.' AS question,
               array_to_string(vals, ', ') AS answer FROM b WHERE r = 1""",
    )
    _add(
        f"count_attribute_distance_{_t}",
        lambda sp, d, t=_t: g.count_attribute_distance(*_having(sp, d), t),
        _with
        + f"""
        SELECT scene_id, ref_idx, attribute, target_idx, 'How many ' || attribute || 's are in the components of the object {_t} from the ' || ref_name || '?' AS question,
               CAST(len(vals) AS VARCHAR) AS answer FROM b WHERE r = 1""",
    )

# attribute family
_add(
    "what_attribute",
    lambda sp, d: g.what_attribute(components(sp, d)),
    "SELECT object_name, component, attribute, 'What is the ' || attribute || ' of the ' || component || ' in the ' || object_name || '?' AS question, value AS answer FROM long_",
)
_add(
    "list_attribute",
    lambda sp, d: g.list_attribute(s.object_values(_values(sp, d))),
    "SELECT object_name, attribute, 'List all ' || attribute || 's in the components of the ' || object_name || '.' AS question, array_to_string(vals, ', ') AS answer FROM ov",
)
_add(
    "count_attribute",
    lambda sp, d: g.count_attribute(s.object_values(_values(sp, d))),
    "SELECT object_name, attribute, 'How many ' || attribute || 's are in the components of the ' || object_name || '?' AS question, CAST(len(vals) AS VARCHAR) AS answer FROM ov",
)

# size family
for _t in ("largest", "smallest"):
    _o = "vol DESC, idx" if _t == "largest" else "vol, idx"
    _big = f", b AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY {_o}) AS r FROM so)"
    _add(
        f"what_size_{_t}",
        lambda sp, d, t=_t: g.what_size(scene_objects(sp, d), t),
        _big + f" SELECT scene_id, idx AS target_idx, 'What is the {_t} object in the scene?' AS question, object_name AS answer FROM b WHERE r = 1",
    )
    _with = f""", b AS (
        SELECT so.*, attribute, vals, row_number() OVER (PARTITION BY scene_id, attribute ORDER BY {_o}) AS r FROM so JOIN ov USING (object_name))"""
    _add(
        f"list_attribute_size_{_t}",
        lambda sp, d, t=_t: g.list_attribute_size(*_having(sp, d), t),
        _with
        + f" SELECT scene_id, attribute, idx AS target_idx, 'List all ' || attribute || 's in the components of the {_t} object in the scene?' AS question, array_to_string(vals, ', ') AS answer FROM b WHERE r = 1",
    )
    _add(
        f"count_attribute_size_{_t}",
        lambda sp, d, t=_t: g.count_attribute_size(*_having(sp, d), t),
        _with
        + f" SELECT scene_id, attribute, idx AS target_idx, 'How many ' || attribute || 's are in the components of the {_t} object in the scene?' AS question, CAST(len(vals) AS VARCHAR) AS answer FROM b WHERE r = 1",
    )
    for _m, _join, _q in (
        ("with_reference", "p.target_idx = b.idx", f"'Where is the {_t} object in the scene with respect to the ' || ref_name || '?'"),
        ("no_reference", "p.target_idx = b.idx", f"'Where is the {_t} object in the scene?'"),
        ("reference_to_target", "p.ref_idx = b.idx", f"'Where is the ' || target_name || ' with respect to the {_t} object in the scene?'"),
    ):
        _own = "p.ref_idx AS ref_idx, p.target_idx AS target_idx" if _m != "reference_to_target" else "p.target_idx AS ref_idx, p.ref_idx AS target_idx"
        _add(
            f"where_size_{_m}_{_t}",
            lambda sp, d, t=_t, m=_m: g.where_size(scene_objects(sp, d), t, m),
            _big + f" SELECT p.scene_id, {_own}, {_q} AS question, direction AS answer FROM pairs p JOIN b ON p.scene_id = b.scene_id AND {_join} WHERE b.r = 1",
        )

# number family
_KINDS_SQL = f""", z AS (SELECT scene_id, n FROM so WHERE n >= 3 GROUP BY scene_id, n),
    per AS (SELECT n, count(*) AS n_cfg FROM {splits_sql()} GROUP BY n),
    cf AS (SELECT scene_id, z.n, CAST(floor({uniform_sql(f"'{SEED}'", "'cfg'", "scene_id")} * n_cfg) AS BIGINT) AS cfg FROM z JOIN per USING (n)),
    ch AS (SELECT scene_id, cf.n, counts FROM cf JOIN {splits_sql()} ON cf.n = splits.n AND cf.cfg = splits.cfg),
    mx AS (SELECT scene_id, row_number() OVER (PARTITION BY scene_id ORDER BY {order_key_sql(f"'{SEED}'", "'count'", "scene_id", "(i - 1)")}, c) - 1 AS type_idx, c AS cnt
           FROM (SELECT scene_id, unnest(counts) AS c, generate_subscripts(counts, 1) AS i FROM ch)),
    dr AS (SELECT scene_id, i, CAST(floor({uniform_sql(f"'{SEED}'", "scene_id", "i")} * (SELECT count(*) FROM cat)) AS BIGINT) AS ord FROM ch, range(12) t(i)),
    d2r AS (SELECT scene_id, i, ord FROM dr UNION ALL SELECT scene_id, 11 + j, (ord + j) % (SELECT count(*) FROM cat) FROM dr, range(1, 13) t(j) WHERE i = 0),
    ds AS (SELECT scene_id, ord, row_number() OVER (PARTITION BY scene_id ORDER BY min(i)) - 1 AS type_idx FROM d2r GROUP BY scene_id, ord),
    kinds AS (
        SELECT ch.scene_id, ch.n, ds.type_idx, object_id, object_name, CAST(cnt AS BIGINT) AS cnt, CAST(sum(cnt) OVER (PARTITION BY ch.scene_id ORDER BY ds.type_idx) - 1 AS BIGINT) AS last_idx
        FROM ch JOIN ds USING (scene_id) JOIN mx ON mx.scene_id = ch.scene_id AND mx.type_idx = ds.type_idx JOIN cat USING (ord)),
    nc AS (SELECT scene_id, object_name, CAST(sum(cnt) AS BIGINT) AS cnt, min(type_idx) AS type_idx FROM kinds GROUP BY scene_id, object_name)
"""
_add("number_scenes", lambda sp, d: _kinds(sp, d), _KINDS_SQL + "SELECT scene_id, n, type_idx, object_id, object_name, cnt, last_idx - cnt + 1 AS first_idx, last_idx FROM kinds")
_add(
    "count_object",
    lambda sp, d: g.count_object(_kinds(sp, d)),
    _KINDS_SQL + "SELECT scene_id, object_name, 'How many ' || object_name || ' in the scene?' AS question, CAST(cnt AS VARCHAR) AS answer FROM nc",
)
for _t in ("most", "least"):
    _best = _KINDS_SQL + f""", fq AS (
        SELECT scene_id, object_name, row_number() OVER (PARTITION BY scene_id ORDER BY cnt {"DESC" if _t == "most" else "ASC"}, type_idx) AS r FROM nc
        WHERE scene_id IN (SELECT scene_id FROM nc GROUP BY scene_id HAVING count(DISTINCT cnt) >= 2))"""
    _add(
        f"frequent_object_{_t}",
        lambda sp, d, t=_t: g.frequent_object(_kinds(sp, d), t),
        _best + f" SELECT scene_id, 'What is the {_t} frequent object in the scene?' AS question, object_name AS answer FROM fq WHERE r = 1",
    )
    _add(
        f"list_attribute_frequent_{_t}",
        lambda sp, d, t=_t: g.list_attribute_frequent(_kinds(sp, d), s.object_values(_values(sp, d)), t),
        _best
        + f" SELECT scene_id, attribute, 'List all ' || attribute || 's in the components of the {_t} frequent object in the scene?' AS question, array_to_string(vals, ', ') AS answer FROM fq JOIN ov USING (object_name) WHERE r = 1",
    )
    _add(
        f"count_attribute_frequent_{_t}",
        lambda sp, d, t=_t: g.count_attribute_frequent(_kinds(sp, d), s.object_values(_values(sp, d)), t),
        _best
        + f" SELECT scene_id, attribute, 'How many ' || attribute || 's are in the components of the {_t} frequent object in the scene?' AS question, CAST(len(vals) AS VARCHAR) AS answer FROM fq JOIN ov USING (object_name) WHERE r = 1",
    )

# distractors, options, tasks
_add(
    "numeric_distractors",
    lambda sp, d: s.object_values(_values(sp, d)).select("object_name", "attribute", F.size("vals").cast("long").alias("count"), F.array_join(distractors.numeric(F.size("vals"), 3).cast("array<string>"), ",").alias("wrong")),
    """, c AS (SELECT object_name, attribute, len(vals) AS count FROM ov),
    x AS (SELECT c.*, v, row_number() OVER (PARTITION BY object_name, attribute ORDER BY k) AS r
          FROM c, LATERAL (SELECT 2 * o AS k, count + o AS v FROM range(1, 4) t(o) UNION ALL SELECT 2 * o + 1, count - o FROM range(1, 4) t(o)) WHERE v >= 0)
    SELECT object_name, attribute, count, string_agg(CAST(v AS VARCHAR), ',' ORDER BY r) AS wrong FROM x WHERE r <= 3 GROUP BY ALL""",
)


def _count_distractors(sp, d):
    named = g.named_counts(_kinds(sp, d))
    per = named.groupBy("scene_id").agg(F.collect_set("cnt").alias("counts"))
    rows = named.join(per, "scene_id")
    return rows.select("scene_id", "object_name", "cnt", F.array_join(distractors.other_counts(F.col("cnt"), F.col("counts")).cast("array<string>"), ",").alias("wrong"))


_add(
    "count_object_distractors",
    _count_distractors,
    _KINDS_SQL
    + """, w AS (
        SELECT a.scene_id, a.object_name, a.cnt, b.cnt AS v FROM nc a JOIN nc b USING (scene_id) UNION
        SELECT scene_id, object_name, cnt, cnt + o FROM nc, (VALUES (-2), (-1), (1), (2)) t(o) WHERE cnt + o >= 0)
    SELECT scene_id, object_name, cnt, string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) AS wrong FROM w WHERE v <> cnt GROUP BY ALL""",
)
_REL_SQL = ", ".join(f"('{r}')" for r in RELATIONS)
_add(
    "relation_distractors",
    lambda sp, d: _pairs(sp, d).select(relations.direction(_at("t"), _at("r")).alias("direction")).distinct().select("direction", F.array_join(distractors.relations(F.col("direction")), "|").alias("wrong")),
    f"SELECT direction, string_agg(r, '|' ORDER BY r) AS wrong FROM (SELECT DISTINCT direction FROM pairs), (VALUES {_REL_SQL}) t(r) WHERE r <> direction GROUP BY direction",
)


def _name_candidates(sp, d, objects=None):
    """Wrong names for the largest object: the scene's other names, then catalog names that aren't in the scene.

    A scene's own names are collected where it is, so nothing is joined but the drawn names. Of the draws at most as many as the scene has names
    are its own: with as many more as it lacks there are enough, and a scene that lacks none draws none.
    """
    objects = scene_objects(sp, d) if objects is None else objects
    rows = g.what_size(objects, "largest", names=True).filter(F.col("scene_id").isNotNull())
    names = catalog(sp, d)
    size = names.count()
    drawn = s.draws_of(size, 12, lambda i: uniform(SEED, "name", F.col("scene_id"), i))
    lacks = 3 - F.size(F.array_remove("own", F.col("answer")))
    drawn = F.slice(drawn, F.lit(1), lacks + F.size("own"))
    every = rows.withColumn("drawn", F.when(lacks > 0, drawn)).select("scene_id", "target_idx", "question", "answer", "own", F.posexplode_outer("drawn").alias("p", "ord"))
    named = names.select("ord", "object_name")
    every = every.join(F.broadcast(named) if size <= FEW else named, "ord", "left")
    found = F.collect_list(F.when(F.col("p").isNotNull(), F.struct("p", "object_name")))
    by = every.groupBy("scene_id").agg(*[F.first(c).alias(c) for c in ("target_idx", "question", "answer", "own")], F.transform(F.array_sort(found), lambda x: x["object_name"]).alias("more"))
    first = distractors.ranked(F.array_remove("own", F.col("answer")), SEED, F.col("scene_id"), "pick")
    rest = F.array_except("more", "own")
    return by.select("scene_id", "target_idx", "question", "answer", F.slice(F.concat(first, rest), 1, 3).alias("wrong"))


_NAMES_SQL = f""", b AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY vol DESC, idx) AS r FROM so),
    f AS (SELECT scene_id, idx AS target_idx, 'What is the largest object in the scene?' AS question, object_name AS answer FROM b WHERE r = 1),
    o1 AS (SELECT DISTINCT so.scene_id, object_name AS w FROM so JOIN f USING (scene_id) WHERE object_name <> answer),
    o2 AS (SELECT scene_id, w, 0 AS part, {order_key_sql(f"'{SEED}'", "scene_id", "'pick'", "w")} AS k FROM o1),
    d0 AS (SELECT scene_id, i, CAST(floor({uniform_sql(f"'{SEED}'", "'name'", "scene_id", "i")} * (SELECT count(*) FROM cat)) AS BIGINT) AS ord FROM f, range(12) t(i)),
    d0r AS (SELECT scene_id, i, ord FROM d0 UNION ALL SELECT scene_id, 11 + j, (ord + j) % (SELECT count(*) FROM cat) FROM d0, range(1, 13) t(j) WHERE i = 0),
    d1 AS (SELECT scene_id, ord, min(i) AS i FROM d0r GROUP BY scene_id, ord),
    d2 AS (SELECT scene_id, object_name AS w, 1 AS part, lpad(CAST(i AS VARCHAR), 3, '0') AS k FROM d1 JOIN cat USING (ord)
           WHERE NOT EXISTS (SELECT 1 FROM so WHERE so.scene_id = d1.scene_id AND so.object_name = cat.object_name)),
    al AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY part, k) AS r FROM (SELECT * FROM o2 UNION ALL SELECT * FROM d2)),
    nw AS (SELECT scene_id, list(w ORDER BY r) AS wrong FROM al WHERE r <= 3 GROUP BY scene_id)"""
_add(
    "name_distractors",
    lambda sp, d: _name_candidates(sp, d).select("scene_id", "answer", F.array_join("wrong", "|").alias("wrong")),
    _NAMES_SQL + " SELECT scene_id, answer, array_to_string(wrong, '|') AS wrong FROM f JOIN nw USING (scene_id)",
)


def _list_candidates(sp, d):
    """Wrong lists: for each draw as many vocabulary values as the answer has, ranked by hash; the answer's own set is left out."""
    ov = s.object_values(_values(sp, d))
    rows = ov.join(s.vocabulary(_values(sp, d)).select("attribute", F.col("values").alias("vocab")), "attribute")
    draws = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.array_join(F.array_sort(F.slice(distractors.ranked(F.col("vocab"), SEED, F.col("object_name"), F.col("attribute"), i), F.lit(1), F.size("vals"))), ", "))
    answer = F.array_join("vals", ", ")
    return rows.select("object_name", "attribute", answer.alias("answer"), F.slice(F.array_distinct(F.filter(draws, lambda x: x != answer)), 1, 3).alias("wrong"))


_add(
    "list_distractors",
    lambda sp, d: _list_candidates(sp, d).select("object_name", "attribute", "answer", F.array_join("wrong", "|").alias("wrong")),
    f""", vc AS (SELECT DISTINCT attribute, value FROM long_),
    rk AS (SELECT object_name, ov.attribute, vals, i, value, row_number() OVER (PARTITION BY object_name, ov.attribute, i ORDER BY {order_key_sql(f"'{SEED}'", "object_name", "ov.attribute", "i", "value")}) AS r
           FROM ov JOIN vc ON ov.attribute = vc.attribute, range(12) t(i)),
    dr AS (SELECT object_name, attribute, i, array_to_string(any_value(vals), ', ') AS answer, string_agg(value, ', ' ORDER BY value) AS w FROM rk WHERE r <= len(vals) GROUP BY object_name, attribute, i),
    fs AS (SELECT object_name, attribute, answer, w, min(i) AS i FROM dr WHERE w <> answer GROUP BY ALL),
    tp AS (SELECT *, row_number() OVER (PARTITION BY object_name, attribute ORDER BY i) AS r FROM fs),
    ag AS (SELECT object_name, attribute, string_agg(w, '|' ORDER BY r) AS wrong FROM tp WHERE r <= 3 GROUP BY object_name, attribute)
    SELECT ov.object_name, ov.attribute, array_to_string(vals, ', ') AS answer, coalesce(wrong, '') AS wrong FROM ov LEFT JOIN ag USING (object_name, attribute)""",
)


def _options(sp, d, objects=None):
    return distractors.with_options(_name_candidates(sp, d, objects), "answer", "wrong", 4, SEED, F.col("scene_id"))


_OPTIONS_SQL = _NAMES_SQL + f""", op AS (
        SELECT f.scene_id, target_idx, question, answer, list(x ORDER BY {order_key_sql(f"'{SEED}'", "f.scene_id", "'mix'", "x")}) AS options
        FROM f JOIN nw USING (scene_id), LATERAL (SELECT unnest(list_append(wrong, answer)) AS x) WHERE len(wrong) = 3 GROUP BY ALL)"""
_add(
    "compose_options",
    lambda sp, d: _options(sp, d).select("scene_id", "answer", F.array_join("options", "|").alias("options")),
    _OPTIONS_SQL + " SELECT scene_id, answer, array_to_string(options, '|') AS options FROM op",
)


def _first_seen(sp, d):
    rows = g.what_distance(scene_objects(sp, d), "closest", ids=True)
    kept = g.first_seen(rows, ["target_id", "ref_id"], ["scene_id", "ref_idx"])
    return kept.select("scene_id", "ref_idx", "target_idx", "ref_id", "target_id", "question", "answer")


_add(
    "dedupe_first_seen",
    _first_seen,
    """, b AS (SELECT *, row_number() OVER (PARTITION BY scene_id, ref_idx ORDER BY d2, target_idx) AS r FROM pairs WHERE n >= 3),
    k AS (SELECT b.*, ra.object_id AS ref_id, ta.object_id AS target_id FROM b JOIN so ra ON ra.scene_id = b.scene_id AND ra.idx = b.ref_idx JOIN so ta ON ta.scene_id = b.scene_id AND ta.idx = b.target_idx WHERE b.r = 1),
    q AS (SELECT *, row_number() OVER (PARTITION BY target_id, ref_id ORDER BY scene_id, ref_idx) AS rr FROM k)
    SELECT scene_id, ref_idx, target_idx, ref_id, target_id, 'What is the object that is closest from the ' || ref_name || '?' AS question, target_name AS answer FROM q WHERE rr = 1""",
)


def _records(sp, d):
    """Task records of every scene that has options, numbered by scene."""
    made = numbered(_options(sp, d), "scene_id", "question_id")
    number = F.col("question_id").cast("string")
    point = F.concat(F.when(F.length(number) < 6, F.lpad(number, 6, "0")).otherwise(number), F.lit(".npy"))
    return made.select("question_id", point.alias("point"), relations.category(F.lit("what_size"), F.lit(None).cast("string")).alias("category"), "question", F.array_join("options", "|").alias("options"), "answer")


RECORDS_SQL = (
    _OPTIONS_SQL
    + """, l AS (SELECT *, row_number() OVER (ORDER BY scene_id) - 1 AS question_id FROM op)
    SELECT question_id, CASE WHEN question_id < 1000000 THEN lpad(CAST(question_id AS VARCHAR), 6, '0') ELSE CAST(question_id AS VARCHAR) END || '.npy' AS point,
           'what_size_' AS category, question, array_to_string(options, '|') AS options, answer FROM l"""
)
_add("task_records", _records, RECORDS_SQL)


# geometry of layouts
def _boxes(sp, d):
    """Scene objects shrunk to the scene's bounds, so that some overlap and some don't."""
    o = scene_objects(sp, d)
    return o.select("scene_id", "idx", (F.col("px") - 25).alias("x"), (F.col("py") / 10).alias("y"), (F.col("pz") * 2 - 10).alias("z"), (F.col("hx") / 10).alias("hx"), (F.col("hy") / 10).alias("hy"), F.col("hz"))


_BOXES_SQL = ", bx AS (SELECT scene_id, idx, px - 25 AS x, py / 10 AS y, pz * 2 - 10 AS z, hx / 10 AS hx, hy / 10 AS hy, hz FROM so)"


def _in_bounds(sp, d):
    from ..operators.geometry import in_bounds

    return _boxes(sp, d).select("scene_id", "idx", in_bounds().alias("inside"))


def _collisions(sp, d):
    from ..operators.geometry import collisions

    return collisions(_boxes(sp, d))


_add("layout_bounds", _in_bounds, _BOXES_SQL + " SELECT scene_id, idx, y - hy >= -0.05 AND abs(x) + hx <= 8.0 AND abs(z) + hz <= 8.0 AS inside FROM bx")
_add(
    "layout_collisions",
    _collisions,
    _BOXES_SQL
    + """, pr AS (
        SELECT a.scene_id, a.idx AS idx_a, b.idx AS idx_b, abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy, abs(a.z - b.z) AS dz,
               a.hx AS ax, b.hx AS bx_, a.hy AS ay, b.hy AS by_, a.hz AS az, b.hz AS bz
        FROM bx a JOIN bx b ON a.scene_id = b.scene_id AND a.idx < b.idx)
    SELECT scene_id, idx_a, idx_b FROM pr
    WHERE dx < ax + bx_ + 0.05 AND dy < ay + by_ + 0.05 AND dz < az + bz + 0.05
      AND NOT (dx < greatest(ax, bx_) AND dz < greatest(az, bz) AND abs(dy - (ay + by_)) < 0.05 * 3)""",
)
