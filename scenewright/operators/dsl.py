"""Scene descriptions in JSON: extraction, validation rule by rule, templates, dependency structure.

Everything is a column expression over variants, so a table of responses is validated in one scan. What many expressions use is made once a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..enums import LEAST_OBJECTS, MOST_OBJECTS, RELATIONS, SIZES
from ..functions.relations import abstract_names
from .numbering import once

FENCED = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"


def extract_json(response: Column) -> Column:
    """The JSON text of a response: the fenced block if there is one, else the whole."""
    block = F.regexp_extract(response, FENCED, 1)
    return F.when(block != "", block).otherwise(response)


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _has(v: Column, field: str) -> Column:
    return _get(v, f"$.{field}", "variant").isNotNull()


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(_get(v, path, "variant"))


def _is_text(v: Column, path: str) -> Column:
    return _kind(v, path) == "STRING"


def _say(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _show(v: Column, path: str) -> Column:
    return F.coalesce(_get(v, path, "string"), F.lit("None"))


def _first(*errors: Column) -> Column:
    return F.coalesce(*errors)


def _list(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _object_error(o: Column, i: Column) -> Column:
    at = _say("Object ", i.cast("string"), ": ")
    missing = [F.when(~_has(o, f), _say(at, f"missing required field '{f}'")) for f in ("name", "size", "rotation")]
    number = _kind(o, "$.rotation").rlike("^(BIGINT|DOUBLE|DECIMAL.*|BOOLEAN|FLOAT|INT|SMALLINT|TINYINT)$")
    return _first(
        *missing,
        F.when(~_is_text(o, "$.name") | (F.trim(_get(o, "$.name", "string")) == ""), _say(at, "'name' must be a non-empty string")),
        F.when(~F.coalesce(_is_text(o, "$.size") & _get(o, "$.size", "string").isin(*SIZES), F.lit(False)), _say(at, "invalid size '", _show(o, "$.size"), f"'. Must be one of {_list(SIZES)}")),
        F.when(~F.coalesce(number, F.lit(False)), _say(at, "'rotation' must be a number")),
    )


def _relation_error(r: Column, i: Column, names: Column) -> Column:
    at = _say("Relation ", i.cast("string"), ": ")
    s, t, k = (_get(r, f"$.{f}", "string") for f in ("subject", "reference", "relation"))
    missing = [F.when(~_has(r, f), _say(at, f"missing required field '{f}'")) for f in ("subject", "relation", "reference")]
    known = lambda x: F.coalesce(F.array_contains(names, x), F.lit(False))
    return _first(
        *missing,
        F.when(~known(s), _say(at, "subject '", _show(r, "$.subject"), "' not found in objects")),
        F.when(~known(t), _say(at, "reference '", _show(r, "$.reference"), "' not found in objects")),
        F.when(s == t, _say(at, "subject and reference cannot be the same object")),
        F.when(~F.coalesce(k.isin(*RELATIONS), F.lit(False)), _say(at, "invalid relation '", _show(r, "$.relation"), f"'. Must be one of {_list(RELATIONS)}")),
    )


def _least(errors: Column) -> Column:
    return F.get(F.filter(errors, lambda e: e.isNotNull()), F.lit(0))


def validate(responses: DataFrame, text: str = "response") -> DataFrame:
    """The rows with ``dsl`` (variant), ``is_valid`` and ``error``, the message of the first rule that fails.

    A null response, and one that isn't a JSON object, is invalid: its error is ``Invalid JSON``. Repeated object names
    are invalid too, since relations couldn't tell them apart.
    """
    rows = once(responses, dsl=F.try_parse_json(extract_json(F.col(text))))
    d = F.col("dsl")
    rows = once(
        rows,
        o_=F.try_variant_get(d, "$.objects", "array<variant>"),
        r_=F.try_variant_get(d, "$.relations", "array<variant>"),
        t_=F.coalesce(_get(d, "$.description", "string"), _get(d, "$.descirption", "string"), F.lit("")),
    )
    rows = once(rows, n_=F.transform("o_", lambda o: _get(o, "$.name", "string")), z_=F.transform("o_", lambda o: _get(o, "$.size", "string")))
    count = F.size("o_")
    absent = F.filter("n_", lambda n: ~F.contains(F.lower("t_"), F.lower(n)))
    error = _first(
        F.when(d.isNull() | ~F.schema_of_variant(d).startswith("OBJECT"), "Invalid JSON"),
        F.when(~_has(d, "description") & ~_has(d, "descirption"), "Missing required field 'description'"),
        F.when(~_has(d, "objects"), "Missing required field 'objects'"),
        F.when(F.col("o_").isNull(), "'objects' must be a list"),
        F.when((count < LEAST_OBJECTS) | (count > MOST_OBJECTS), _say(f"Object count must be between {LEAST_OBJECTS} and {MOST_OBJECTS}, got ", count.cast("string"))),
        _least(F.transform("o_", _object_error)),
        F.when(~F.array_contains("z_", "largest"), "Missing required 'largest' sized object"),
        F.when(~F.array_contains("z_", "smallest"), "Missing required 'smallest' sized object"),
        F.when(~_has(d, "relations"), "Missing required field 'relations'"),
        F.when(F.col("r_").isNull(), "'relations' must be a list"),
        _least(F.transform("r_", lambda r, i: _relation_error(r, i, F.col("n_")))),
        F.when(F.size(absent) > 0, _say("Description must contain object name '", F.get(absent, F.lit(0)), "'")),
        F.when(F.size(F.array_distinct("n_")) < count, "Object names must be different"),
    )
    return once(rows, error=error).withColumn("is_valid", F.col("error").isNull()).drop("o_", "r_", "t_", "n_", "z_")


DSL = "struct<description:string,objects:array<struct<name:string,size:string,rotation:double>>,relations:array<struct<subject:string,relation:string,reference:string>>>"


def parse(validated: DataFrame) -> DataFrame:
    """The valid rows with ``scene``: description, objects and relations as typed columns."""
    d = F.col("dsl")
    objects = F.try_variant_get(d, "$.objects", "array<struct<name:string,size:string,rotation:double>>")
    relations = F.coalesce(F.try_variant_get(d, "$.relations", "array<struct<subject:string,relation:string,reference:string>>"), F.array().cast("array<struct<subject:string,relation:string,reference:string>>"))
    text = F.coalesce(_get(d, "$.description", "string"), _get(d, "$.descirption", "string"))
    return once(validated.filter("is_valid"), scene=F.struct(text.alias("description"), objects.alias("objects"), relations.alias("relations"))).drop("dsl", "error", "is_valid")


def abstract(parsed: DataFrame) -> DataFrame:
    """``template`` from ``scene``: names become obj_0, obj_1 and so on, in brackets in the description."""
    s, names = F.col("scene"), F.col("names_")
    parsed = once(parsed, names_=F.transform(s["objects"], lambda o: o["name"]))
    label = lambda n: F.concat(F.lit("obj_"), (F.array_position(names, n) - 1).cast("string"))
    objects = F.transform(s["objects"], lambda o, i: F.struct(F.concat(F.lit("obj_"), i.cast("string")).alias("name"), o["size"].alias("size"), o["rotation"].alias("rotation")))
    relations = F.transform(s["relations"], lambda r: F.struct(label(r["subject"]).alias("subject"), r["relation"].alias("relation"), label(r["reference"]).alias("reference")))
    template = F.struct(abstract_names(s["description"], names).alias("description"), objects.alias("objects"), relations.alias("relations"))
    return once(parsed, template=template).drop("names_")


def edges(parsed: DataFrame, key: str) -> DataFrame:
    """(key, reference, subject) of each relation."""
    return parsed.select(key, F.explode("scene.relations").alias("r")).select(key, F.col("r.reference").alias("reference"), F.col("r.subject").alias("subject"))


def in_degree(parsed: DataFrame, key: str) -> DataFrame:
    """(key, name, in_degree) of every object: relations that it is the subject of."""
    objects = parsed.select(key, F.explode("scene.objects").alias("o")).select(key, F.col("o.name").alias("name"))
    n = edges(parsed, key).groupBy(key, F.col("subject").alias("name")).agg(F.count("*").alias("in_degree"))
    return objects.join(n, [key, "name"], "left").select(key, "name", F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def depths(parsed: DataFrame, key: str) -> DataFrame:
    """(key, name, depth) of every object: the links of the longest chain of references that leads to it, at most MOST_OBJECTS, as in a cycle there is no last.

    A description is one row's work: ``ends_`` has, for each number of links from 0, the objects in which a chain of so many ends.
    """
    names = F.transform("scene.objects", lambda o: o["name"])
    after = lambda ends: F.array_distinct(F.transform(F.filter("scene.relations", lambda r: F.array_contains(ends, r["reference"])), lambda r: r["subject"]))
    ends = F.aggregate(F.sequence(F.lit(1), F.lit(MOST_OBJECTS)), F.array(names), lambda found, _: F.concat(found, F.array(after(F.element_at(found, -1)))))
    rows = parsed.select(key, ends.alias("ends_"), F.explode(names).alias("name"))
    depth = F.array_max(F.transform("ends_", lambda e, k: F.when(F.array_contains(e, F.col("name")), k)))
    return rows.groupBy(key, "name").agg(F.max(depth).cast("long").alias("depth"))


def user_prompt(names: Column) -> Column:
    """The request for a scene of the given objects."""
    quoted = F.array_join(F.transform(names, lambda n: F.concat(F.lit('"'), n, F.lit('"'))), ", ")
    return F.concat(F.lit("Describe a scene in the DSL with these objects: ["), quoted, F.lit("]"))
