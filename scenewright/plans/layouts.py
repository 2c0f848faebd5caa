"""Layouts from lists of object names: prompts, responses, validated descriptions, templates, solved placements."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dsl, solver
from ..operators.numbering import numbered
from ..sources import sinks


LAYOUTS = "template_id long, variant int, description string, objects array<struct<place_idx:int,name:string,position:array<double>,rotation:double,size:array<double>>>, relations array<struct<subject:string,relation:string,reference:string>>"


def prompts(lists: DataFrame) -> DataFrame:
    """(id, prompt) of ``lists`` (id, names)."""
    return lists.select("id", dsl.user_prompt(F.col("names")).alias("prompt"))


def templates(responses: DataFrame) -> DataFrame:
    """(template_id, id, scene) of the valid responses (id, response): names are placeholders, numbers follow the ids.

    One response an id counts: the first by ``order``, a column that says when it was seen, or by its text without one.
    """
    first = F.min_by("response", "order") if "order" in responses.columns else F.min("response")
    one = responses.filter("id is not null and response is not null").groupBy("id").agg(first.alias("response"))
    made = dsl.abstract(dsl.parse(dsl.validate(one)))
    return numbered(made, "id", "template_id").select("template_id", "id", F.col("template").alias("scene"))


def layouts(templates_: DataFrame, variants: int, seed: int) -> DataFrame:
    """(template_id, variant, description, objects, relations) of the solved placements."""
    placed = solver.solve_templates(templates_, variants, seed).filter("solved")
    one = F.struct("place_idx", "name", F.array("x", "y", "z").alias("position"), "rotation", F.array("hx", "hy", "hz").alias("size"))
    rows = placed.groupBy("template_id", "variant").agg(F.array_sort(F.collect_list(one)).alias("objects"))
    text = templates_.select("template_id", "scene.description", "scene.relations")
    return rows.join(text, "template_id").select("template_id", "variant", "description", "objects", "relations")


def generate_batch(lists: DataFrame, answer: Callable[[DataFrame], DataFrame], variants: int, seed: int, folder: str, model: str = "", documents: bool = False) -> dict:
    """Prompts for ``lists``, their answers (id, response), and templates and layouts as JSON lines below ``folder``; returns the summary.

    ``documents`` adds both as one JSON document each, streamed through the driver.
    """
    made = templates(answer(prompts(lists)))
    made.write.mode("overwrite").json(f"{folder}/templates")
    kept = made.sparkSession.read.schema(made.schema).json(f"{folder}/templates")
    layouts(kept, variants, seed).write.mode("overwrite").json(f"{folder}/layouts")
    n = kept.sparkSession.read.text(f"{folder}/layouts").count()
    if documents:
        sinks.write_array(kept.orderBy("template_id"), f"{folder}/templates.json")
        solved = kept.sparkSession.read.schema(LAYOUTS).json(f"{folder}/layouts")
        sinks.write_array(solved.orderBy("template_id", "variant"), f"{folder}/layouts.json")
    summary = {"generated_at": datetime.datetime.now().isoformat(), "num_templates": kept.count(), "num_layouts": n, "model": model}
    sinks.write_document(f"{folder}/summary.json", summary)
    return summary
