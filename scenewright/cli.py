"""The command line: task sets, layouts from recorded descriptions, and evaluations.

``python -m scenewright.cli tasks --catalog c.jsonl --layouts l.json --type what_distance --config distance_type=closest --number 100 --out DIR``
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import models
from .plans import generate, layouts, pool
from .schema import KINDS, TaskPlan
from .session import local_session, ship
from .sources import files


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="scenewright", description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    tasks, scenes, evaluate = sub.add_parser("tasks"), sub.add_parser("layouts"), sub.add_parser("evaluate")
    for x in (tasks, evaluate):
        x.add_argument("--catalog", required=True)
        x.add_argument("--layouts", required=True)
        x.add_argument("--clouds", help="a folder of point files, named by object id")
    for x in (tasks, scenes, evaluate):
        x.add_argument("--out", required=True)
        x.add_argument("--seed", type=int, default=42)
    tasks.add_argument("--type", choices=sorted(KINDS), required=True)
    tasks.add_argument("--number", type=int, default=100)
    tasks.add_argument("--options", type=int, default=4)
    tasks.add_argument("--config", nargs="*", default=[], metavar="NAME=VALUE")
    scenes.add_argument("--names", required=True, help="object names, comma-separated")
    scenes.add_argument("--lists", type=int, default=100, help="how many lists of names are sampled")
    scenes.add_argument("--responses", required=True, help="recorded descriptions: JSON lines of id and response")
    scenes.add_argument("--variants", type=int, default=4)
    evaluate.add_argument("--model", choices=sorted(models.MODELS), default="first-option")
    for name, value in (("budget", 100), ("batch-size", 10), ("pool-size", 1000)):
        evaluate.add_argument(f"--{name}", type=int, default=value)
    evaluate.add_argument("--weight", type=float, default=0.2)
    return p


def _at(path: str) -> str:
    import os

    return path if "://" in path else "file://" + os.path.abspath(path)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    """Runs one command and prints its summary as JSON, which is returned too. A session that is running is used."""
    a = _parser().parse_args(arguments)
    spark = spark or SparkSession.getActiveSession() or local_session()
    ship(spark)
    out = _at(a.out)
    if a.what == "layouts":
        lists = models.sample_names(spark.range(a.lists), a.names.split(","), a.seed)
        recorded = spark.read.schema("id long, response string").json(_at(a.responses))
        made = layouts.generate_batch(lists, lambda p: p.join(recorded, "id").select("id", "response"), a.variants, a.seed, out, "recorded", documents=True)
    else:
        inputs = generate.Inputs(spark, files.read_catalog(spark, _at(a.catalog)), files.read_layouts(spark, _at(a.layouts)))
        clouds = files.read_points(spark, _at(a.clouds)) if a.clouds else None
        if a.what == "tasks":
            plan = TaskPlan(a.type, a.options, a.seed, dict(x.split("=", 1) for x in a.config))
            made = generate.generate(inputs, plan, a.number, out, clouds, documents=True)
        else:
            config = pool.EvalConfig(a.budget, a.batch_size, a.pool_size, a.weight, a.seed)
            done = pool.evaluate(inputs, models.model(a.model), config, out, clouds)
            made = done.agg(F.count("*").alias("total"), F.count_if(~F.col("is_correct")).alias("errors")).first().asDict()
    print(json.dumps(made))
    return made


if __name__ == "__main__":
    main()
