"""Encoders, caches, baselines and the batch of layouts."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenewright.operators import models
from scenewright.plans import layout_queries, layouts
from scenewright.sources import providers


def test_embeddings_are_unit_and_similar_texts_are_near(spark):
    rows = [(0, "a table", "What is the largest object?", "table"), (1, "a table", "What is the largest object?", "tables"), (2, "zzz", "qqq", "xyxy"), (3, None, "", None)]
    got = {r.task_id: np.array(r.embedding) for r in models.embed_tasks(spark.createDataFrame(rows, "task_id long, layout_text string, question string, answer string")).collect()}
    assert len(got[0]) == 3 * models.DIM and abs(np.linalg.norm(got[0]) - 1) < 1e-6
    assert got[0] @ got[1] > 0.8 > 0.5 > got[0] @ got[2]


def test_choice_search(spark):
    rows = spark.createDataFrame([(0, "the dark blue one", ["red", "dark blue"]), (1, None, ["a"]), (2, "x", [])], "id long, answer string, choices array<string>")
    assert {r.id: r.resolved for r in models.search_choice(rows).collect()} == {0: "dark blue", 1: "a", 2: None}


def test_only_misses_are_inferred(spark):
    prompts = spark.createDataFrame([("k1", "p1"), ("k2", "p2"), ("k2", "p2"), ("k3", "none")], "key string, prompt string")
    cache = spark.createDataFrame([("k1", "kept"), ("k2", None)], "key string, response string")
    asked = spark.sparkContext.accumulator(0)

    def model(rows):
        @F.udf("string")
        def answer(p):
            asked.add(1)
            return None if p == "none" else p.upper()

        return rows.withColumn("response", answer("prompt"))

    answers, after = models.infer(prompts, cache, model)
    assert sorted((r.key, r.response) for r in answers.collect()) == [("k1", "kept"), ("k2", "P2"), ("k2", "P2"), ("k3", None)]
    assert {r.key for r in after.collect()} == {"k1", "k2"} and asked.value > 0


def test_baselines(spark):
    p = spark.createDataFrame([("q", ["ab", "abcd", "abc"])], "q string, c array<string>").select(models.prompt(F.col("q"), F.col("c")).alias("prompt"))
    assert models.model("longest-option")(p).first().response == "(B) abcd" and models.model("first-option")(p).first().response == "A"
    with pytest.raises(ValueError):
        models.model("unknown")


def test_sampled_names_are_clamped(spark):
    names = ["a", "b", "c", "d"]
    for count, want in ((1, {2}), (3, {3}), (50, {4}), (None, {2, 3, 4})):
        rows = models.sample_names(spark.range(60), names, 1, count).collect()
        assert {len(r.names) for r in rows} == want and all(len(set(r.names)) == len(r.names) for r in rows)


def test_batch_of_layouts(spark, tmp_path):
    responses = spark.createDataFrame(layout_queries._responses(), "id long, response string")
    lists = spark.createDataFrame([(i, ["table", "lamp"]) for i in range(40)], "id long, names array<string>")
    asked = layouts.prompts(lists).collect()
    assert '["table", "lamp"]' in asked[0].prompt
    answer = lambda p: providers.recorded(p, responses).filter("status = 'ok'").select("id", "response")
    summary = layouts.generate_batch(lists, answer, 3, 5, f"file://{tmp_path}", "recorded")
    assert summary["num_templates"] == 6 and 12 <= summary["num_layouts"] <= 18
    assert json.loads((tmp_path / "summary.json").read_text()) == summary
    rows = [json.loads(x) for f in (tmp_path / "layouts").glob("*.json") for x in f.read_text().splitlines()]
    assert len(rows) == summary["num_layouts"] and all(o["name"].startswith("obj_") for r in rows for o in r["objects"])
    assert {r["template_id"] for r in rows} <= set(range(6))
