"""The candidate pool and the evaluation over a small catalog."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenewright.operators import evaluation, models
from scenewright.plans import generate as gen
from scenewright.plans import pool
from scenewright.sources import files

from .core_data import catalog_lines, layouts


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("in")
    (folder / "catalog.jsonl").write_text(catalog_lines(30))
    (folder / "layouts.json").write_text(json.dumps(layouts()))
    return gen.Inputs(spark, files.read_catalog(spark, str(folder / "catalog.jsonl")), files.read_layouts(spark, str(folder / "layouts.json")))


def test_evaluation_spends_its_budget(spark, inputs, tmp_path):
    ids = [r.object_id for r in inputs.catalog.collect()]
    clouds = spark.createDataFrame([(i, k, k / 3, 1.0 * k, 0.5) for i in ids for k in range(3)], "cloud_id string, pt long, x double, y double, z double")
    config = pool.EvalConfig(7, 4, 6, 0.2, 3)
    done = pool.evaluate(inputs, models.model("first-option"), config, f"file://{tmp_path}/e", clouds, kinds=["what_size", "count_object"])
    rows = sorted(done.collect(), key=lambda r: r.task_id)
    assert [r.task_id for r in rows] == list(range(7)) and [r.step for r in rows] == [0] * 4 + [1] * 3
    text = json.loads((tmp_path / "e/results.json").read_text())
    failed = [r.task_id for r in rows if not r.is_correct]
    assert text["config"]["budget"] == 7 and text["stats"] == {"total": 7, "errors": len(failed), "error_rate": round(len(failed) / 7, 6), "error_indices": failed}
    assert [r["task_id"] for r in text["results"]] == list(range(7)) and all(r["is_correct"] == (r["answer"] == r["options"][0]) for r in text["results"])
    assert {r["category"] for r in text["results"]} == {"what_size", "count_object"} and all(r["utility"] is None for r in text["results"][:4])
    # the later ones are the best of their pool by utility to what was known then
    second = spark.read.parquet(f"{tmp_path}/e/pools/step=1").collect()
    known = np.array([r.embedding for r in rows[:4]])
    bad = np.array([not r.is_correct for r in rows[:4]])
    v = models.hashed_ngrams
    made = np.hstack([v([r[c] for r in second]) for c in ("layout_text", "question", "answer")])
    made /= np.linalg.norm(made, axis=1, keepdims=True) + 1e-8
    sim = made @ known.T
    utility = (sim[:, bad].max(1) if bad.any() else 0) - 0.2 * sim.max(1)
    assert np.allclose(sorted(r.utility for r in rows[4:]), np.sort(utility)[-3:], atol=1e-6)
    if failed:
        hard = [json.loads(x) for f in (tmp_path / "e/hard_data/tasks").glob("*.json") for x in f.read_text().splitlines()]
        assert sorted(r["question_id"] for r in hard) == list(range(len(failed)))
        assert all(np.load(tmp_path / "e/hard_data/pcd" / r["point"]).shape[1] == 3 for r in hard)


def test_a_task_without_a_description_is_noticed(spark):
    bare = spark.createDataFrame([(None, None)], "layout_text string, scene_objects array<struct<name:string,object_id:string,placeholder:string>>")
    with pytest.raises(Exception, match="no description"):
        pool.checked(bare).collect()
    with pytest.raises(ValueError):
        pool.EvalConfig(budget=0)


def test_utility_in_blocks_is_the_same(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 5))
    e = spark.createDataFrame([(i, x.tolist(), bool(i % 3)) for i, x in enumerate(v)], "task_id long, embedding array<double>, is_correct boolean")
    tested, rest = e.filter("task_id < 25"), e.filter("task_id >= 25")
    one = {r.task_id: r.utility for r in evaluation.utility(rest, tested).collect()}
    many = {r.task_id: r.utility for r in evaluation.utility(rest, tested, block=4).collect()}
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-12 for k in one)
    none = evaluation.utility(rest, tested.filter(F.lit(False)))
    assert {r.utility for r in none.collect()} == {0.0}
