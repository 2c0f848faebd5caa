"""Task sets from files: every question type, checked against the scene it was made from."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenewright.plans import generate as gen
from scenewright.schema import KINDS, TaskPlan
from scenewright.sources import files

from .core_data import catalog_lines, layouts


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("in")
    (folder / "catalog.jsonl").write_text(catalog_lines(40))
    (folder / "layouts.json").write_text(json.dumps(layouts()))
    return gen.Inputs(spark, files.read_catalog(spark, str(folder / "catalog.jsonl")), files.read_layouts(spark, str(folder / "layouts.json")))


@pytest.mark.parametrize("kind", sorted(KINDS))
def test_tasks_of_each_type(inputs, kind):
    plan = TaskPlan(kind, 4, 7, KINDS[kind][-1])
    rows = gen.tasks(inputs, plan, 6).collect()
    assert 1 <= len(rows) <= 6
    assert [r.question_id for r in sorted(rows, key=lambda r: r.question_id)] == list(range(len(rows)))
    for r in rows:
        assert r.answer in r.options and len(set(r.options)) == len(r.options) == 4
        assert r.point == f"{r.question_id:06d}.npy" and r.category.startswith(kind + "_") and "null" not in r.question
    assert len({(r.question, r.answer, r.scene_id) for r in rows}) == len(rows)
    again = gen.tasks(inputs, plan, 6).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_answers_follow_from_the_scene(inputs):
    plan = TaskPlan("what_distance", 3, 5, {"distance_type": "farthest"})
    rows = gen.tasks(inputs, plan, 8).collect()
    last = max(r.scene_id for r in rows) + 1
    scenes = {}
    for o in gen.attempts(inputs, inputs.special, 5, 0, last).collect():
        scenes.setdefault(o.scene_id, []).append(o)
    for r in rows:
        objects = sorted(scenes[r.scene_id], key=lambda o: o.idx)
        assert 3 <= len(objects) <= 9 and len({o.object_id for o in objects}) == len(objects)
        at = lambda o: np.array([o.px, o.py, o.pz])
        possible = set()
        for ref in objects:
            if r.question == f"What is the object that is farthest from the {ref.object_name}?":
                rest = [o for o in objects if o.idx != ref.idx]
                possible.add(max(rest, key=lambda o: (((at(o) - at(ref)) ** 2).sum(), -o.idx)).object_name)
        assert r.answer in possible


def test_plans_are_checked():
    with pytest.raises(ValueError):
        TaskPlan("what_color")
    with pytest.raises(ValueError):
        TaskPlan("what_distance", generator_config={})
    with pytest.raises(ValueError):
        TaskPlan("count_object", num_options=7)
    assert TaskPlan("where_size", generator_config={"size_type": "largest"}).num_options == 4
    assert len(gen.all_plans()) == sum(map(len, KINDS.values()))


def test_generate_writes_everything(spark, inputs, tmp_path):
    ids = [r.object_id for r in inputs.catalog.collect()]
    rng = np.random.default_rng(0)
    points = [(i, k, *map(float, rng.uniform(-1, 1, 3))) for i in ids for k in range(5)]
    clouds = spark.createDataFrame(points, "cloud_id string, pt long, x double, y double, z double")
    folder = f"file://{tmp_path}/out"
    plan = TaskPlan("where_distance", 4, 3, {"distance_type": "closest"})
    info = gen.generate(inputs, plan, 5, folder, clouds)
    n = info["generation_stats"]["num_tasks_generated"]
    assert n == 5 and json.loads((tmp_path / "out/tasks_info.json").read_text()) == info
    lines = [json.loads(x) for f in sorted((tmp_path / "out/tasks").glob("*.json")) for x in f.read_text().splitlines()]
    assert len(lines) == n and list(lines[0]) == ["question_id", "point", "category", "question", "options", "answer"]
    for line in lines:
        cloud = np.load(tmp_path / "out/pcd" / line["point"])
        assert cloud.shape[1] == 3 and len(cloud) % 5 == 0
    scenes = [json.loads(x) for f in (tmp_path / "out/pcd_metadata").glob("*.json") for x in f.read_text().splitlines()]
    assert len(scenes) == n and all(x["objects"]["count"] == len(x["objects"]["details"]) for x in scenes)


def test_scarce_catalog_gives_fewer_tasks(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text(catalog_lines())
    (tmp_path / "l.json").write_text(json.dumps(layouts()[:1]))
    few = gen.Inputs(spark, files.read_catalog(spark, str(tmp_path / "c.jsonl")), files.read_layouts(spark, str(tmp_path / "l.json")))
    rows = gen.tasks(few, TaskPlan("what_size", 3, 1, {"size_type": "largest"}), 500, rounds=2).collect()
    assert 0 < len(rows) <= 6  # one for each object that can be the largest
    assert few.standard.count() == 1
    with pytest.raises(ValueError):
        files.split_layouts(files.read_layouts(spark, str(tmp_path / "l.json")).filter(F.lit(False)))


def test_wrong_answers_come_from_the_scene_first(inputs):
    """Names out of the scene are among the options only where the scene has too few others."""
    plan = TaskPlan("what_size", 4, 3, {"size_type": "largest"})
    made = gen.tasks(inputs, plan, 12).cache()
    scenes = {}
    for o in gen.task_scenes(inputs, plan, made).collect():
        scenes.setdefault(o.scene_id, set()).add(o.object_name)
    for r in made.collect():
        own = scenes[r.scene_id]
        assert len(set(r.options) - own) == max(0, 4 - len(own))


@pytest.mark.parametrize("kind", ["list_attribute_frequent", "count_attribute_frequent"])
def test_attributes_of_frequent_kinds(inputs, kind):
    """The answer is of the first object with the name; what the scene's other kinds have comes first among the wrong answers."""
    plan = TaskPlan(kind, 3, 5, {"frequency_type": "most"})
    made = gen.tasks(inputs, plan, 8).cache()
    names = {r.object_id: r.object_name for r in inputs.catalog.collect()}
    values = {}
    for r in inputs.values.collect():
        values.setdefault((r.object_name, r.attribute), set()).add(r.value)
    said = lambda i, a: ", ".join(sorted(values.get((i, a), ()))) if kind.startswith("list") else str(len(values.get((i, a), ())))
    first = {}
    for i, name in sorted(names.items()):
        first.setdefault(name, i)
    scenes = {}
    for o in gen.task_scenes(inputs, plan, made).collect():
        scenes.setdefault(o.scene_id, []).append(o)
    rows = made.collect()
    assert rows
    for r in rows:
        objects = scenes[r.scene_id]
        count = {n: sum(o.object_name == n for o in objects) for n in {o.object_name for o in objects}}
        attribute = next(a for a in ("material", "color", "shape", "texture") if f" {a}s " in r.question)
        top = [n for n, c in count.items() if c == max(count.values())]
        assert r.answer in {said(first[n], attribute) for n in top}
        others = {said(o.object_id, attribute) for o in objects if o.object_name not in top} - {r.answer, ""}
        wrong = set(r.options) - {r.answer}
        if len(top) == 1:
            assert wrong <= others if len(others) >= 2 else others <= wrong


def test_number_scenes_have_clouds_and_metadata(spark, inputs, tmp_path):
    ids = [r.object_id for r in inputs.catalog.collect()]
    clouds = spark.createDataFrame([(i, k, k / 3, 1.0 * k, 0.5, 0.1, 0.2, 0.3) for i in ids for k in range(4)], "cloud_id string, pt long, x double, y double, z double, r double, g double, b double")
    gen.generate(inputs, TaskPlan("count_object", 3, 2), 4, f"file://{tmp_path}/n", clouds)
    lines = [json.loads(x) for f in sorted((tmp_path / "n/tasks").glob("*.json")) for x in f.read_text().splitlines()]
    scenes = {x["scene_id"]: x for f in (tmp_path / "n/pcd_metadata").glob("*.json") for x in map(json.loads, f.read_text().splitlines())}
    assert len(lines) == len(scenes) == 4
    for line in lines:
        scene = scenes[line["question_id"]]
        name = line["question"].removeprefix("How many ").removesuffix(" in the scene?")
        assert sum(o["name"] == name for o in scene["objects"]["details"]) == int(line["answer"])
        cloud = np.load(tmp_path / "n/pcd" / line["point"])
        assert cloud.shape == (4 * scene["objects"]["count"], 6) and (cloud[:, 3:] == [0.1, 0.2, 0.3]).all()
        assert "[" not in scene["layout_description"]
