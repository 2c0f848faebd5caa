"""Micro-fixtures of scenes, descriptions, placement, clouds, answers and selection, worked out by hand."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenewright import enums, rng
from scenewright.functions import distractors, relations
from scenewright.operators import clouds, dsl, evaluation, generators, geometry, scenes, solver
from scenewright.plans import layout_queries
from scenewright.sources import files, providers, sinks
from scenewright.streaming import history

from .core_data import catalog_lines, layouts

OBJECT = "scene_id long, idx long, object_id string, object_name string, px double, py double, pz double, hx double, hy double, hz double"


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("catalog")
    (folder / "c.jsonl").write_text(catalog_lines())
    return files.read_catalog(spark, str(folder / "c.jsonl"))


@pytest.fixture(scope="module")
def scene(spark, catalog):
    rows = [
        (0, 0, "o2", "table", 0.0, 1.6, 0.0, 1.6, 1.6, 1.6),
        (0, 1, "o1", "chair", 4.0, 1.0, 1.0, 1.0, 1.0, 1.0),
        (0, 2, "o3", "lamp", 0.2, 3.8, 0.1, 0.6, 0.6, 0.6),
    ]
    values = scenes.component_values(files.catalog_components(catalog).drop("object_name").withColumnRenamed("object_id", "object_name"))
    return spark.createDataFrame(rows, OBJECT), scenes.object_values(values)


def by_ref(df, name, attribute=None):
    rows = [r for r in df.collect() if name in r.question and (attribute is None or r.attribute == attribute)]
    assert len(rows) == 1
    return rows[0].answer


def test_distance_questions(scene):
    assert by_ref(generators.what_distance(scene[0], "closest"), "table") == "lamp"
    assert by_ref(generators.what_distance(scene[0], "farthest"), "table") == "chair"
    assert by_ref(generators.where_distance(scene[0], "closest"), "table") == "above"
    assert by_ref(generators.where_distance(scene[0], "farthest"), "table") == "to the right of"
    assert by_ref(generators.list_attribute_distance(*scene, "closest", key="object_id"), "table", "material") == "fabric, metal"
    assert by_ref(generators.count_attribute_distance(*scene, "closest", key="object_id"), "table", "material") == "2"
    assert by_ref(generators.list_attribute_distance(*scene, "farthest", key="object_id"), "table", "color") == "black, brown"
    with pytest.raises(ValueError):
        generators.what_distance(scene[0], "nearest")


def test_size_questions(scene):
    assert [r.answer for r in generators.what_size(scene[0], "largest").collect()] == ["table"]
    assert [r.answer for r in generators.what_size(scene[0], "smallest").collect()] == ["lamp"]
    found = {r.attribute: r.answer for r in generators.list_attribute_size(*scene, "largest", key="object_id").collect()}
    assert found["material"] == "wood" and found["texture"] == "glossy"
    assert {r.attribute: r.answer for r in generators.count_attribute_size(*scene, "largest", key="object_id").collect()}["material"] == "1"
    assert by_ref(generators.where_size(scene[0], "largest", "with_reference"), "chair") == "to the left of"
    assert by_ref(generators.where_size(scene[0], "largest", "reference_to_target"), "chair") == "to the right of"
    assert len(generators.where_size(scene[0], "largest", "no_reference").collect()) == 2
    with pytest.raises(ValueError):
        generators.where_size(scene[0], "largest", "some_reference")


def test_ties_go_to_the_first(spark):
    rows = [(1, 0, "a", "a", 0.0, 1.0, 0.0, 1.0, 1.0, 1.0), (1, 1, "b", "b", 3.0, 1.0, 0.0, 1.0, 1.0, 1.0), (1, 2, "c", "c", -3.0, 1.0, 0.0, 1.0, 1.0, 1.0)]
    n = spark.createDataFrame(rows, OBJECT)
    for t in ("closest", "farthest"):
        assert [r.answer for r in generators.what_distance(n, t).filter("ref_idx = 0").collect()] == ["b"]
    for t in ("largest", "smallest"):
        assert [r.answer for r in generators.what_size(n, t).collect()] == ["a"]


@pytest.mark.parametrize("delta, want", [((2, 2, 0), "to the right of"), ((0, -2, 2), "below"), ((0, 0, 0), "to the left of"), ((0, 1, 3), "in front of"), ((0, 1, -3), "behind"), ((-3, 1, 1), "to the left of"), ((0, 4, 1), "above")])
def test_directions(spark, delta, want):
    at = lambda v: F.struct(*[F.lit(float(x)).alias(c) for x, c in zip(v, ("px", "py", "pz"))])
    assert spark.range(1).select(relations.direction(at(delta), at((0, 0, 0)))).first()[0] == want


def test_catalog_and_vocabulary(catalog):
    assert {r.object_id: r.object_name for r in catalog.collect()} == {"o1": "chair", "o2": "table", "o3": "lamp", "o4": "book", "o5": "chair", "o6": "rock"}
    comp = files.catalog_components(catalog)
    values = scenes.component_values(comp)
    vocab = {r.attribute: r["values"] for r in scenes.vocabulary(values).collect()}
    assert vocab["material"] == ["fabric", "metal", "paper", "plastic", "wood"] and vocab["texture"] == ["glossy", "smooth", "soft"]
    by_id = scenes.component_values(comp.drop("object_name").withColumnRenamed("object_id", "object_name"))
    assert by_id.select("object_name", "attribute").distinct().count() == 20
    lists = {(r.object_name, r.attribute): r.answer for r in generators.list_attribute(scenes.object_values(by_id)).collect()}
    assert lists[("o1", "texture")] == "smooth"
    leg = generators.what_attribute(comp).filter("object_name = 'table' and component = 'leg' and attribute = 'color'").first()
    assert leg.answer == "white" and leg.question == "What is the color of the leg in the table?"


@pytest.mark.parametrize("c, k, want", [(1, 3, [2, 0, 3]), (0, 3, [1, 2, 3]), (2, 5, [3, 1, 4, 0, 5])])
def test_numeric_distractors(spark, c, k, want):
    assert spark.range(1).select(distractors.numeric(F.lit(c), k)).first()[0] == want


def test_number_scene_answers(spark):
    kinds = spark.createDataFrame([(0, 0, "lamp", 2), (0, 1, "book", 3), (0, 2, "table", 1), (1, 0, "cup", 2), (1, 1, "pen", 2), (2, 0, "cup", 1), (2, 1, "cup", 2), (2, 2, "pen", 2)], "scene_id long, type_idx long, object_name string, cnt long")
    assert {r.scene_id: r.answer for r in generators.frequent_object(kinds, "most").collect()} == {0: "book", 2: "cup"}
    assert {r.scene_id: r.answer for r in generators.frequent_object(kinds, "least").collect()} == {0: "table", 2: "pen"}
    counts = {(r.scene_id, r.object_name): r.answer for r in generators.count_object(kinds).collect()}
    assert counts[(2, "cup")] == "3" and counts[(0, "lamp")] == "2"
    one = lambda c: spark.range(1).select(distractors.other_counts(F.lit(c), F.array(*map(F.lit, (2, 3, 1))))).first()[0]
    assert one(2) == [0, 1, 3, 4] and one(3) == [1, 2, 4, 5]


def test_count_splits_have_one_most_and_one_least():
    for n, all_ in enums.count_splits().items():
        for split in all_:
            assert sum(split) == n and split.count(max(split)) == 1 and split.count(min(split)) == 1


def test_number_scenes_are_contiguous(spark):
    cat = spark.createDataFrame([(i, f"id{i}", f"name{i}") for i in range(30)], "ord long, object_id string, object_name string")
    cfg = spark.createDataFrame([(n, k, list(c)) for n, a in enums.count_splits().items() for k, c in enumerate(a)], "n long, cfg long, counts array<long>")
    rows = scenes.number_scenes(spark.range(60).select(F.col("id").alias("scene_id"), (F.col("id") % 7 + 3).alias("n")), cat, cfg, 1).collect()
    by = {}
    for r in rows:
        by.setdefault(r.scene_id, []).append(r)
    assert len(by) == 60
    for kinds in by.values():
        kinds.sort(key=lambda r: r.type_idx)
        assert [i for r in kinds for i in range(r.first_idx, r.last_idx + 1)] == list(range(kinds[0].n))
        assert len({r.object_id for r in kinds}) == len(kinds)


def test_text_expressions(spark):
    row = spark.createDataFrame([("The [obj_1] is beside the [obj_0].", "The table is near the Tablecloth. The lamp is on the Table.")], "t string, d string")
    names = F.array(*[F.struct(F.lit(f"obj_{i}").alias("placeholder"), F.lit(n).alias("name")) for i, n in enumerate(("table", "chair"))])
    assert row.select(relations.fill_placeholders(F.col("t"), names)).first()[0] == "The chair is beside the table."
    assert row.select(relations.abstract_names(F.col("d"), F.array(F.lit("table"), F.lit("lamp")))).first()[0] == "The [obj_0] is near the Tablecloth. The [obj_1] is on the [obj_0]."
    odd = spark.createDataFrame([("a c++ (big) thing",)], "d string")
    assert "[obj_0]" in odd.select(relations.abstract_names(F.col("d"), F.array(F.lit("big"), F.lit("c++")))).first()[0]
    assert row.select(relations.category(F.lit("what_size"), F.lit(None).cast("string"))).first()[0] == "what_size_"


def test_options(spark):
    df = spark.createDataFrame([(i, ["b", "c", "d", "a", "e"]) for i in range(200)] + [(999, ["a", "b"])], "id long, c array<string>")
    rows = distractors.with_options(df.withColumn("a", F.lit("a")), "a", "c", 4, 7, F.col("id")).collect()
    assert {r.id for r in rows} == set(range(200))  # two candidates are too few
    seen = [0] * 4
    for r in rows:
        assert len(set(r.options)) == 4
        seen[r.options.index("a")] += 1
    assert min(seen) > 20
    u = [r[0] for r in df.select(rng.uniform(3, F.col("id"))).collect()]
    assert 0 <= min(u) and max(u) < 1 and 0.4 < sum(u) / len(u) < 0.6


def cases(spark):
    return spark.createDataFrame(layout_queries._responses(), "id long, response string")


def solved(spark):
    return solver.solve_templates(dsl.parse(dsl.validate(cases(spark))).withColumnRenamed("id", "template_id"), 8, 42)


def test_descriptions_fail_by_the_first_rule(spark):
    want = {0: None, 1: None, 2: None, 3: None, 4: None, 29: None}
    part = {5: "Invalid JSON", 6: "Invalid JSON", 7: "'description'", 10: "got 1", 11: "got 10", 12: "missing required field 'rotation'", 17: "invalid size 'huge'", 18: "'rotation' must be a number", 19: "'largest'", 20: "'smallest'", 24: "reference 'floor' not found", 26: "cannot be the same", 27: "invalid relation 'inside'", 28: "object name 'lamp'", 30: "different"}
    got = {r.id: r.error for r in dsl.validate(cases(spark)).collect()}
    assert {k for k, v in got.items() if v is None} == set(want)
    for k, text in part.items():
        assert text in got[k], (k, got[k])
    none = dsl.validate(spark.createDataFrame([(1, None), (2, ""), (3, "null"), (4, "3")], "id long, response string")).collect()
    assert {r.error for r in none} == {"Invalid JSON"}


def box(at, half):
    return np.array(at, float), np.array(half, float)


@pytest.mark.parametrize("at, ok", [((2.04, 1, 0), False), ((2.06, 1, 0), True), ((0, 3, 0), True), ((0, 2.9, 0), True), ((0, 2.8, 0), False)])
def test_boxes_beside_a_box(spark, at, ok):
    placed = [box((0, 1, 0), (1, 1, 1))]
    assert solver.fits(*box(at, (1, 1, 1)), placed) is ok
    rows = [(0, 0, 0.0, 1.0, 0.0, 1.0, 1.0, 1.0), (0, 1, *map(float, at), 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "scene_id long, idx long, x double, y double, z double, hx double, hy double, hz double")
    assert (geometry.collisions(df).count() == 0) is ok


def test_boxes_out_of_bounds():
    assert not solver.fits(*box((7.5, 1, 0), (1, 1, 1)), []) and not solver.fits(*box((0, 0.9, 0), (1, 1, 1)), [])


def test_solved_layouts_are_valid(spark):
    rows = solved(spark).collect()
    assert {r.template_id for r in rows} == {0, 1, 2, 3, 4, 29} and sum(r.solved for r in rows) > 60
    by = {}
    for r in rows:
        if r.solved:
            by.setdefault((r.template_id, r.variant), []).append(r)
    for members in by.values():
        placed = []
        for r in sorted(members, key=lambda r: r.place_idx):
            assert solver.fits(np.array([r.x, r.y, r.z]), np.array([r.hx, r.hy, r.hz]), placed)
            placed.append((np.array([r.x, r.y, r.z]), np.array([r.hx, r.hy, r.hz])))
    lamp = {(r.template_id, r.variant): r for r in rows if r.name == "lamp" and r.template_id == 0}
    table = {(r.template_id, r.variant): r for r in rows if r.name == "table" and r.template_id == 0}
    assert all(abs(lamp[k].y - table[k].y - table[k].hy - lamp[k].hy) < 1e-9 for k in lamp)
    again = solved(spark).repartition(3).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_placement_order_and_cycles():
    ways = [("b", "near", "a"), ("c", "near", "b"), ("b", "near", "a")]
    assert solver.placement_order(["c", "b", "a"], ways) == ["a", "b", "c"]
    cycle = [("a", "near", "b"), ("b", "near", "a")]
    assert solver.placement_order(["d", "a", "b"], cycle) == ["d", "a", "b"]
    assert solver.solve([("a", "largest", 0), ("b", "smallest", 0)], cycle, 1) is None
    for relation in enums.RELATIONS:
        made = solver.solve([("a", "large", 0), ("b", "smallest", 0)], [("b", relation, "a")], 3)
        assert made is None or len(made) == 2


def test_points_of_a_scene(spark):
    p = spark.createDataFrame([("k", 0, 0.0, 0.0, 0.0), ("k", 1, 2.0, 4.0, 0.0)], "cloud_id string, pt long, x double, y double, z double")
    o = spark.createDataFrame([(0, 0, "k", 0.0, 1.0, 0.0, 1.0, 1.0, 1.0, 90.0)], "scene_id long, idx long, cloud_id string, px double, py double, pz double, hx double, hy double, hz double, rotation double")
    got = {r.pt: (r.x, r.y, r.z) for r in geometry.scene_points(o, p).collect()}
    assert np.allclose(got[0], (-1, 0, 1)) and np.allclose(got[1], (-1, 2, -1))


def test_density_clusters_and_normals(spark):
    gen = np.random.default_rng(1)
    flat = [(1, i, *map(float, gen.uniform(0, 0.3, 2)), 0.0) for i in range(60)]
    few = [(2, i, 0.0, 0.0, float(i)) for i in range(3)]
    p = spark.createDataFrame(flat + few, "cloud_id long, pt long, x double, y double, z double")
    n = {(r.cloud_id, r.pt): abs(r.nz) for r in clouds.normals(p).collect()}
    assert np.mean([n[(1, i)] for i in range(60)]) > 0.95
    d = {(r.cloud_id, r.pt): r.density for r in clouds.density(p).collect()}
    assert all(d[(2, i)] == 0.5 for i in range(3)) and min(d[(1, i)] for i in range(60)) == 0 and max(d[(1, i)] for i in range(60)) == 1
    c = {r.pt: r.cluster for r in clouds.clusters(p).filter("cloud_id = 1").collect()}
    assert set(c.values()) == {0, 1}


def test_answers(spark):
    got = [r.resolved for r in spark.createDataFrame(list(enumerate(["red", "(B) blue", "C", "(A)", "It is blue", "dark blue!", "It is colored blue", "The answer is (B)", ""])), "id long, a string").select("id", evaluation.resolve_answer(F.col("a"), F.array(F.lit("red"), F.lit("blue"), F.lit("dark blue"))).alias("resolved")).orderBy("id").collect()]
    assert got == ["red", "blue", "dark blue", "red", "blue", "", "", "blue", ""]


def test_utility(spark):
    cand = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.6, 0.8])], "task_id long, embedding array<double>")
    hist = spark.createDataFrame([([1.0, 0.0], False), ([0.0, 1.0], True)], "embedding array<double>, is_correct boolean")
    got = {r.task_id: round(r.utility, 6) for r in evaluation.utility(cand, hist).collect()}
    assert got == {0: 0.8, 1: -0.2, 2: 0.44}
    assert {r.task_id: round(r.utility, 6) for r in evaluation.utility(cand.filter("task_id = 0"), hist.withColumn("is_correct", F.lit(True))).collect()} == {0: -0.2}
    assert {r.utility for r in evaluation.utility(cand, hist.limit(0)).collect()} == {0.0}


def test_selection_spends_the_budget_once(spark):
    gen = np.random.default_rng(0)
    pool = spark.createDataFrame([(i, [float(x) for x in v / np.linalg.norm(v)]) for i, v in enumerate(gen.normal(size=(40, 4)))], "task_id long, embedding array<double>")
    model = lambda t: t.withColumn("is_correct", F.col("task_id") % 3 != 0)
    done = evaluation.dynamic_evaluation(spark, pool, model, budget=25, batch=10).collect()
    assert len(done) == 25 == len({r.task_id for r in done}) and {r.step for r in done} == {0, 1, 2}
    assert len(evaluation.dynamic_evaluation(spark, pool, model, budget=100, batch=30).collect()) == 40


def test_point_files(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.array([[0, 0, 0, 255, 0, 0], [1, 2, 3, 0, 255, 0]]))
    (tmp_path / "b.xyz").write_text("1 2 3\n4 5 6\n")
    (tmp_path / "c.ply").write_text("ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nend_header\n7 8 9\n3 0 0 0\n")
    (tmp_path / "d.pcd").write_text("VERSION .7\nFIELDS x y z\nDATA ascii\n1 1 1\n2 2 2\n")
    rows = files.read_points(spark, str(tmp_path)).collect()
    assert {r.cloud_id for r in rows} == {"a", "b", "c", "d"} and len(rows) == 7
    assert [(r.r, r.g) for r in rows if r.cloud_id == "a"] == [(1, 0), (0, 1)]
    with pytest.raises(ValueError):
        files.parse_points("x.obj", b"")
    with pytest.raises(IndexError):
        sinks.export_cloud(files.read_points(spark, str(tmp_path)).filter("cloud_id = 'z'"), f"file://{tmp_path}/z.npy")
    assert sinks.export_cloud(files.read_points(spark, str(tmp_path)).filter("cloud_id = 'b'"), f"file://{tmp_path}/out.npy") == 2


def test_layout_files(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps(layouts()))
    df = files.read_layouts(spark, str(tmp_path / "l.json"))
    standard, special = files.split_layouts(df)
    assert df.count() == 13 and standard.count() == 12 and special.count() <= 12
    o = files.layout_objects(df).filter("layout_id = 0 and idx = 1").first()
    assert (o.placeholder, o.px, o.hx, o.rotation) == ("obj_1", 4.0, 1.0, 90.0)


def test_providers(spark):
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(6)], "id long, prompt string")

    def call(prompt):
        if prompt == "p1":
            raise OSError("no")
        return None if prompt == "p2" else "bad" if prompt == "p3" else prompt.upper()

    rows = {r.id: r for r in providers.ask(prompts, call, valid=lambda t: t != "bad", retries=1, wait=0.0).collect()}
    assert rows[0].response == "P0" and rows[0].calls == 1
    assert (rows[1].status, rows[2].status, rows[3].status) == ("error", "invalid", "invalid") and rows[1].calls == 2
    stats = providers.call_stats(providers.ask(prompts, call, valid=lambda t: t != "bad", retries=1, wait=0.0)).first()
    assert (stats.calls, stats.errors, stats.retries) == (9, 3, 3)
    kept = spark.createDataFrame([(0, "x")], "id long, response string")
    assert {r.status for r in providers.recorded(prompts, kept).collect()} == {"ok", "missing"}


def test_results_are_written(spark, tmp_path):
    results = spark.createDataFrame([(3, True), (5, False), (9, False)], "task_id long, is_correct boolean")
    folder = f"file://{tmp_path}"
    stats = evaluation.summary(results).first().asDict() | {"error_indices": [r.task_id for r in evaluation.error_indices(results).collect()]}
    sinks.write_results(results.orderBy("task_id"), stats, {"budget": 3}, folder)
    text = json.loads((tmp_path / "results.json").read_text())
    assert text["stats"] == {"total": 3, "errors": 2, "error_rate": round(2 / 3, 6), "error_indices": [5, 9]} and text["config"] == {"budget": 3}
    assert text["results"] == [{"task_id": 3, "is_correct": True}, {"task_id": 5, "is_correct": False}, {"task_id": 9, "is_correct": False}]
    assert sinks.write_hard_data(evaluation.hard_tasks(results), 1, folder) == 2
    assert evaluation.summary(results.limit(0)).first().error_rate == 0


def test_stream_equals_the_table(spark, tmp_path):
    import datetime as dt

    rows = [(dt.datetime(2024, 1, 1, h, m), c, (h + m) % 3 != 0) for h in range(5) for m in (0, 20, 40) for c in ("x", "y")]
    schema = "ts timestamp, category string, is_correct boolean"
    spark.createDataFrame(rows, schema).repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = history.start(stream, "rates", str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("rates").collect()}
    want = {tuple(r) for r in history.error_rates(spark.read.parquet(str(tmp_path / "in"))).collect()}
    assert got and got <= want and len(want) == 10


def test_rotations_turn_the_right_way(spark):
    p = spark.createDataFrame([(1, 0, 1.0, 0.0, 0.0)], "cloud_id long, pt long, x double, y double, z double")
    r = geometry.rotate_y(p, F.lit(90.0)).first()
    assert math.isclose(r.z, -1) and abs(r.x) < 1e-9
    assert math.isclose(geometry.translate(p, F.lit(2.0), F.lit(1.0)).first().x, 3)
    random.seed(0)
