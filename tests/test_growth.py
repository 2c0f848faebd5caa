"""Steps whose work must not grow faster than their input."""

import json

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenewright.operators import clouds, dsl, geometry, visual
from scenewright.operators import scenes as s
from scenewright.plans import file_queries, generate
from scenewright.rng import uniform
from scenewright.sources import files, sinks

from .core_data import catalog_lines, layouts


@pytest.fixture
def no_small_joins(spark):
    """Without joins that are broadcast because of a guessed size."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_centres_are_the_means_of_placed_points(spark):
    points = spark.createDataFrame([(c, k, None if k == 3 else k * 0.37, float(k * c), None if k == 4 else 2.0 - k) for c in (1, 2) for k in range(7)], "cloud_id long, pt long, x double, y double, z double")
    objects = spark.createDataFrame([(i, 0, i % 3, 1.0 * i, 2.0, 3.0, 0.5, 1.5, 2.5, 37.0 * i) for i in range(9)], "scene_id long, idx long, cloud_id long, px double, py double, pz double, hx double, hy double, hz double, rotation double")
    made = geometry.scene_points(objects, points).groupBy("scene_id", "idx").agg(F.count("*").alias("n_points"), *[F.avg(c).alias(c) for c in "xyz"])
    want = {r.scene_id: r for r in made.collect()}
    got = {r.scene_id: r for r in geometry.scene_centres(objects, points).collect()}
    assert got.keys() == want.keys() == {1, 2, 4, 5, 7, 8}
    for k, r in got.items():
        assert r.n_points == want[k].n_points == 7 and all(abs(r[c] - want[k][c]) < 1e-9 for c in "xyz")


def test_depths_have_no_limit_of_rows(spark):
    """A chain of nine objects, a cycle, and none; more rows than a recursive query may make."""
    names = [f"o{i}" for i in range(9)]
    scene = lambda ways: json.dumps(dict(objects=[dict(name=n) for n in names], relations=[dict(subject=a, reference=b) for a, b in ways]))
    cases = [scene(zip(names[1:], names)), scene([("o1", "o0"), ("o0", "o1"), ("o2", "o1")]), scene([])]
    kind = "struct<description:string,objects:array<struct<name:string>>,relations:array<struct<subject:string,reference:string>>>"
    rows = spark.range(3000).select("id", F.from_json(F.get(F.array(*map(F.lit, cases)), (F.col("id") % 3).cast("int")), kind).alias("scene"))
    spark.conf.set("spark.sql.cteRecursionRowLimit", "1000")
    try:
        got = {}
        for r in dsl.depths(rows, "id").filter("id < 3").collect():
            got.setdefault(r.id, {})[r.name] = r.depth
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert got[0] == {n: i for i, n in enumerate(names)} and got[2] == dict.fromkeys(names, 0)
    assert got[1] == dict.fromkeys(names, 0) | {"o0": 9, "o1": 9, "o2": 9}


def test_a_text_is_parsed_once(spark):
    made = dsl.abstract(dsl.parse(dsl.validate(spark.createDataFrame([(1, "{}")], "id long, response string"))))
    text = plan(made.select("id", "template"))
    assert text.count("try_parse_json") + text.count("parse_json(") <= 2


def test_few_numbers_keep_scenes_apart(spark, no_small_joins):
    """Neither a scene's size, nor the place in a small catalog, decides where it is worked on."""
    scenes = spark.range(60).select(F.col("id").alias("scene_id"), (F.col("id") % 7 + 3).alias("n"))
    catalog = spark.createDataFrame([(k, k * 10, f"thing{k}") for k in range(20)], "ord long, object_id long, object_name string")
    splits = spark.createDataFrame([(n, 0, [1, n - 1]) for n in range(3, 10)], "n long, cfg long, counts array<long>")
    made = s.number_scenes(scenes, catalog, splits, 42)
    assert "SortMergeJoin" not in plan(made) and "ShuffledHashJoin" not in plan(made)
    by = {}
    for r in made.collect():
        by.setdefault(r.scene_id, []).append(r)
    assert len(by) == 60 and all(sum(r.cnt for r in rows) == rows[0].n and len({r.object_name for r in rows}) == 2 for rows in by.values())


def test_neighbours_in_boxes_are_those_of_all():
    rng = np.random.default_rng(5)
    clumps = np.concatenate([rng.normal(size=(1500, 3)), rng.normal(size=(1000, 3)) * 1e-3 + 4, np.repeat(rng.normal(size=(10, 3)), 40, 0), [[1e6, 0, 0]]])
    for k in (1, 10, 29):
        far, where = clouds._nearest(clumps, k)
        want, _ = clouds._nearest_of_all(clumps, k)
        assert np.array_equal(far, want)
        assert np.array_equal(far, np.sqrt(((clumps[:, None] - clumps[where]) ** 2).sum(2))) and not (where == np.arange(len(clumps))[:, None]).any()


def test_neighbours_are_compared_with_few(monkeypatch):
    """Four times the points take four times the comparisons, with some for the edges, and not sixteen times."""
    compared = []
    real = np.argpartition
    monkeypatch.setattr(clouds.np, "argpartition", lambda d, *a, **k: (compared.append(np.asarray(d).size if np.ndim(d) == 2 else 0), real(d, *a, **k))[1])
    clouds._nearest(np.random.default_rng(5).normal(size=(10_000, 3)), 10)
    small = sum(compared)
    clouds._nearest(np.random.default_rng(5).normal(size=(40_000, 3)), 10)
    assert 0 < small and sum(compared) - small < 7 * small


def test_documents_do_not_come_to_the_driver(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda *a, **k: pytest.fail("rows come to the driver"))
    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", lambda *a, **k: pytest.fail("rows come to the driver"))
    rows = spark.range(0, 5000, 1, 7).select("id", F.concat(F.lit("a\n]"), F.col("id").cast("string")).alias("text"), F.lit(None).cast("string").alias("none"))
    path = f"file://{tmp_path}/rows.json"
    assert sinks.write_array(rows.orderBy("id"), path) == 5000
    want = [{"id": k, "text": f"a\n]{k}", "none": None} for k in range(5000)]
    assert json.loads((tmp_path / "rows.json").read_text()) == want
    assert sorted(r.id for r in files.read_array(spark, path, "id long, text string").collect()) == list(range(5000))
    assert sinks.write_array(rows.orderBy("id"), f"file://{tmp_path}/rows.jsonl", lines_only=True) == 5000
    assert [json.loads(x) for x in (tmp_path / "rows.jsonl").read_text().splitlines()] == want
    assert sinks.write_array(rows.limit(0), f"file://{tmp_path}/none.json") == 0 and sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["rows.json", "rows.jsonl"]


def test_points_of_visual_scenes_are_made_where_their_place_is(spark, no_small_joins):
    places = spark.createDataFrame([(i, k, f"obj_{k}", 1.0 * i, 2.0, 3.0, 0.5, 1.0, 2.0, 30.0 * k) for i in range(20) for k in range(3)], "scene_id long, idx long, placeholder string, px double, py double, pz double, hx double, hy double, hz double, rotation double")
    cloud = spark.createDataFrame([(7, k, k / 3, k * 1.0, 5.0 - k) for k in range(9)], "cloud_id long, pt long, x double, y double, z double")
    mapping = places.filter("idx = 1").select("scene_id", "placeholder", F.lit("thing").alias("name"), F.lit(7).alias("cloud_id"))
    made = visual.visual_scene(places, mapping, cloud, 12, 3)
    got = {(r.scene_id, r.idx, r.pt): r for r in made.collect()}
    assert len(got) == 20 * 3 * 12 and {r.display for r in got.values() if r.idx == 1} == {"thing"}
    cubes = visual.cube_points(spark.createDataFrame([("cube:4:2",)], "cloud_id string"), 12, 3)
    one = places.filter("scene_id = 4 and idx = 2").withColumn("cloud_id", F.lit("cube:4:2"))
    for r in geometry.scene_points(one, cubes).collect():
        assert all(abs(r[c] - got[4, 2, r.pt][c]) < 1e-12 for c in "xyz")
    # two joins of the places with their mapping, and three of the cloud with what is its own; points are joined by no shuffle
    assert plan(visual.visual_scene(places, mapping, cloud, 12, 3)).count("SortMergeJoin") <= 5


def test_attempts_read_only_the_layouts_that_they_drew(spark, tmp_path, no_small_joins):
    """No plan of a task set shuffles the layouts; their numbers follow the ids."""
    (tmp_path / "c.jsonl").write_text(catalog_lines(30))
    (tmp_path / "l.json").write_text(json.dumps(layouts()))
    inputs = generate.Inputs(spark, files.read_catalog(spark, str(tmp_path / "c.jsonl")), files.read_layouts(spark, str(tmp_path / "l.json")))
    sizes = {x["id"]: len(x["objects"]) for x in layouts()}
    for own, least in ((inputs.standard, 2), (inputs.special, 3)):
        ids = sorted(i for i, n in sizes.items() if 2 <= n <= 9 and n >= least)
        assert sorted(r.layout_ord for r in own.collect()) == list(range(len(ids)))
        drawn = inputs.drawn(own, 5, 40).collect()
        assert len(drawn) == 40 and {r.layout_id for r in drawn} <= set(ids) and all(len(r.objects) == r.n == sizes[r.layout_id] for r in drawn)
        at = spark.range(40).select("id", F.floor(uniform(5, "layout", F.col("id")) * len(ids)).alias("k")).collect()
        assert {r.id: ids[r.k] for r in at} == {r.scene_id: r.layout_id for r in drawn}
    again = inputs.drawn(inputs.standard, 5, 30)
    text = plan(generate.attempts(inputs, inputs.standard, 5, 0, 30))
    assert again.count() == 30 and "drawn-" in text and "layouts-" not in text


def test_drawn_layouts_are_filtered_in_the_table(spark, tmp_path):
    """The ids that attempts drew reach the scan of the lines: other scenes aren't made."""
    spark.createDataFrame([(1, 7, 1, 1, 1.0, 1.0, 0.1, 0.1)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(7, "a b", 1, 1.0)], "p_partkey long, p_name string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    text = plan(file_queries._layouts(spark, str(tmp_path)).filter("id IN (3, 5, 8)"))
    scan = next(x for x in text.split("\n") if "FileScan" in x and "l_orderkey" in x)
    assert "l_orderkey" in scan.split("DataFilters")[1] and "IN (3,5,8)" in scan
