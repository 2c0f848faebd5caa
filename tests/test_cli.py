"""The command line over small files."""

import json

import pytest

from scenewright import cli

from .core_data import catalog_lines, layouts


def test_a_task_set_and_layouts(spark, tmp_path, capsys):
    (tmp_path / "c.jsonl").write_text(catalog_lines(20))
    (tmp_path / "l.json").write_text(json.dumps(layouts()))
    common = ["--catalog", f"{tmp_path}/c.jsonl", "--layouts", f"{tmp_path}/l.json"]
    made = cli.main(["tasks", *common, "--type", "what_size", "--config", "size_type=smallest", "--number", "3", "--out", f"{tmp_path}/t"], spark)
    assert json.loads(capsys.readouterr().out) == made and made["generation_stats"]["num_tasks_generated"] == 3
    records = [json.loads(x) for x in (tmp_path / "t/tasks.jsonl").read_text().splitlines()]
    scenes = json.loads((tmp_path / "t/pcd/metadata.json").read_text())
    assert [r["question_id"] for r in records] == [s["scene_id"] for s in scenes] == [0, 1, 2]
    assert all(list(r) == ["question_id", "point", "category", "question", "options", "answer"] for r in records)
    good = {"description": "a and b", "objects": [{"name": "a", "size": "largest", "rotation": 0}, {"name": "b", "size": "smallest", "rotation": 0}], "relations": []}
    (tmp_path / "r.jsonl").write_text("\n".join(json.dumps({"id": i, "response": json.dumps(good) if i else "no"}) for i in range(3)))
    made = cli.main(["layouts", "--names", "a,b", "--lists", "3", "--responses", f"{tmp_path}/r.jsonl", "--variants", "2", "--out", f"{tmp_path}/y"], spark)
    assert (made["num_templates"], made["num_layouts"]) == (2, 4) and len(json.loads((tmp_path / "y/layouts.json").read_text())) == 4
    with pytest.raises(SystemExit):
        cli.main(["tasks", *common, "--type", "nothing", "--out", "x"], spark)
