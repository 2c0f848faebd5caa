"""Writers of task sets, scene clouds and evaluation results.

Rows go out in parallel as JSON lines; only single small documents, whose size doesn't grow with the rows, are made on the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import TaskPlan

TASK_FIELDS = ["question_id", "point", "category", "question", "options", "answer"]


def write_document(path: str, value) -> None:
    """One JSON document; the folder is made if there is none."""
    fs, at = pafs.FileSystem.from_uri(path)
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(at, compression=None) as out:
        out.write(json.dumps(value, indent=2, ensure_ascii=False).encode())


def write_tasks(tasks: DataFrame, folder: str) -> None:
    """Task records as JSON lines below ``folder``/tasks, in the fixed order of fields."""
    tasks.select(*TASK_FIELDS).write.mode("overwrite").json(f"{folder}/tasks")


def write_scene_clouds(points: DataFrame, folder: str) -> DataFrame:
    """One .npy file a scene, named by its number in six digits, and (question_id, file, n_points) of what was written.

    ``points`` has question_id, idx, pt and the columns x, y, z and, if there are any, r, g, b. A scene has at most nine
    clouds of a bounded sample, so a scene is one task's group.
    """
    columns = [c for c in "xyzrgb" if c in points.columns]

    def one(g: pd.DataFrame) -> pd.DataFrame:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(f"{root}/pcd", recursive=True)
        number = int(g["question_id"].iloc[0])
        name = f"{number:06d}.npy"
        with fs.open_output_stream(f"{root}/pcd/{name}", compression=None) as out:
            np.save(out, g.sort_values(["idx", "pt"])[columns].to_numpy(float))
        return pd.DataFrame({"question_id": [number], "file": [name], "n_points": [len(g)]})

    return points.groupBy("question_id").applyInPandas(one, "question_id long, file string, n_points long")


def write_scene_metadata(scenes: DataFrame, folder: str) -> None:
    """(scene_id, point_cloud, layout_id, layout_template, layout_description, objects) as JSON lines below ``folder``/pcd_metadata."""
    details = F.struct(F.size("objects").alias("count"), F.col("objects").alias("details"))
    scenes.withColumn("objects", details).write.mode("overwrite").json(f"{folder}/pcd_metadata")


def task_info(plan: TaskPlan, requested: int, generated: int, folder: str) -> dict:
    """The description of a task set, also written to ``folder``/tasks_info.json."""
    stats = dict(num_tasks_requested=requested, num_tasks_generated=generated, output_directory=folder)
    info = dict(task_plan=plan.to_dict(), generation_stats=stats)
    write_document(f"{folder}/tasks_info.json", info)
    return info


def write_results(results: DataFrame, stats: dict, config: dict, folder: str) -> None:
    """``folder``/results.json: configuration, stats, and the results in their order. Results are streamed, not held."""
    fs, at = pafs.FileSystem.from_uri(f"{folder}/results.json")
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    lines = results.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line")).toLocalIterator()
    with fs.open_output_stream(at, compression=None) as out:
        out.write(f'{{"config": {json.dumps(config)},\n"stats": {json.dumps(stats)},\n"results": [\n'.encode())
        for k, r in enumerate(lines):
            out.write((b",\n" if k else b"") + r.line.encode())
        out.write(b"\n]}\n")


def write_hard_data(hard: DataFrame, seed: int, folder: str) -> int:
    """Failed tasks as a task set of their own below ``folder``/hard_data; nothing if there are none. Returns their number."""
    n = hard.count()
    if n:
        hard.write.mode("overwrite").json(f"{folder}/hard_data/tasks")
        stats = dict.fromkeys(("num_tasks_requested", "num_tasks_generated"), n) | {"output_directory": f"{folder}/hard_data"}
        plan = dict(generator_type="mixed", num_options=4, seed=seed)
        write_document(f"{folder}/hard_data/tasks_info.json", dict(task_plan=plan, generation_stats=stats))
    return n


def write_array(rows: DataFrame, path: str, lines_only: bool = False) -> int:
    """One document with a JSON array of the rows, or with a line for each, in their order; nothing without a row.

    The rows are written in parts beside it, which one task puts together in blocks; none come to the driver.
    """
    spark, parts = rows.sparkSession, f"{path}.{uuid.uuid4().hex}"
    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line")).write.text(parts, compression="none")
    n = spark.read.text(parts).count()

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(parts)
        names = sorted(x.path for x in fs.get_file_info(pafs.FileSelector(root)) if x.is_file and x.base_name.startswith("part-"))
        for batch in batches:
            if not len(batch):
                continue
            with fs.open_output_stream(pafs.FileSystem.from_uri(path)[1], compression=None) as out:
                end = b"" if lines_only else b"[\n"
                for name in names:
                    with fs.open_input_stream(name, compression=None) as part:
                        while block := part.read(1 << 22):
                            # what may be the end of the last row waits
                            block = end + (block if lines_only else block.replace(b"\n", b",\n"))
                            end = b"" if lines_only else block[-2:]
                            out.write(block if lines_only else block[:-2])
                out.write(b"" if lines_only else b"\n]\n")
            yield batch

    if n:
        spark.range(0, 1, 1, 1).mapInPandas(put, "id long").collect()
    fs, at = pafs.FileSystem.from_uri(parts)
    fs.delete_dir(at)
    return n


def write_vocabulary(vocabulary: DataFrame, path: str) -> None:
    """(attribute, values) as one document, an attribute each with its sorted values; there are four attributes."""
    write_document(path, {r.attribute: list(r["values"]) for r in vocabulary.orderBy("attribute").toLocalIterator()})


def export_cloud(points: DataFrame, path: str) -> int:
    """One cloud as an .npy file, or as .xyz or .ply text by the path's suffix, in the order of pt. IndexError if it has no point.

    Columns r, g, b are written too if there are any. Points are read in Arrow batches: what is held is the array that is written.
    """
    columns = [c for c in "xyzrgb" if c in points.columns]
    table = points.orderBy("pt").select(*[F.col(c).cast("double") for c in columns]).toArrow()
    if not table.num_rows:
        raise IndexError("there is no such cloud")
    p = np.stack([c.to_numpy() for c in table.columns], 1)
    fs, at = pafs.FileSystem.from_uri(path)
    with fs.open_output_stream(at, compression=None) as out:
        if path.endswith((".xyz", ".ply")):
            if path.endswith(".ply"):
                names = "".join(f"property double {c}\n" for c in ("x", "y", "z", "red", "green", "blue")[: len(columns)])
                out.write(f"ply\nformat ascii 1.0\nelement vertex {len(p)}\n{names}end_header\n".encode())
            np.savetxt(out, p, fmt="%.17g")
        else:
            np.save(out, p)
    return len(p)
