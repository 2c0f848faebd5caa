"""Readers of catalogs, layouts and point files."""

from __future__ import annotations

import io
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..enums import LEAST_OBJECTS, MOST_OBJECTS
from ..schema import CATALOG_LINE, LAYOUT


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(object_id, object_name, components) of a catalog of JSON lines, each a map of ids; blank lines are skipped.

    A line that isn't JSON fails the read; a missing name is empty, missing components are none.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    objects = lines.select(F.explode(F.from_json("value", CATALOG_LINE, {"mode": "FAILFAST"})).alias("object_id", "o"))
    none = F.array().cast("array<struct<name:string,material:string,color:string,shape:string,texture:string>>")
    return objects.select("object_id", F.coalesce("o.object", F.lit("")).alias("object_name"), F.coalesce("o.components", none).alias("components"))


def catalog_components(catalog: DataFrame) -> DataFrame:
    """(object_id, object_name, component, material, color, shape, texture), one row a component."""
    rows = catalog.select("object_id", "object_name", F.explode("components").alias("c"))
    return rows.select("object_id", "object_name", F.col("c.name").alias("component"), "c.material", "c.color", "c.shape", "c.texture")


def read_layouts(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The layouts of a JSON array document, or of a folder of JSON lines, which is read in parallel."""
    return spark.read.schema(LAYOUT).json(path, multiLine=not lines)


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a document of ``sinks.write_array``: each has its line, so the document is read in parallel. A line that isn't a row fails the read."""
    lines = spark.read.text(path).filter(~F.col("value").isin("[", "]"))
    return lines.select(F.from_json(F.regexp_replace("value", ",$", ""), schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def split_layouts(layouts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The layouts of 2 to 9 objects, and those of 3 to 9. Without any of the former nothing can be asked: ValueError."""
    standard = layouts.filter(F.size("objects").between(LEAST_OBJECTS, MOST_OBJECTS))
    if standard.isEmpty():
        raise ValueError(f"no layout has {LEAST_OBJECTS} to {MOST_OBJECTS} objects")
    return standard, layouts.filter(F.size("objects").between(LEAST_OBJECTS + 1, MOST_OBJECTS))


def layout_objects(layouts: DataFrame) -> DataFrame:
    """(layout_id, idx, placeholder, px, py, pz, hx, hy, hz, rotation); a scalar size counts for all three axes."""
    rows = layouts.select(F.col("id").alias("layout_id"), F.posexplode("objects").alias("idx", "o"))
    half = lambda i: F.coalesce(F.get("o.size", F.lit(i)), F.get("o.size", F.lit(0)))
    return rows.select(
        "layout_id",
        F.col("idx").cast("long").alias("idx"),
        F.col("o.name").alias("placeholder"),
        *[F.get("o.position", F.lit(i)).alias(f"p{c}") for i, c in enumerate("xyz")],
        *[half(i).alias(f"h{c}") for i, c in enumerate("xyz")],
        F.coalesce("o.rotation", F.lit(0.0)).alias("rotation"),
    )


def _ascii_rows(text: str) -> np.ndarray:
    return np.loadtxt(io.StringIO(text), ndmin=2)


def parse_points(name: str, data: bytes) -> np.ndarray:
    """The points of a .npy, .xyz, or text .ply or .pcd file: three coordinates, then colours if there are any."""
    kind = name.rsplit(".", 1)[-1].lower()
    if kind == "npy":
        made = np.load(io.BytesIO(data), allow_pickle=False)
    elif kind == "xyz":
        made = _ascii_rows(data.decode())
    elif kind == "ply":
        head, _, body = data.decode().partition("end_header\n")
        if "format ascii" not in head:
            raise ValueError(f"{name}: only text .ply files are read")
        n = next(int(x.split()[2]) for x in head.splitlines() if x.startswith("element vertex"))
        made = _ascii_rows("\n".join(body.splitlines()[:n]))
    elif kind == "pcd":
        head, _, body = data.decode().partition("DATA ascii\n")
        if not body:
            raise ValueError(f"{name}: only text .pcd files are read")
        made = _ascii_rows(body)
    else:
        raise ValueError(f"{name}: unknown kind of file")
    if made.ndim != 2 or made.shape[1] < 3 or not len(made):
        raise ValueError(f"{name}: at least one point of three coordinates is needed")
    return made.astype(float)


POINTS = "cloud_id string, pt long, x double, y double, z double, r double, g double, b double"


def list_clouds(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(cloud_id, path) of a folder's point files: the id is the name without its suffix; of several suffixes the last by name counts."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path")
    return files.groupBy(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("cloud_id")).agg(F.max("path").alias("path"))


def read_points(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(cloud_id, pt, x, y, z, r, g, b) of all point files in a folder; the id is the file's name without its suffix.

    Of files that differ in their suffix only, the last by name counts. Colours above 1 are taken as of 255; a file without them has null
    colours. A file that can't be read fails the read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    named = list_clouds(spark, path, glob).select(F.col("path").alias("own"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, data in zip(batch["path"], batch["content"]):
                name = at.rsplit("/", 1)[-1]
                p = parse_points(name, data)
                rgb = p[:, 3:6] if p.shape[1] >= 6 else np.full((len(p), 3), np.nan)
                if p.shape[1] >= 6 and rgb.max(initial=0) > 1:
                    rgb = rgb / 255
                yield pd.DataFrame({"cloud_id": name.rsplit(".", 1)[0], "pt": np.arange(len(p)), **dict(zip("xyz", p[:, :3].T)), **dict(zip("rgb", rgb.T))})

    made = files.join(named, F.col("path") == F.col("own"), "left_semi").mapInPandas(each, POINTS)
    return made.withColumns({c: F.when(F.isnan(c), None).otherwise(F.col(c)) for c in "rgb"})


def read_cloud(spark: SparkSession, folder: str, cloud_id: str) -> DataFrame:
    """The points of one file ``folder``/``cloud_id``.npy; FileNotFoundError if there is none."""
    fs, root = pafs.FileSystem.from_uri(folder)
    if fs.get_file_info(f"{root}/{cloud_id}.npy").type != pafs.FileType.File:
        raise FileNotFoundError(f"there is no cloud {cloud_id!r} in {folder}")
    return read_points(spark, f"{folder}/{cloud_id}.npy")


def as_points(data) -> np.ndarray:
    """The points of an array, of anything that has ``numpy()`` or ``cpu().numpy()``, or of the path of an .npy file; ValueError for others."""
    if isinstance(data, np.ndarray):
        return data
    if hasattr(data, "cpu"):
        data = data.cpu()
    if callable(getattr(data, "numpy", None)):
        return data.numpy()
    if isinstance(data, str) and data.endswith(".npy") and os.path.exists(data):
        return np.load(data, allow_pickle=False)
    raise ValueError(f"no points in {type(data).__name__}")
