"""Scenes, catalog and points as views over the tables at hand; the same definitions as SQL text for the twin queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..enums import count_splits
from ..operators.numbering import numbered  # noqa: F401

SEED = 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scene_objects(spark: SparkSession, sf_dir: str, in_range: bool = True) -> DataFrame:
    """An order is a scene, a line of it an object: position from quantity, price and discount, extents from the part."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    w = Window.partitionBy("l_orderkey")
    idx = F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")) - 1
    # names are given after the windows, so that a filter on scene_id is one on their key, and reaches the table
    rows = rows.withColumns({"idx": idx.cast("long"), "n": F.count("*").over(w)})
    made = rows.select(
        F.col("l_orderkey").alias("scene_id"),
        "idx",
        "n",
        F.col("l_partkey").alias("object_id"),
        F.col("p_name").alias("object_name"),
        F.col("l_quantity").alias("px"),
        (F.col("l_extendedprice") / 1000).alias("py"),
        (F.col("l_discount") * 100).alias("pz"),
        F.col("p_size").cast("double").alias("hx"),
        (F.col("p_retailprice") / 100).alias("hy"),
        (1 + F.col("l_tax")).alias("hz"),
    )
    return (made.filter(F.col("n").between(2, 9)) if in_range else made).drop("n")


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part is a component of the object with its name; large parts have no material."""
    part = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    return part.select(
        F.col("p_name").alias("object_name"),
        F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("component"),
        F.when(F.col("p_size") <= 40, F.col("p_brand")).alias("material"),
        words[0].alias("color"),
        words[1].alias("shape"),
        F.col("p_type").alias("texture"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, object_id, object_name): one row a name, numbered from 0 in the order of names. The names are few: one group is ranked."""
    by = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("object_name")).agg(F.min("p_partkey").alias("object_id"))
    return by.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("object_name")) - 1).cast("long").alias("ord"), "object_id", "object_name")


def splits(spark: SparkSession) -> DataFrame:
    rows = [(n, k, list(c)) for n, all_ in count_splits().items() for k, c in enumerate(all_)]
    return spark.createDataFrame(rows, "n long, cfg long, counts array<long>")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three coordinates of an embedding are a point, its label is the cloud."""
    e = table(spark, sf_dir, "embeddings")
    at = lambda k: F.col("embedding")[k].cast("double")
    return e.select(F.col("label").cast("long").alias("cloud_id"), F.col("vec_id").alias("pt"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


#: The same views for DuckDB, to be put before a query.
VIEWS_SQL = """
WITH lines_ AS (
    SELECT l_orderkey AS scene_id,
           CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS BIGINT) AS idx,
           count(*) OVER (PARTITION BY l_orderkey) AS n, l_partkey AS object_id, p_name AS object_name,
           l_quantity AS px, l_extendedprice / 1000 AS py, l_discount * 100 AS pz,
           CAST(p_size AS DOUBLE) AS hx, p_retailprice / 100 AS hy, 1 + l_tax AS hz
    FROM lineitem JOIN part ON l_partkey = p_partkey
), so AS (
    SELECT *, 8.0::DOUBLE * hx * hy * hz AS vol FROM lines_ WHERE n BETWEEN 2 AND 9
), comp AS (
    SELECT p_name AS object_name, 'part_' || p_partkey AS component, CASE WHEN p_size <= 40 THEN p_brand END AS material,
           split_part(p_name, ' ', 1) AS color, split_part(p_name, ' ', 2) AS shape, p_type AS texture
    FROM part
), long_ AS (
    SELECT object_name, component, attribute, value FROM comp UNPIVOT (value FOR attribute IN (material, color, shape, texture)) WHERE value <> ''
), ov AS (
    SELECT object_name, attribute, list_sort(list(DISTINCT value)) AS vals FROM long_ GROUP BY object_name, attribute
), cat AS (
    SELECT CAST(row_number() OVER (ORDER BY p_name) - 1 AS BIGINT) AS ord, min(p_partkey) AS object_id, p_name AS object_name FROM part GROUP BY p_name
), pairs_ AS (
    SELECT r.scene_id, r.n, r.idx AS ref_idx, r.object_name AS ref_name, t.idx AS target_idx, t.object_name AS target_name,
           (t.px - r.px) AS dx, (t.py - r.py) AS dy, (t.pz - r.pz) AS dz, t.vol AS target_vol, r.vol AS ref_vol
    FROM so r JOIN so t ON r.scene_id = t.scene_id AND r.idx <> t.idx
), pairs AS (
    SELECT *, dx * dx + dy * dy + dz * dz AS d2,
           CASE WHEN abs(dx) >= abs(dy) AND abs(dx) >= abs(dz) THEN CASE WHEN dx > 0 THEN 'to the right of' ELSE 'to the left of' END
                WHEN abs(dy) >= abs(dz) THEN CASE WHEN dy > 0 THEN 'above' ELSE 'below' END
                ELSE CASE WHEN dz > 0 THEN 'in front of' ELSE 'behind' END END AS direction
    FROM pairs_
), pts AS (
    SELECT CAST(label AS BIGINT) AS cloud_id, vec_id AS pt, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings
)
"""


def splits_sql() -> str:
    rows = ", ".join(f"({n}, {k}, {list(c)})" for n, all_ in count_splits().items() for k, c in enumerate(all_))
    return f"(VALUES {rows}) AS splits(n, cfg, counts)"
