"""Connected components of an edge table: distributed union-find by alternating stars.

Each round, every node points its larger neighbours, then its smaller ones, to the least node it knows. Before the
rounds a union-find within each partition leaves at most one edge a node and partition. All joins are equi-joins
on nodes; a hub's rows are split by adaptive skew handling, and its least neighbour is found by partial aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cut


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges (a, b), with the least node that it is connected to."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = np.arange(len(nodes))
    x, y = at[: len(a)], at[len(a) :]
    while True:  # hook the larger root on the smaller one, then halve all paths
        low, high = np.minimum(parent[x], parent[y]), np.maximum(parent[x], parent[y])
        open_ = low != high
        if not open_.any():
            return nodes, nodes[parent]
        np.minimum.at(parent, high[open_], low[open_])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    out = lambda a, b: pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        size += batch.num_rows
        if size > 1 << 20:  # what is held is bounded; stars of several parts together still connect the same nodes
            a, b = union_find(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
            keep = a != b
            if keep.sum() > 1 << 19:
                yield out(a[keep], b[keep])
                held, size = [], 0
            else:
                held, size = [(a[keep], b[keep])], int(keep.sum())
    if held:
        a, b = union_find(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        keep = a != b
        yield out(a[keep], b[keep])


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a long, b long) that has an edge to another node; root is the least.

    Loops, repeated and reversed edges, and rows with a null, change nothing. Without edges the result is empty.
    """
    cut = Cut(spark)
    now = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").mapInArrow(_contract, "a long, b long")
    now = cut(now.distinct(), "edges")
    mark = None
    while True:
        # large star: every larger neighbour of a node gets the least of the node and its neighbours
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small star: the smaller neighbours of a node, and the node, get the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after = cut(small.filter("a <> b").distinct(), "edges")
        cut.free(now)
        now = after
        total = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        if total == mark and total[0] == total[2]:  # unchanged, and one edge from each node
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = total
