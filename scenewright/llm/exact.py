"""Exact duplicates: two passes with a Bloom filter of cells that were hit twice.

Pass one hashes every normalised text once, writes the small digest table, and fills a Bloom filter whose cells
saturate at two. A text that occurs twice has all its cells hit twice, so pass two can let every row with a cell below
two straight through; only the rest, the repeated texts and a few false positives, are shuffled and grouped.

The filter has ``CELLS_PER_ROW`` cells a row up to ``MAX_CELLS``: 128 MB are broadcast at most. It is cut into slices by the digests' first
bits; each task packs its cells slice by slice, and each slice is merged in one task of its own, so that the driver gets the finished filter only.
At ``MAX_CELLS`` a unique row has under 3 % of chance to be held back up to 134 million rows; beyond that more rows shuffle (32 bytes of
digest each, never texts), and the result is the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import set_bits, size_of
from .common import BLANK, Cut, pick

CELLS_PER_ROW = 16
HASHES = 4
MAX_CELLS = 1 << 30


def normalised(text) -> F.Column:
    """The text without its blanks; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK + "+", "")


def digests(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, size, digest) of every row of ``docs`` (doc_id, text): code points of the text, SHA-256 of the normalised one."""
    t = pick(docs, doc_id="doc_id", text="text")
    return t.select(
        F.monotonically_increasing_id().alias("rid"),
        "doc_id",
        F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("size"),
        F.unhex(F.sha2(F.encode(normalised(F.col("text")), "UTF-8"), 256)).alias("digest"),
    )


def cells(digest: pa.Array, slices: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each digest's slice, and its ``HASHES`` cells there, one row of the array for each hash."""
    raw = np.frombuffer(b"".join(digest.to_pylist()), np.uint64).reshape(-1, 4)
    which = (raw[:, 2] % np.uint64(slices)).astype(np.int64)
    return which, np.stack([(raw[:, 0] + np.uint64(i) * (raw[:, 1] | np.uint64(1))) % np.uint64(bits) for i in range(HASHES)]).astype(np.int64)


def _hit(once: np.ndarray, twice: np.ndarray, at: np.ndarray) -> None:
    """Mark cells (one column a row of the table), each row hitting a cell once."""
    part = np.sort(at, axis=0)
    own = np.concatenate([part[:1].ravel(), part[1:][part[1:] != part[:-1]]])
    hit, n = np.unique(own, return_counts=True)
    before = (once[hit >> 3] >> (hit & 7).astype(np.uint8)) & 1
    set_bits(twice, hit[(n > 1) | (before == 1)])
    set_bits(once, hit)


def twice_hit(table: DataFrame, slices: int, bits: int) -> np.ndarray:
    """The packed cells, a row of bytes for each slice, that at least two rows of ``table`` (digest) hit."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = (np.zeros((slices, bits // 8), np.uint8) for _ in range(2))
        used = np.zeros(slices, bool)
        for batch in batches:
            if batch.num_rows:
                which, at = cells(batch.column(0), slices, bits)
                order = np.argsort(which, kind="stable")
                edge = np.flatnonzero(np.diff(which[order])) + 1
                for rows in np.split(order, edge):
                    k = which[rows[0]]
                    used[k] = True
                    _hit(once[k], twice[k], at[:, rows])
        for k in np.flatnonzero(used).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([zlib.compress(x[k], 1)]) for x in (once, twice))], ["slice", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = None, None, None
        made = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([zlib.compress(twice, 1)])], ["slice", "twice"])
        for batch in batches:
            for k, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
                if k == now:  # twice if twice in either, or once in both
                    once, twice = once | a, twice | b | (once & a)
                else:
                    if now is not None:
                        yield made()
                    now, once, twice = k, a, b
        if now is not None:
            yield made()

    # as many parts as tasks run at once: each packs its cells once
    tasks = table.sparkSession.sparkContext.defaultParallelism
    parts = table.select("digest").coalesce(tasks).mapInArrow(fill, "slice int, once binary, twice binary")
    merged = parts.repartition("slice").sortWithinPartitions("slice").mapInArrow(merge, "slice int, twice binary")
    whole = np.zeros((slices, bits // 8), np.uint8)
    for r in merged.toLocalIterator():
        whole[r.slice] = np.frombuffer(zlib.decompress(r.twice), np.uint8)
    return whole


def exact_groups(spark: SparkSession, docs: DataFrame, max_cells: int = MAX_CELLS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest) for each row of ``docs`` (doc_id, text).

    Texts are equal when identical without blanks; null counts as empty. Of equal texts the row with the most code
    points in its text stays, then the smallest doc_id (null last), then, among repeated rows, the first one read.
    An empty table gives an empty result.
    """
    cut = Cut(spark)
    rows = cut(digests(docs), "digests")
    n = rows.count()
    slices, bits = size_of(n, CELLS_PER_ROW, max_cells)
    twice = spark.sparkContext.broadcast(twice_hit(rows, slices, bits))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = twice.value
        for batch in batches:
            maybe = np.zeros(0, bool)
            if batch.num_rows:
                which, at = cells(batch.column(3), slices, bits)
                maybe = ((held[which, at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maybe)], [*batch.schema.names, "maybe"])

    key = rows.schema["doc_id"].dataType.simpleString()
    tested = cut(rows.mapInArrow(test, f"rid long, doc_id {key}, size long, digest binary, maybe boolean"), "tested")
    cut.free(rows)
    alone = tested.filter("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    some = tested.filter("maybe")
    best = F.min(F.struct((-F.col("size")).alias("s"), F.col("doc_id").isNull().alias("n"), "doc_id", "rid"))
    groups = some.groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size"))
    joined = some.join(groups, "digest").select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"), "digest")
    return alone.unionByName(joined)
