"""Bloom filters in slices. A key's first bits name its slice, and all its bits are there; each slice is made in one task.

The driver only puts the slices together: what reaches it is the filter itself, at most ``MAX_BITS``, whatever the number of tasks.
Beyond that size more keys pass for nothing, and no result changes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits for each key, up to ``MAX_BITS`` (64 MB) in all; ``SLICE_BITS`` (512 KB) in a slice.
BITS_PER_KEY, HASHES = 16, 3
MAX_BITS, SLICE_BITS = 1 << 29, 1 << 22

_MUL = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63], np.uint64)


def size_of(n: int, each: int = BITS_PER_KEY, most: int = MAX_BITS) -> tuple[int, int]:
    """Slices, a power of two, and bits in each, for n keys."""
    bits = max(8, 1 << min(max(each * n - 1, 1 << 12).bit_length(), most.bit_length() - 1))
    return max(1, bits // SLICE_BITS), min(bits, SLICE_BITS)


def slice_of(key: str, slices: int) -> F.Column:
    """The slice of a key, a long whose bits are random."""
    return F.shiftrightunsigned(F.col(key), 65 - slices.bit_length()).cast("int") if slices > 1 else F.lit(0)


def _places(keys: np.ndarray, slices: int, bits: int) -> np.ndarray:
    """Each key's bits in its slice, one row for each hash."""
    x = keys.view(np.uint64)
    made = []
    for m in _MUL:
        y = x * m
        made.append(((y ^ (y >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(bits))
    return np.stack(made).astype(np.int64)


def set_bits(packed: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(packed, at >> 3, (1 << (at & 7)).astype(np.uint8))


def key_filter(spark: SparkSession, keys: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """A test of keys: true for all of ``keys`` (key long, random bits), and for few others."""
    slices, bits = size_of(keys.count())

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, np.zeros(bits // 8, np.uint8)
        made = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([zlib.compress(own, 1)])], ["slice", "bits"])
        for batch in batches:
            which, key = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            at = _places(key, slices, bits)
            edge = np.flatnonzero(which[1:] != which[:-1]) + 1
            for s, e in zip([0, *edge.tolist()], [*edge.tolist(), len(which)]):
                if s == e:
                    continue
                if now is not None and which[s] != now:
                    yield made()
                    own[:] = 0
                now = int(which[s])
                set_bits(own, at[:, s:e].ravel())
        if now is not None:
            yield made()

    sorted_ = keys.select(slice_of("key", slices).alias("slice"), "key").repartition("slice").sortWithinPartitions("slice")
    whole = np.zeros((slices, bits // 8), np.uint8)
    for r in sorted_.mapInArrow(fill, "slice int, bits binary").toLocalIterator():
        whole[r.slice] = np.frombuffer(zlib.decompress(r.bits), np.uint8)
    shared = spark.sparkContext.broadcast(whole)

    def test(own: np.ndarray) -> np.ndarray:
        held = shared.value
        which = (own.view(np.uint64) >> np.uint64(65 - slices.bit_length())).astype(np.int64) if slices > 1 else np.zeros(len(own), np.int64)
        at = _places(own, slices, bits)
        return ((held[which, at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(0)

    return test
