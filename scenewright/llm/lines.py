"""Line dedup: fuzzy lines by MinHash, one line of each component stays.

A line's signature is a one-permutation MinHash of its ``SHINGLE``-character shingles, cut into ``BANDS`` bands of
``ROWS`` values; a bin without a shingle takes the value of another, chosen by its number. Lines that share a band are
candidates. With 18 bands of 8 a pair at 0.8 shares a band with a chance of 0.96 and one at 0.85 of 0.997, while unrelated
lines of one language, at 0.1, do so with one of 2 in 10 million. Candidates are compared by exact Jaccard similarity, and links
of at least ``THRESHOLD`` are joined by distributed union-find.

No bucket is expanded into pairs, and none is held by one task:

1. Buckets are read in order, slice by slice of the bands' hashes; a slice that is too large to hold is merged from sorted runs in a file. The first line of a bucket is its leader; every other line is compared with the leader
   only, in parts of ``BLOCK`` lines that each get the leader's text. Copies of a template mostly become one component here.
2. What is left are lines of buckets of three or more that aren't in their leader's component. They are compared with the bucket's lines
   of other components, part by part. So every two lines that share a band are in one component, or have been compared.

What is shuffled: 16 bytes for each band of a line that its task sees first, packed in one row for each slice and half a million of them; the texts of candidates only (a Bloom filter of
their keys, in slices that are each made in one task, keeps the others back); and the places of lines for the decisions. A line is known by
two 64-bit hashes: both decide equality; links use the first, whose collisions (about n*n/2^65 of n lines) join two nodes.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import key_filter
from .common import Cut, as_bytes, buffers, fresh, partitions, pick, small
from .components import connected_components

#: Short enough that a line of 49 characters stays linked after one edit in its middle.
SHINGLE = 5
BANDS, ROWS = 18, 8
THRESHOLD = 0.8
#: Lines of a bucket that are compared in one group.
BLOCK = 4096
#: Keys a task remembers as sent.
SEEN = 1 << 20
#: Pairs (band, k), of 16 bytes, that a task collects before it sends them, and that are held of one slice of the bands.
SENT, HELD = 1 << 19, 1 << 21
#: Slices for each partition.
SLICES = 4

_BLANKS = b" \t\n\x0b\x0c\r"
_BINS = BANDS * ROWS
_EMPTY = np.uint64(1 << 33)
_MUL = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB],
    np.uint64,
)
#: Where an empty bin looks for a value, try after try; the last tries visit all bins in turn.
_TRIES = np.stack([*(np.random.default_rng(5 + t).integers(0, _BINS, _BINS) for t in range(40)), *((np.arange(_BINS) + t) % _BINS for t in range(1, _BINS))])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(line: str) -> set[str]:
    """The shingles of a line; a shorter line is its only one."""
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


class Line:
    """A line with its set of shingles as sorted numbers, if no character is beyond 12 bits; else only the text."""

    __slots__ = ("packed", "size", "text")

    def __init__(self, text: str):
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.text, self.packed = text, None
        if len(code) and code.max() < 4096:
            n = max(1, len(code) - SHINGLE + 1)
            h = np.zeros(n, np.uint64)
            for i in range(min(SHINGLE, len(code))):
                h |= code[i : i + n] << np.uint64(12 * i)
            if len(code) < SHINGLE:  # a shorter line has one shingle, marked by its length
                h |= np.uint64(len(code) << 60)
            self.packed = np.unique(h)
        self.size = len(shingles(text)) if self.packed is None else len(self.packed)

    def similar(self, other: Line) -> bool:
        """Whether the two sets have a Jaccard similarity of ``THRESHOLD`` or more, exactly."""
        low, high = (self.size, other.size) if self.size < other.size else (other.size, self.size)
        if low < THRESHOLD * high:
            return False
        if self.packed is None or other.packed is None:
            both = len(shingles(self.text) & shingles(other.text))
        else:
            both = len(np.intersect1d(self.packed, other.packed, assume_unique=True))
        return both >= THRESHOLD * (low + high - both)


def bands(lines: list[str]) -> np.ndarray:
    """``BANDS`` hashes of each line; rows that share one in the same place are candidates."""
    out = np.empty((len(lines), BANDS), np.int64)
    for a, b in _parts(lines):
        h, own = _hashes(lines[a:b])
        out[a:b] = _bands(h, own, b - a)
    return out


def _parts(lines: list[str]) -> Iterator[tuple[int, int]]:
    """Stretches of lines that fit a core's cache."""
    k = 0
    while k < len(lines):
        end, total = k, 0
        while end < len(lines) and (end == k or total + len(lines[end]) < 1 << 16):
            total += len(lines[end]) + SHINGLE - 1
            end += 1
        yield k, end
        k = end


def _hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles of the lines, and which line each is of."""
    gap = "\0" * (SHINGLE - 1)
    code = np.frombuffer((gap.join(lines) + gap).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(x) for x in lines], np.int64)
    n = len(code) - SHINGLE + 1
    h = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        h += code[i : i + n].astype(np.uint64) * _MUL[i]
    h = _mix(_mix(h))
    many = np.maximum(size - SHINGLE + 1, 1)
    start = np.cumsum(size + SHINGLE - 1) - size - SHINGLE + 1
    own = np.repeat(np.arange(len(lines)), many)
    at = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start, many)
    return h[at], own


def _bands(h: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    sig = np.full(n * _BINS, _EMPTY)
    place = own * _BINS + (((h >> np.uint64(32)) * np.uint64(_BINS)) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(sig, place, h & np.uint64(0xFFFFFFFF))
    dense = sig.copy()
    open_ = np.flatnonzero(sig == _EMPTY)
    for where in _TRIES:
        if not len(open_):
            break
        line, own_bin = np.divmod(open_, _BINS)
        value = sig[line * _BINS + where[own_bin]]
        dense[open_] = value
        open_ = open_[value == _EMPTY]
    mixed = _mix(dense.reshape(n, BANDS, ROWS) * _MUL[0] + _MUL[:ROWS])
    return _mix(mixed.sum(2) + np.arange(1, BANDS + 1, dtype=np.uint64) * _MUL[1]).view(np.int64)


def bitmaps(lines: list[str]) -> np.ndarray:
    """256 bits a line, four numbers, in which its shingles' hashes are set: the bitmaps of two lines differ in at most as many bits as their sets have different members."""
    out = np.empty((len(lines), 4), np.uint64)
    for a, b in _parts(lines):
        h, own = _hashes(lines[a:b])
        held = np.zeros((b - a, 256), bool)
        held[own, (h & np.uint64(255)).astype(np.int64)] = True
        out[a:b] = np.packbits(held, axis=1).view(np.uint64)
    return out


def split(text: bytes) -> list[bytes]:
    """The lines, without the blanks at their ends; blank ones are empty."""
    return [x.strip(_BLANKS) for x in text.split(b"\n")]


def _keys(line: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(line)
    return (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)


def _send_bands(slices: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Makes (slice, pairs) of texts: the pairs (band, k) for each band of each line that a task hasn't seen lately, packed by slices of the bands."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        key, lines, size = [], [], 0
        made, n = [], 0

        def pairs() -> np.ndarray:
            out = np.empty((len(key), BANDS, 2), np.int64)
            out[:, :, 0] = bands([x.decode("utf-8", "replace") for x in lines])
            out[:, :, 1] = np.array(key, np.int64)[:, None]
            return out.reshape(-1, 2)

        for batch in small(batches):
            for text in as_bytes(batch.column(0)):
                for line in split(text):
                    if line and (k := _keys(line)[0]) not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(k)
                        key.append(k)
                        lines.append(line)
                        size += len(line) + 32
                        if size > 1 << 20:
                            made.append(pairs())
                            n += len(made[-1])
                            key, lines, size = [], [], 0
                        if n >= SENT:
                            whole = np.concatenate(made)
                            made, n = [], 0
                            yield _packed(whole, slices)
                            del whole
        if key:
            made.append(pairs())
        if made:
            yield _packed(np.concatenate(made), slices)

    return send


def _packed(pairs: np.ndarray, slices: int) -> pa.RecordBatch:
    """Rows (slice, pairs), one for each slice that has any."""
    which = (((pairs[:, 0].view(np.uint64) >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)).astype(np.uint16)
    data = pairs[np.argsort(which, kind="stable")]
    many = np.bincount(which, minlength=slices)
    own = np.flatnonzero(many)
    at = np.concatenate([[0], np.cumsum(many[own])]).astype(np.int32) * np.int32(data.itemsize * 2)
    column = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(at), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), column], ["slice", "pairs"])


def _sorted(pairs: np.ndarray) -> np.ndarray:
    """The different pairs, in order."""
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[1:] != pairs[:-1]).any(1)
    return pairs[new]


def _repeated(pairs: np.ndarray) -> np.ndarray:
    """The pairs whose band isn't alone, in order: few, so that only bands are sorted in full."""
    band = np.ascontiguousarray(pairs[:, 0])
    order = np.argsort(band)
    band = band[order]
    twin = band[1:] == band[:-1]
    keep = np.zeros(len(band), bool)
    keep[1:] = twin
    keep[:-1] |= twin
    return _sorted(pairs[order[keep]])


def _merged(file: BinaryIO, runs: list[tuple[int, int]]) -> Iterator[np.ndarray]:
    """The different pairs of sorted runs, from and to these rows of a file, in order and in parts; some ``HELD`` pairs are in memory."""
    block = max(1, HELD // len(runs))
    at, now = [a for a, _ in runs], [np.zeros((0, 2), np.int64)] * len(runs)
    while True:
        for i, (_, end) in enumerate(runs):
            if not len(now[i]) and at[i] < end:
                file.seek(at[i] * 16)
                now[i] = np.fromfile(file, np.int64, 2 * min(block, end - at[i])).reshape(-1, 2)
                at[i] += len(now[i])
        ends = [tuple(x[-1].tolist()) for x in now if len(x)]
        if not ends:
            return
        band, k = min(ends)  # no run has a row up to here that isn't read
        taken = []
        for i, x in enumerate(now):
            low, high = np.searchsorted(x[:, 0], band, "left"), np.searchsorted(x[:, 0], band, "right")
            n = low + np.searchsorted(x[low:high, 1], k, "right")
            taken.append(x[:n])
            now[i] = x[n:]
        yield _sorted(np.concatenate(taken))


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, k), different ones, of the buckets of two lines or more, bucket by bucket and in order of k, from rows (slice, pairs) in order of the slices.

    Of a slice, ``HELD`` pairs are held; the rest is in sorted runs in a file. Buckets of one line may come too.
    """
    now, held, size = None, [], 0
    file, runs, end = None, [], 0
    made = lambda x: pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in x.T], ["band", "k"])

    def put() -> None:
        nonlocal file, end
        if file is None:
            file = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
        run = _sorted(np.concatenate(held))
        file.seek(end * 16)
        file.write(run.data)
        file.flush()
        runs.append((end, end + len(run)))
        end += len(run)

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal file, end
        if not runs:
            if held:
                yield made(_repeated(np.concatenate(held)))
            return
        if held:
            put()
        yield from map(made, _merged(file, runs))
        file.close()
        file, end = None, 0
        runs.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        which = batch.column(0).to_numpy(zero_copy_only=False)
        raw, at = buffers(batch.column(1))
        pairs, at = raw.view(np.int64).reshape(-1, 2), at // 16
        edge = [0, *(np.flatnonzero(which[1:] != which[:-1]) + 1).tolist(), len(which)]
        for s, e in zip(edge, edge[1:]):
            if which[s] != now:
                yield from close()
                now, held, size = which[s], [], 0
            for a in range(at[s], at[e], HELD):
                held.append(pairs[a : min(a + HELD, at[e])])
                size += len(held[-1])
                if size > HELD:
                    put()
                    held, size = [], 0
    yield from close()


def _leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lead, part, k) for the lines of each bucket of two or more, from rows (band, k) in order: lead is the bucket's first line.

    A part has up to ``BLOCK`` lines, and the leader is in each. Nothing is held but the last row's bucket, leader and place.
    """
    band = lead = last = None
    size = 0
    for batch in batches:
        b, k = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(b):
            continue
        new = np.ones(len(b), bool)
        new[1:] = (b[1:] != b[:-1]) | (k[1:] != k[:-1])
        new[0] = (int(b[0]), int(k[0])) != last
        last = int(b[-1]), int(k[-1])
        b, k = b[new], k[new]
        if not len(b):
            continue
        start = np.concatenate([[0], np.flatnonzero(b[1:] != b[:-1]) + 1])
        many = np.diff(np.concatenate([start, [len(b)]]))
        first, ahead = k[start].copy(), np.zeros(len(start), np.int64)
        if b[0] == band:
            first[0], ahead[0] = lead, size
        place = np.arange(len(b)) - np.repeat(start - ahead, many)
        of = np.repeat(first, many)
        band, lead, size = b[-1], first[-1], int(place[-1]) + 1
        member = place > 0
        opens = (place == 1) | (member & (place % BLOCK == 0))
        part = place // BLOCK
        leads, parts = np.concatenate([of[member], of[opens]]), np.concatenate([part[member], part[opens]])
        yield pa.RecordBatch.from_arrays([pa.array(leads), pa.array(parts.astype(np.int32)), pa.array(np.concatenate([k[member], of[opens]]))], ["lead", "part", "k"])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lead, part, k) as of ``_leaders``, from rows (slice, pairs) in order of the slices."""
    return _leaders(_in_order(batches))


_EDGE = ["a", "b"]


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], _EDGE)


def _with_leader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between lines and their leader, from rows (lead, part, other, k, line) in order: the leader comes first in each part."""
    now, leader = None, None
    for batch in small(batches):
        found = []
        for lead, part, k, line in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
            if k == lead:
                if (lead, part) != now:
                    now, leader = (lead, part), Line(line)
            elif (lead, part) == now and leader.similar(Line(line)):
                found.append((k, lead))
        yield _edges(found)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between the lines of two parts that are in different components, from rows (lead, i, j, side, k, root, line) in order.

    Side 0 has the lines of part i outside their leader's component, and side 1 all of part j.
    """
    now, left, right = None, [], []

    def close() -> list[tuple[int, int]]:
        if not left or not right:
            return []
        a, b = bitmaps([x[2] for x in left]), bitmaps([x[2] for x in right])
        root = np.array([x[1] for x in right])
        size = np.array([max(1, len(x[2]) - SHINGLE + 1) for x in right])
        share, found, sets = (1 - THRESHOLD) / (1 + THRESHOLD), [], {}
        for (k, r, line), bits in zip(left, a):
            near = (root != r) & (np.bitwise_count(b ^ bits).sum(1) <= share * (size + max(1, len(line) - SHINGLE + 1)) + 1e-6)
            at = np.flatnonzero(near).tolist()
            if at:
                own = Line(line)
                for i in at:
                    if i not in sets:
                        sets[i] = Line(right[i][2])
                    if own.similar(sets[i]):
                        found.append((k, right[i][0]))
        return found

    for batch in batches:
        found = []
        for lead, i, j, side, k, root, line in zip(*(c.to_pylist() for c in batch.columns)):
            if (lead, i, j) != now:
                found += close()
                now, left, right = (lead, i, j), [], []
            (right if side else left).append((k, root, line))
        yield _edges(found)
    yield _edges(close())


def line_classes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(node, root) for the keys of lines that are similar to another, different line."""
    cut = Cut(spark)
    texts = pick(docs, text="text")
    parts = partitions(docs, 4)
    sent = texts.mapInArrow(_send_bands(min(SLICES * parts, 1 << 16)), "slice int, pairs binary")
    near = sent.repartitionById(parts, F.col("slice") % parts).sortWithinPartitions("slice")
    members = cut(near.mapInArrow(_members, "lead long, part int, k long").distinct(), "members")
    wanted = cut(_texts(spark, texts, members.select("k")), "candidates")
    rows = members.join(wanted, F.col("k") == F.col("c"))
    group = rows.select("lead", "part", (F.col("k") != F.col("lead")).alias("other"), "k", "line")
    edges = cut(group.repartition(parts, "lead", "part").sortWithinPartitions("lead", "part", "other").mapInArrow(_with_leader, "a long, b long"), "edges")
    classes = connected_components(spark, edges)

    # the lines of larger buckets that aren't in their leader's component
    name = lambda c: classes.select(F.col("node").alias(f"{c}_node"), F.col("root").alias(f"{c}_root"))
    placed = members.filter("k <> lead").join(name("k"), F.col("k") == F.col("k_node"), "left").join(name("lead"), F.col("lead") == F.col("lead_node"), "left")
    placed = placed.select("lead", "part", "k", F.coalesce("k_root", "k").alias("root"), F.coalesce("lead_root", "lead").alias("own"))
    open_ = placed.groupBy("lead").agg(F.count("*").alias("n"), F.count_if(F.col("root") != F.col("own")).alias("away")).filter("n > 1 and away > 0").select(F.col("lead").alias("o_lead"))
    left = cut(placed.join(open_, F.col("lead") == F.col("o_lead"), "left_semi"), "open")
    if left.isEmpty():
        return classes
    away = left.filter("root <> own")
    i, j = away.select("lead", F.col("part").alias("i")).distinct(), left.select("lead", F.col("part").alias("j")).distinct()
    sides = away.withColumnRenamed("part", "i").join(j, "lead").select("lead", "i", "j", F.lit(0).alias("side"), "k", "root")
    sides = sides.unionByName(left.withColumnRenamed("part", "j").join(i, "lead").select("lead", "i", "j", F.lit(1).alias("side"), "k", "root"))
    pairs = sides.join(wanted, F.col("k") == F.col("c")).select("lead", "i", "j", "side", "k", "root", "line")
    more = pairs.repartition(parts, "lead", "i", "j").sortWithinPartitions("lead", "i", "j").mapInArrow(_across, "a long, b long")
    return connected_components(spark, edges.unionByName(more))


def _texts(spark: SparkSession, texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(c, line) of the lines with these keys, and of the few others that the filter lets through."""
    test = key_filter(spark, keys.select(F.col("k").alias("key")).distinct())

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in small(batches):
            lines = {}
            for text in as_bytes(batch.column(0)):
                for line in split(text):
                    if line and (k := _keys(line)[0]) not in seen:
                        lines.setdefault(k, line)
            own = np.fromiter(lines, np.int64, len(lines))
            chosen = own[test(own)].tolist()
            if len(seen) >= SEEN:
                seen.clear()
            seen.update(chosen)
            yield pa.RecordBatch.from_arrays([pa.array(chosen, pa.int64()), pa.array([lines[k].decode("utf-8", "replace") for k in chosen], pa.string())], ["c", "line"])

    return texts.mapInArrow(candidates, "c long, line string").dropDuplicates(["c", "line"])


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, x, no, k, k2) of each line that isn't blank."""
    for batch in small(batches):
        row, number, k1, k2 = [], [], [], []
        for r, text in enumerate(as_bytes(batch.column(2))):
            for no, line in enumerate(split(text)):
                if line:
                    a, b = _keys(line)
                    row.append(r)
                    number.append(no)
                    k1.append(a)
                    k2.append(b)
        at = pa.array(row, pa.int64())
        columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(number, pa.int32()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["d", "x", "no", "k", "k2"])


def _count_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        n = [sum(map(bool, split(t))) for t in as_bytes(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["d", "x", "n_lines"])


def _own(docs: DataFrame) -> tuple[DataFrame, str]:
    """(d, x, text): id, a hash of the text, and the text; and the id's type."""
    own = pick(docs, d="doc_id", text="text").select("d", F.xxhash64("text").alias("x"), "text")
    return own, own.schema["d"].dataType.simpleString()


def decisions(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(d, x, gone) for each document that loses a line: its id, a hash of its text, and the sorted numbers, from 0, of the lines to drop.

    Of similar lines, joined by links, the one stays that comes first by doc_id (null last), then by text hash and line.
    Rows that repeat doc_id and text are one document here. Blank lines never count, and stay.
    """
    own, key = _own(docs)
    cut = Cut(spark)
    classes = line_classes(spark, docs)
    found = own.mapInArrow(_occurrences, f"d {key}, x long, no int, k long, k2 long").join(classes, F.col("k") == F.col("node"), "left")
    found = found.select("d", "x", "no", F.coalesce("root", "k").alias("c"), F.when(F.col("root").isNull(), F.col("k2")).otherwise(F.lit(0)).alias("c2"))
    found = cut(found, "lines")
    place = F.struct(F.col("d").isNull().alias("none"), "d", "x", "no")
    # repeated rows are the same place: at worst a place is compared with itself
    first = found.groupBy("c", "c2").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1")
    first = first.select(F.col("c").alias("f"), F.col("c2").alias("f2"), "first")
    joined = found.join(first, (F.col("c") == F.col("f")) & (F.col("c2") == F.col("f2"))).filter(~F.col("first").eqNullSafe(place))
    return joined.groupBy("d", "x").agg(F.sort_array(F.collect_set("no")).alias("gone"))


def line_report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, dropped) for each different (doc_id, text): lines that aren't blank, and those dropped, comma-joined numbers from 0."""
    own, key = _own(docs)
    counts = own.mapInArrow(_count_lines, f"d {key}, x long, n_lines long").distinct().select(F.col("d").alias("doc_id"), F.col("x").alias("hash"), "n_lines")
    found = decisions(spark, docs)
    joined = counts.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("x")), "left")
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    return joined.select("doc_id", "n_lines", F.size(gone).cast("long").alias("n_dropped"), F.array_join(gone.cast("array<string>"), ",").alias("dropped"))


def dedup_lines(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` without the dropped lines. A row that loses all its lines goes; others keep their columns but for ``text``, and ``n_chars`` where there is one."""
    d, x, gone = fresh(docs, "line_doc", "line_hash", "line_gone")
    found = decisions(spark, docs).select(F.col("d").alias(d), F.col("x").alias(x), F.col("gone").alias(gone))
    joined = docs.join(found, docs["doc_id"].eqNullSafe(F.col(d)) & (F.xxhash64(docs["text"]) == F.col(x)), "left")
    lines, n = F.split(docs["text"], "\n"), F.size(gone)
    # the stretches between dropped lines, so that the work is in proportion to the lines
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get(gone, i - 1) + 1)
    stretch = lambda i: F.slice(lines, begin(i) + 1, F.when(i == n, F.size(lines)).otherwise(F.get(gone, i)) - begin(i))
    same = F.col(gone).isNull()
    new = F.when(same, docs["text"]).otherwise(F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), n), stretch)), "\n"))
    rest = {"text": new}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        rest["n_chars"] = F.when(same, docs["n_chars"]).otherwise(F.char_length(new).cast(kind))
    left = joined.filter(same | new.rlike(r"[^\x20\x09-\x0D]"))
    return left.select(*[rest[c].alias(c) if c in rest else docs[f"`{c}`"] for c in docs.columns])
