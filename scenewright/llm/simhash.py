"""SimHash near-duplicates by covering locality-sensitive hashing.

64-bit fingerprints of word pairs are linked at ``RADIUS`` = 6 or fewer differing bits. Bit i is labelled with the
vector (1, i) of 7 bits; table v keeps the bits whose label has an odd product with v. The labels of 6 differing bits
span at most 6 dimensions, so some nonzero v is orthogonal to all of them: table v drops every bit in which the two
differ, and they collide there for certain. Of the 127 tables one keeps all bits (equal fingerprints, which are
grouped beforehand); each of the other 126 keeps exactly 32.

Rows: one for each *distinct* fingerprint and table are shuffled, 12 bytes of payload each. A bucket is read as a sorted stream; one
of more than ``BLOCK`` fingerprints is cut into blocks, whose pairs are separate tasks' work. A pair is counted in
the first table in which it collides and never emitted: a bucket yields counts by fingerprint and a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cut, as_bytes, fresh, pick, small
from .components import connected_components, union_find

RADIUS = 6
#: Fingerprints of a bucket that are compared in one group.
BLOCK = 1 << 14
#: Bytes of a row of a table, and what a shuffle partition should get.
ROW_BYTES, PART_BYTES = 32, 128 << 20


def _masks() -> np.ndarray:
    made = []
    for v in range(1, 128):
        bits = sum(1 << i for i in range(64) if (v & (64 | i)).bit_count() % 2)
        if bits != (1 << 64) - 1:
            made.append(bits)
    return np.array(made, np.uint64)


MASKS = _masks()
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_OFFSET = (np.arange(8, dtype=np.int64) * 256)[None, :]


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint of a text in UTF-8; zero if it has no word."""
    words = text.lower().split()  # bytes: lower-cases A-Z only, splits at the six ASCII blanks only
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    pairs = [h(b"%b %b" % p, 42) for p in zip(words, words[1:])] or [h(words[0], 42)]
    raw = np.array(pairs, np.uint64).view(np.uint8).reshape(-1, 8)
    seen = np.bincount((raw + _OFFSET).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits((seen * 2 > len(pairs)).ravel(), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, h, fp) of each row of ``docs`` (doc_id, text): a hash of the text, and the fingerprint as a signed long. A null text has no words."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            made = np.fromiter((fingerprint(t) for t in as_bytes(batch.column(2))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made.view(np.int64))], ["doc_id", "h", "fp"])

    own = pick(docs, doc_id="doc_id", text="text").select("doc_id", F.xxhash64("text").alias("h"), "text")
    return own.mapInArrow(each, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, h long, fp long")


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (bucket key, table, fingerprint) for each table; the key has the masked bits, mixed with the table."""
    number = np.arange(len(MASKS), dtype=np.int16)
    for batch in batches:
        every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for k in range(0, len(every), 4096):
            fp = every[k : k + 4096]
            key = _squeeze(fp[:, None] & MASKS[None, :])
            columns = [pa.array(key.ravel()), pa.array(np.tile(number, len(fp))), pa.array(np.repeat(fp.view(np.int64), len(MASKS)))]
            yield pa.RecordBatch.from_arrays(columns, ["k", "t", "fp"])


def _squeeze(masked: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the masked bits. Two buckets with one hash only share a task's scan: pairs are tested by distance and mask."""
    x = masked * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32).view(np.int32)


def first_table(diff: np.ndarray, table: int) -> np.ndarray:
    """Whether ``table`` is the first that the pairs with these differing bits collide in."""
    ok = np.flatnonzero((diff & MASKS[table]) == 0)
    for mask in MASKS[:table]:
        if not len(ok):
            break
        ok = ok[(diff[ok] & mask) != 0]
    out = np.zeros(len(diff), bool)
    out[ok] = True
    return out


def links(table: int, x: np.ndarray, y: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within x, or between x and y, that are linked and first collide in ``table``."""
    left, right = [], []
    other = x if y is None else y
    step = max(1, (1 << 20) // max(1, len(other)))
    for k in range(0, len(x), step):
        diff = x[k : k + step, None] ^ other[None, :]
        i, j = np.nonzero(np.bitwise_count(diff) <= RADIUS)
        i += k
        if y is None:
            keep = i < j
            i, j = i[keep], j[keep]
        if len(i):
            keep = first_table(x[i] ^ other[j], table)
            left.append(i[keep])
            right.append(j[keep])
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


_OUT = "what byte, k int, t short, block int, a long, b long"
_NAMES = ["what", "k", "t", "block", "a", "b"]
_NEAR, _EDGE, _HOT = 0, 1, 2


def _rows(what: int, a: np.ndarray, b: np.ndarray, k: int = 0, t: int = 0, block: int = 0) -> pa.RecordBatch:
    n = len(a)
    full = lambda v, kind: pa.array(np.full(n, v, kind))
    return pa.RecordBatch.from_arrays([full(what, np.int8), full(k, np.int32), full(t, np.int16), full(block, np.int32), pa.array(a), pa.array(b)], _NAMES)


class _Found:
    """Counts by fingerprint and edges, handed on before they grow large."""

    def __init__(self):
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []
        self.near_of: list[np.ndarray] = []
        self.near: list[np.ndarray] = []
        self.size = 0

    def add(self, x: np.ndarray, nx: np.ndarray, i: np.ndarray, y: np.ndarray, ny: np.ndarray, j: np.ndarray) -> None:
        if not len(i):
            return
        for fp, own, theirs, n in ((x, i, j, ny), (y, j, i, nx)):
            total = np.bincount(own, weights=n[theirs], minlength=len(fp))
            has = np.flatnonzero(total)
            self.near_of.append(fp[has].view(np.int64))
            self.near.append(total[has].astype(np.int64))
        nodes, roots = union_find(x[i].view(np.int64), y[j].view(np.int64))
        keep = nodes != roots
        self.a.append(nodes[keep])
        self.b.append(roots[keep])
        self.size += len(i)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.near:
            fp, at = np.unique(np.concatenate(self.near_of), return_inverse=True)
            yield _rows(_NEAR, fp, np.bincount(at, weights=np.concatenate(self.near)).astype(np.int64))
            nodes, roots = union_find(np.concatenate(self.a), np.concatenate(self.b))
            keep = nodes != roots
            yield _rows(_EDGE, nodes[keep], roots[keep])
        self.__init__()


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets from rows (k, t, fp, n) sorted by table and key. One of over BLOCK rows goes on in numbered blocks."""
    found, held, key, block = _Found(), [], None, 0

    def close(key, held, block):
        x = np.concatenate([h[0] for h in held])
        n = np.concatenate([h[1] for h in held])
        if block:
            return [_rows(_HOT, x.view(np.int64), n, *key, block)]
        if len(x) > 1:
            i, j = links(key[1], x)
            found.add(x, n, i, x, n, j)
        return []

    for batch in batches:
        k, t, fp, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        fp = fp.view(np.uint64)
        edge = np.flatnonzero((k[1:] != k[:-1]) | (t[1:] != t[:-1])) + 1
        start, stop = np.concatenate([[0], edge]), np.concatenate([edge, [len(k)]])
        same_first = key == (int(k[0]), int(t[0])) if len(k) else False
        lone = stop - start == 1  # a bucket of one row ends here unless the batch does
        if len(start):
            lone[-1] = False
            if same_first or held:
                lone[0] = False
        for s, e in zip(start[~lone].tolist(), stop[~lone].tolist()):
            now = (int(k[s]), int(t[s]))
            if now != key:
                if held:
                    yield from close(key, held, block)
                key, held, block = now, [], 0
            held.append((fp[s:e], n[s:e]))
            while (size := sum(len(h[0]) for h in held)) > BLOCK:
                x, m = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                block += 1
                yield _rows(_HOT, x[:BLOCK].view(np.int64), m[:BLOCK], *key, block)
                held = [(x[BLOCK:], m[BLOCK:])]
        if found.size > 1 << 20:
            yield from found.rows()
    if held:
        yield from close(key, held, block + 1 if block else 0)
    yield from found.rows()


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks from rows (k, t, i, j, block, fp, n), sorted by the first four."""
    found, held, key = _Found(), [], None

    def close():
        k, t, i, j = key
        part = {b: (np.concatenate([h[1] for h in held if h[0] == b] or [np.zeros(0, np.uint64)]), np.concatenate([h[2] for h in held if h[0] == b] or [np.zeros(0, np.int64)])) for b in (i, j)}
        (x, nx), (y, ny) = part[i], part[j]
        p, q = links(t, x) if i == j else links(t, x, y)
        found.add(x, nx, p, y, ny, q)

    for batch in batches:
        c = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
        change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in c[:5]], axis=0)) + 1
        for s, e in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
            if s == e:
                continue
            now = tuple(int(x[s]) for x in c[:4])
            if now != key:
                if held:
                    close()
                    if found.size > 1 << 20:
                        yield from found.rows()
                key, held = now, []
            held.append((int(c[4][s]), c[5][s:e].view(np.uint64), c[6][s:e]))
    if held:
        close()
    yield from found.rows()


def _classes(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, fp) of each row; and (g, n, more, root) of each fingerprint g: its rows, the rows of others linked to it, and its component."""
    cut = Cut(spark)
    printed = cut(fingerprints(docs), "fingerprints")
    groups = cut(printed.groupBy("fp").agg(F.count("*").alias("n")), "groups")
    every = groups.count() * len(MASKS) * ROW_BYTES
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), every // PART_BYTES + 1)

    def with_n(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(1).to_numpy(zero_copy_only=False)
            k = 0
            for made in _tables(iter([batch.select([0])])):
                rows = made.num_rows // len(MASKS)
                yield pa.RecordBatch.from_arrays([*made.columns, pa.array(np.repeat(n[k : k + rows], len(MASKS)).astype(np.int32))], ["k", "t", "fp", "n"])
                k += rows

    spread = groups.select("fp", "n").repartition(max(spark.sparkContext.defaultParallelism * 2, every // PART_BYTES + 1), "fp").mapInArrow(with_n, "k int, t short, fp long, n int")
    sorted_ = spread.repartition(parts, "k", "t").sortWithinPartitions("t", "k").select("k", "t", "fp", F.col("n").cast("long").alias("n"))
    first = cut(sorted_.mapInArrow(_buckets, _OUT), "buckets")
    hot = first.filter(f"what = {_HOT}").select("k", "t", "block", F.col("a").alias("fp"), F.col("b").alias("n"))
    blocks = hot.groupBy("k", "t").agg(F.max("block").alias("blocks"))
    # each block meets every block of its bucket once: as i with those not before it, as j with those before it
    pairs = hot.join(blocks, ["k", "t"]).select("k", "t", "block", "fp", "n", F.explode(F.sequence(F.lit(1), "blocks")).alias("o"))
    pairs = pairs.select("k", "t", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "fp", "n")
    pairs = pairs.repartition(parts, "k", "t", "i", "j").sortWithinPartitions("k", "t", "i", "j", "block")
    second = pairs.mapInArrow(_block_pairs, _OUT)
    found = cut(first.filter(f"what <> {_HOT}").unionByName(second), "found")
    near = found.filter(f"what = {_NEAR}").groupBy(F.col("a").alias("near_fp")).agg(F.sum("b").alias("more"))
    roots = connected_components(spark, found.filter(f"what = {_EDGE}").select("a", "b"))
    classes = groups.join(roots, groups.fp == roots.node, "left").join(near, groups.fp == near.near_fp, "left")
    return printed, cut(classes.select(F.col("fp").alias("g"), "n", F.coalesce("more", F.lit(0)).alias("more"), F.coalesce("root", "fp").alias("root")), "classes")


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, fp, n_near, component_id) for each row of ``docs`` (doc_id, text), whose ids may have any type that is ordered.

    n_near: other rows at 6 or fewer differing bits, equal fingerprints included; component_id: the smallest doc_id
    reachable by links. Texts without a word (null, empty, blank) have fingerprint zero and are linked like any others.
    Rows with a null doc_id count as rows; a component of nothing else has a null id. Repeated rows are links of each
    other. An empty table gives an empty result.
    """
    printed, classes = _classes(spark, docs)
    rows = printed.join(classes, F.col("fp") == F.col("g"))
    least = rows.groupBy(F.col("root").alias("r")).agg(F.min("doc_id").alias("component_id"))
    named = classes.join(least, F.col("root") == F.col("r")).select("g", (F.col("n") - 1 + F.col("more")).alias("n_near"), "component_id")
    return printed.join(named, F.col("fp") == F.col("g")).select("doc_id", "fp", "n_near", "component_id")


def keep_first(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row of each component, all columns unchanged: that with the smallest doc_id (null last), then the smallest text hash.

    So a text never goes because of another with its id. Of rows that repeat both the id and the text one stays, whichever.
    """
    d, h, one = fresh(docs, "near_doc", "near_hash", "near_one")
    printed, classes = _classes(spark, docs)
    rows = printed.join(classes.select("g", "root"), F.col("fp") == F.col("g"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    rows = Cut(spark)(rows.groupBy("root", "doc_id", "h").agg(F.count("*").alias("copies")), "rows")
    first = rows.groupBy(F.col("root").alias("r")).agg(F.min(place).alias("first"))
    marked = rows.join(first, F.col("root") == F.col("r")).withColumn("stays", F.col("first").eqNullSafe(place))
    gone = marked.filter("not stays").select(F.col("doc_id").alias(d), F.col("h").alias(h))
    again = marked.filter("stays and copies > 1").select(F.col("doc_id").alias(d), F.col("h").alias(h))
    same = docs["doc_id"].eqNullSafe(F.col(d)) & (F.xxhash64(docs["text"]) == F.col(h))
    kept = docs.join(gone.withColumn(one, F.lit(False)).unionByName(again.withColumn(one, F.lit(True))), same, "left")
    plain = kept.filter(F.col(one).isNull()).select(*[docs[f"`{c}`"] for c in docs.columns])
    rest = kept.filter(F.col(one)).dropDuplicates([d, h]).select(*[docs[f"`{c}`"] for c in docs.columns])
    return plain.unionByName(rest) if not again.isEmpty() else plain
