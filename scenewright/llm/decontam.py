"""Benchmark decontamination: pigeonhole edit matching.

A test item of n bytes has an error budget of k edits. It is split into k+1 pieces; where an occurrence has at most k
edits, one piece at least is untouched, so exact piece hits find every occurrence. Piece hits are found in all positions
of a document at once by hashes of 8 or 16 bytes, and the text around a hit is verified with Myers' bit-parallel
distance. Texts are compared in UTF-8 with A-Z lower-cased and blanks made single spaces.

Test sets are broadcast in blocks of at most ``BLOCK_BYTES``. Blocks of ``PASS_BYTES`` in all are held at once: a document passes them in one
stage, without a shuffle. A larger test set takes more passes over the documents, each of which keeps the hits only and frees its blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cut, as_bytes, pick, small

#: Edits allowed for each byte of an item, as far as pieces of ``WIDE`` bytes (``NARROW`` in short items) remain.
ERRORS = 0.06
WIDE, NARROW = 16, 8
BLOCK_BYTES, PASS_BYTES = 16 << 20, 64 << 20

_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def normalised(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def budget(size: int) -> int:
    """The edits that an item of so many bytes may differ by."""
    width = WIDE if size >= 2 * WIDE else NARROW
    return max(0, min(int(ERRORS * size), size // width - 1))


def pieces(item: bytes) -> list[tuple[int, bytes]]:
    """The k+1 pieces of a normalised item, with their offsets."""
    n = budget(len(item)) + 1
    cut = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:])]


def distance(pattern: bytes, text: bytes) -> int:
    """The least edit distance of the pattern to any part of the text (Myers 1999)."""
    m = len(pattern)
    if not m:
        return 0
    mask, top = (1 << m) - 1, 1 << (m - 1)
    equal: dict[int, int] = {}
    for i, c in enumerate(pattern):
        equal[c] = equal.get(c, 0) | 1 << i
    pv, mv, score, best = mask, 0, m, m
    for c in text:
        eq = equal.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & mask), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            best = min(best, score)
        ph, mh = ph << 1, mh << 1
        pv = (mh | ~(xv | ph)) & mask
        mv = ph & xv & mask
    return best


def _windows(raw: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` (8 or 16) bytes at each position."""
    n = len(raw) - 7
    at = np.empty(max(n, 0), np.uint64)
    for r in range(min(8, max(n, 0))):
        m = (len(raw) - r) // 8
        at[r::8] = raw[r : r + 8 * m].view("<u8")
    if width == 8:
        return at * _C1
    return at[:-8] * _C1 + at[8:] * _C2


@dataclass
class Probes:
    """The pieces of a block of items, found by hashes of their first bytes."""

    ids: list[int]
    items: list[bytes]

    def __post_init__(self):
        self.tables = []
        self.tiny = [i for i, x in enumerate(self.items) if 0 < len(x) < NARROW]  # they match as whole words
        for width in (WIDE, NARROW):
            found: dict[bytes, list[tuple[int, int, bytes]]] = {}
            for i, item in enumerate(self.items):
                if len(item) >= NARROW and (width == WIDE) == (len(item) >= 2 * WIDE):
                    for a, p in pieces(item):
                        found.setdefault(p[:width], []).append((i, a, p))
            if found:
                keys = _windows(np.frombuffer(b"".join(k.ljust(width + 8, b"\0") for k in found), np.uint8), width)[:: width + 8].copy()
                bits = max(20, (16 * len(keys)).bit_length())
                shift = np.uint64(64 - bits)
                seen = np.zeros(1 << bits, bool)
                seen[(keys >> shift).astype(np.int64)] = True
                self.tables.append((width, np.sort(keys), shift, seen, found))

    def matches(self, docs: list[bytes]) -> list[dict[int, int]]:
        """For each normalised document, the least distance of each item (by position in ``items``) within its budget."""
        out: list[dict[int, int]] = [{} for _ in docs]
        k = 0
        while k < len(docs):
            end, total = k, 0
            while end < len(docs) and (end == k or total + len(docs[end]) < 1 << 21):
                total += len(docs[end]) + 1
                end += 1
            self._part(docs[k:end], out[k:end])
            k = end
        return out

    def _part(self, docs: list[bytes], out: list[dict[int, int]]) -> None:
        whole = b"\0".join(docs) + b"\0" * WIDE
        raw = np.frombuffer(whole, np.uint8)
        size = np.array([len(d) + 1 for d in docs])
        first = np.cumsum(size) - size
        if self.tiny:
            own = {i: b" " + self.items[i] + b" " for i in self.tiny}
            for d, doc in enumerate(docs):
                padded = b" " + doc + b" "
                for i, item in own.items():
                    if item in padded:
                        out[d][i] = 0
        starts: dict[tuple[int, int], set[int]] = {}
        for width, keys, shift, seen, found in self.tables:
            h = _windows(raw, width)
            at = np.flatnonzero(seen[(h >> shift).astype(np.int64)])
            h = h[at]
            at = at[keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h]
            of = np.searchsorted(first, at, "right") - 1
            for p, d in zip(at.tolist(), of.tolist()):
                q = p - int(first[d])
                for i, a, piece in found.get(whole[p : p + width], ()):
                    if docs[d].startswith(piece, q):
                        starts.setdefault((d, i), set()).add(q - a)
        for (d, i), where in starts.items():
            item, doc = self.items[i], docs[d]
            best = k = budget(len(item)) + 1
            if any(s >= 0 and doc.startswith(item, s) for s in where):
                best = 0
            else:  # overlapping windows are verified as one
                begin = stop = -1
                for s in sorted(where):
                    a, b = max(0, s - k), s + len(item) + k
                    if a > stop:
                        if begin >= 0:
                            best = min(best, distance(item, doc[begin:stop]))
                        begin = a
                    stop = b
                best = min(best, distance(item, doc[begin:stop]))
            if best < k:
                out[d][i] = best


def passes(spark: SparkSession, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, pass_bytes: int = PASS_BYTES) -> Iterator[list]:
    """The test items as broadcast ``Probes``, a list of blocks for each pass. Items without an id, and without a word, are no items.

    A pass is made when it is asked for, so that only its blocks are held.
    """
    items = pick(benchmark, item_id="item_id", text="text").filter("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n, each = -(-total // block_bytes), max(1, pass_bytes // block_bytes)
    for first in range(0, n, each):
        made = []
        for k in range(first, min(n, first + each)):
            part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
            rows = [(r.item_id, normalised(r.text.encode())) for r in part.orderBy("item_id", "text").toLocalIterator()]
            rows = [(i, x) for i, x in rows if x]
            if rows:
                made.append(spark.sparkContext.broadcast(Probes([i for i, _ in rows], [x for _, x in rows])))
        if made:
            yield made


_HITS = ["doc_id", "h", "items", "best_distance"]


def _hits(docs: DataFrame, parts: list, every: bool) -> DataFrame:
    """(doc_id, h, items, best_distance) of ``docs`` (doc_id, h, text): the ids of the items found, sorted; with ``every`` also of rows without any."""
    key, item = docs.schema["doc_id"].dataType.simpleString(), type(parts[0].value.ids[0]) if parts else int
    kind = pa.string() if item is str else pa.int64()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [normalised(t) for t in as_bytes(batch.column(2))]
            hits: list[dict] = [{} for _ in texts]
            for part in parts:
                probes = part.value
                for all_, own in zip(hits, probes.matches(texts)):
                    for i, x in own.items():
                        name = probes.ids[i]
                        all_[name] = min(x, all_.get(name, x))
            columns = [*batch.columns[:2], pa.array([sorted(h) for h in hits], pa.list_(kind)), pa.array([min(h.values(), default=None) for h in hits], pa.int64())]
            made = pa.RecordBatch.from_arrays(columns, _HITS)
            yield made if every else made.filter(pa.array([bool(h) for h in hits], pa.bool_()))

    return docs.mapInArrow(each, f"doc_id {key}, h long, items array<{'string' if item is str else 'bigint'}>, best_distance long")


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(doc_id, items, n_items, best_distance, contaminated) of each row of ``docs`` (doc_id, text).

    items: the ids of the test items that occur within their budget, sorted and comma-joined, repeated ids once; empty
    if there are none, and best_distance is null then. A null text counts as empty and holds no item.
    """
    own = pick(docs, doc_id="doc_id", text="text").select("doc_id", F.xxhash64("text").alias("h"), "text")
    cut, found = Cut(spark), []
    for parts in passes(spark, benchmark, block_bytes, pass_bytes):
        if found:  # more than one pass: the hits of each are written, and its blocks freed
            before, held = found[-1]
            if held:
                found[-1] = (cut(_hits(own, held, False), "hits"), None)
                _free(held)
        found.append((None, parts))
    if len(found) > 1:
        last = found[-1][1]
        found[-1] = (cut(_hits(own, last, False), "hits"), None)
        _free(last)
        hits = found[0][0]
        for more, _ in found[1:]:
            hits = hits.unionByName(more)
        # repeated rows have the same hits
        hits = hits.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("g")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.min("best_distance").alias("best_distance"))
        rows = own.drop("text").join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    else:
        rows = _hits(own, found[0][1] if found else [], True)
    n = F.coalesce(F.size("items"), F.lit(0)).cast("long")
    n = F.when(F.col("items").isNull(), F.lit(0).cast("long")).otherwise(n)
    return rows.select("doc_id", F.coalesce(F.array_join(F.col("items").cast("array<string>"), ","), F.lit("")).alias("items"), n.alias("n_items"), "best_distance", (n > 0).alias("contaminated"))


def _free(parts: list) -> None:
    for part in parts:
        part.destroy()


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows that hold no test item, all columns unchanged."""
    k, cut, held = docs.columns.index("text"), Cut(spark), []

    def keep(left: DataFrame, parts: list) -> DataFrame:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small(batches):
                texts = [normalised(t) for t in as_bytes(batch.column(k))]
                clear = np.ones(len(texts), bool)
                for part in parts:
                    clear &= np.array([not h for h in part.value.matches(texts)], bool)
                yield batch.filter(pa.array(clear))

        return left.mapInArrow(each, docs.schema)

    left = docs
    for parts in passes(spark, benchmark, block_bytes, pass_bytes):
        if held:
            left = cut(keep(left, held), "clean")
            _free(held)
        held = parts
    return keep(left, held) if held else left
