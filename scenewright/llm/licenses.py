"""Licence scans: fixed phrases, and ordered signature rules gated by keywords.

A text becomes its words (ASCII letters lower-cased, everything else in ASCII a break). A rule is tried only where its
keyword is present, and matches whole words. Detections are taken in rule order, and one whose interval lies inside that of an earlier
rule's, or shares a part with it, is suppressed: "CC BY-NC 4.0" is that licence and not also CC BY-NC. What is kept never overlaps, so a text's
hits are resolved by binary search. Rows are independent: a scan has no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, pick, small
from .license_rules import Rule, rules

#: The fixed phrases and their labels.
PHRASES = {b"gnu general public license": "gpl", b"apache license": "apache", b"cc by": "cc-by", b"mit license": "mit"}

_TABLE = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_LABEL_RULES: list[Rule] = rules()
_GATES = sorted({r.gate for r in _LABEL_RULES} | set(PHRASES))


@lru_cache(maxsize=1)
def _keywords() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for gate in _GATES:
        made.add_word(gate.decode(), gate)
    made.make_automaton()
    return made


def gates(line: bytes) -> set[bytes]:
    """The keywords in normalised words, all found in one pass."""
    return {gate for _, gate in _keywords().iter(line.decode("latin-1"))}


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def detections(line: bytes, present: set[bytes]) -> list[tuple[int, int, str]]:
    """(start, end, label), by start, of the rules' matches in normalised words that overlap no earlier rule's detection."""
    start, end, of = (np.zeros(0, np.int64) for _ in range(3))
    for rule in _LABEL_RULES:
        if rule.gate in present:
            hits = np.array([m.span() for m in rule.pattern.finditer(line)], np.int64).reshape(-1, 2)
            if not len(hits):
                continue
            before = np.searchsorted(start, hits[:, 1]) - 1  # the last kept one that starts before a hit's end
            free = hits[(before < 0) | (end[before] <= hits[:, 0])] if len(start) else hits
            at = np.searchsorted(start, free[:, 0])
            start, end, of = np.insert(start, at, free[:, 0]), np.insert(end, at, free[:, 1]), np.insert(of, at, rule.order)
    return [(a, b, _LABEL_RULES[r].label) for a, b, r in zip(start.tolist(), end.tolist(), of.tolist())]


def scan(text: bytes) -> tuple[int, int, int | None, int | None, list[str], list[str], float]:
    """Words, places of fixed phrases, their least and greatest start, base labels, all labels, score."""
    found = words(text)
    line = b" ".join(found)
    present = gates(line)
    if not present:
        return len(found), 0, None, None, [], [], 0.0
    padded = b" " + line + b" "
    places: list[int] = []
    base = set()
    for phrase, label in PHRASES.items():
        at = padded.find(b" " + phrase + b" ")
        if at >= 0:
            base.add(label)
        while at >= 0:
            places.append(at)
            at = padded.find(b" " + phrase + b" ", at + 1)
    starts = np.searchsorted(np.flatnonzero(np.frombuffer(padded, np.uint8) == 0x20), places) if places else np.zeros(0, np.int64)
    rule_hits = detections(line, present)
    labels = base | {label for _, _, label in rule_hits}
    # certainty: how many words the detections name, one by one; weak notices count half
    sure = sum((0.5 if label in ("no-warranty", "proprietary", "other-license") else 1) * (line.count(b" ", a, b) + 1) for a, b, label in rule_hits) + len(places)
    first, last = (int(starts.min()), int(starts.max())) if places else (None, None)
    return len(found), len(places), first, last, sorted(base), sorted(labels), 1 - 0.7**sure


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text). Null counts as empty: no words, no labels (empty strings), score 0."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = [scan(t) for t in as_bytes(batch.column(1))]
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64()]
            values = [[",".join(v) if isinstance(v := r[k], list) else v for r in rows] for k in range(7)]
            made = [pa.array(v, t) for v, t in zip(values, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))])

    picked = pick(docs, doc_id="doc_id", text="text")
    return picked.mapInArrow(each, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")
