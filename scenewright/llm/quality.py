"""Quality classifier: Bradley-Terry pairwise ranking of documents.

A document's latent score is a linear function of its features; the chance that a document of label 1 is
preferred to one of label 0 is the logistic function of the difference of their scores. The weights minimise
that logistic loss over preference pairs of a bounded sample. The score quantile at the share of label 0, over all labelled documents,
separates the two.

The features are shares of character classes, of pairs of adjacent classes and of single punctuation marks over
the whole text, so a document is scored in one scan without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cut, buffers, pick, small

#: Labelled documents of each class that are used for learning, at most; which ones, a hash of the id decides.
SAMPLE = 3000
#: Preference pairs for each document of the smaller class.
PAIRS = 24
#: Steps between the least and the greatest score of labelled documents in which the threshold is found.
STEPS = 1 << 16
#: A document is accepted from this calibrated score on; the quantile of the latent scores is mapped to it.
ACCEPT = 0.7

_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CLASSES = 8


def _class_table() -> np.ndarray:
    t = np.full(256, 7, np.uint8)  # control characters
    t[0x61:0x7B], t[0x41:0x5B], t[0x30:0x3A] = 0, 1, 2
    t[0x20], t[0x0A] = 3, 4
    t[list(_MARKS)] = 5
    t[0x80:] = 6
    return t


_TABLE = _class_table()
N_FEATURES = _CLASSES + _CLASSES**2 + len(_MARKS) + 6
_STEP = 1 << 21


def features(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of features for each text; an empty text has zeros."""
    n = len(at) - 1
    one, two, marks = np.zeros((n, _CLASSES)), np.zeros((n, _CLASSES**2)), np.zeros((n, 256))
    again = np.zeros((n, 3))
    row = 0
    while row < n:  # whole texts of about 2 MB together, a longer one alone
        end = max(row + 1, int(np.searchsorted(at, at[row] + _STEP, "right")) - 1)
        part = raw[at[row] : at[end]]
        own = np.repeat(np.arange(end - row, dtype=np.int32), np.diff(at[row : end + 1]))
        kind = _TABLE[part]
        one[row:end] = np.bincount(own * _CLASSES + kind, minlength=(end - row) * _CLASSES).reshape(-1, _CLASSES)
        if len(part) > 1:
            same = own[1:] == own[:-1]
            pair = own[1:] * _CLASSES**2 + kind[:-1].astype(np.int32) * _CLASSES + kind[1:]
            two[row:end] = np.bincount(pair[same], minlength=(end - row) * _CLASSES**2).reshape(-1, _CLASSES**2)
        odd = kind == 5
        marks[row:end] = np.bincount(own[odd] * 256 + part[odd], minlength=(end - row) * 256).reshape(-1, 256)
        row = end
    size = np.diff(at).astype(float)
    safe = np.maximum(size, 1)[:, None]
    words = two[:, [3 * _CLASSES, 3 * _CLASSES + 1, 3 * _CLASSES + 2, 3 * _CLASSES + 6]].sum(1) + 1
    extra = np.stack([np.log1p(size), size / words / 10 * (size > 0), np.log1p(size / (one[:, 4] + 1))], 1)
    whole, ends = raw.tobytes(), at.tolist()
    for i in range(n):  # words said twice running, and distinct words
        w = whole[ends[i] : ends[i + 1]].split()
        if len(w) > 1:
            again[i] = sum(map(eq, w, w[1:])) / (len(w) - 1), len(set(w)) / len(w), 0
            again[i, 2] = np.sqrt(again[i, 0])
        else:
            again[i, 1] = len(w)
    return np.hstack([again, np.sqrt(one / safe), np.sqrt(two / safe), np.sqrt(marks[:, list(_MARKS)] / safe), extra])


@dataclass(frozen=True)
class Ranking:
    """Weights, and the calibration that puts the quantile threshold at ``ACCEPT``."""

    weights: tuple[float, ...]
    threshold: float
    scale: float
    learned: bool

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.learned:
            return np.full(len(x), 0.5)
        z = self.scale * (x @ np.array(self.weights) - self.threshold) + np.log(ACCEPT / (1 - ACCEPT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_ranking(x: np.ndarray, label: np.ndarray, ridge: float = 1e-3, seed: int = 17) -> Ranking:
    """Bradley-Terry weights of labelled feature rows. With one class only, nothing is learned: every score is 0.5. The threshold is the rows' own."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return Ranking((0.0,) * x.shape[1], 0.0, 1.0, False)
    spread = x.std(0)
    unit = np.where(spread > 1e-9, 1 / np.maximum(spread, 1e-9), 0.0)
    rng = np.random.default_rng(seed)
    times = PAIRS * min(len(good), len(bad))
    times = max(times, len(good), len(bad))
    a = np.concatenate([good, rng.choice(good, times)])[:times]
    b = np.concatenate([bad, rng.choice(bad, times)])[:times]
    d = (x[a] - x[rng.permutation(b)]) * unit
    w = np.zeros(x.shape[1])
    for _ in range(25):  # Newton's method; the loss is convex
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        grad = ridge * w - d.T @ p / len(d)
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    w = w * unit
    s = np.sort(x @ w)
    k = min(len(bad), len(s) - 1)
    gap = float(np.median(x[good] @ w) - np.median(x[bad] @ w))
    return Ranking(tuple(w.tolist()), float(s[k - 1] + s[k]) / 2, 8 / max(gap, 1e-9), True)


def quantile(scores: DataFrame, share: float) -> float:
    """The value below which this share of ``scores`` (z) lies, to one of ``STEPS`` steps of their range: only counts by step reach the driver."""
    low, high, n = scores.agg(F.min("z"), F.max("z"), F.count("z")).first()
    if not n or low == high:
        return low or 0.0
    width = (high - low) / STEPS
    step = F.least(F.floor((F.col("z") - low) / width), F.lit(STEPS - 1)).cast("int")
    counts = np.zeros(STEPS, np.int64)
    got = scores.groupBy(step.alias("step")).count().toArrow()
    counts[got.column(0).to_numpy()] = got.column(1).to_numpy()
    below = np.cumsum(counts)
    k = int(np.searchsorted(below, share * n))
    filled = np.flatnonzero(counts[k + 1 :])
    following = k + 1 + int(filled[0]) if len(filled) else k + 1
    return low + width * (k + 1 + following) / 2  # midway to the next score


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ranking:
    """Learn from ``labels`` (doc_id, quality) of ``docs`` (doc_id, text).

    The weights come from at most ``sample`` labelled rows of each class, the first by a hash of the id, one document for each id: what reaches the
    driver, their features, is bounded. The threshold is the quantile of the scores of all documents with labels at the share of label 0. Null labels
    or ids, and labels other than 0 and 1, don't count; labels of no document don't either. No usable label of either class: nothing is learned.
    """
    usable = pick(labels, l_id="doc_id", quality="quality").filter("l_id is not null and quality in (0, 1)").select("l_id", F.col("quality").cast("int").alias("quality"))
    one = lambda q: usable.filter(F.col("quality") == q).orderBy(F.xxhash64("l_id"), "l_id").limit(sample)
    chosen = one(0).unionByName(one(1)).distinct()
    own = pick(docs, doc_id="doc_id", text="text")
    rows = own.join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))
    rows = rows.groupBy("l_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            if batch.num_rows:
                x = features(*buffers(batch.column(0)))
                yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["l_id", "quality", "x"])

    rows = rows.select("text", "quality", F.col("l_id").cast("string").alias("l_id"))
    got = rows.mapInArrow(each, "l_id string, quality int, x array<double>").toArrow().to_pandas()
    if not len(got):
        return fit_ranking(np.zeros((0, N_FEATURES)), np.zeros(0))
    got = got.sort_values(["l_id", "quality"], kind="stable")
    made = fit_ranking(np.stack(got["x"].to_numpy()), got["quality"].to_numpy())
    if not made.learned:
        return made
    weights = np.array(made.weights)

    def latent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(features(*buffers(batch.column(1))) @ weights)], ["doc_id", "z"])

    # every document is scored where it lies; ids, scores and labels meet, texts never move
    every, key = Cut(docs.sparkSession), own.schema["doc_id"].dataType.simpleString()
    scored = own.mapInArrow(latent, f"doc_id {key}, z double").join(usable, F.col("doc_id") == F.col("l_id"))
    scored = every(scored.select("z", "quality"), "latent")
    bad, n = scored.agg(F.count_if(F.col("quality") == 0), F.count("*")).first()
    threshold = quantile(scored, bad / n)
    every.free(scored)
    return replace(made, threshold=threshold)


def score(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """(doc_id, score) of every row, in one scan. A null text counts as empty; an empty text has the score of zero features."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            s = ranking.score(features(*buffers(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], ["doc_id", "score"])

    picked = pick(docs, doc_id="doc_id", text="text")
    return picked.mapInArrow(each, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, score double")


def accept(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """The rows that the ranking accepts, all columns unchanged; every row if nothing was learned."""
    if not ranking.learned:
        return docs
    k = docs.columns.index("text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield batch.filter(pa.array(ranking.score(features(*buffers(batch.column(k)))) >= ACCEPT))

    return docs.mapInArrow(each, docs.schema)


def held_out(doc_id) -> F.Column:
    """True for the rows whose labels are never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))
