"""Per-point analytics within a cloud: density, clusters and normals.

A cloud is one task's work, in blocks of rows. Neighbours are looked for in boxes of some hundred points, the nearest boxes first, so a
cloud of n points takes about n times the points of a few boxes, and not n times n.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

_BLOCK = 512
#: Points of a box at most, boxes that are looked at together, and points up to which a cloud needs no boxes.
_LEAF, _BOXES, _SMALL = 128, 24, 2048


def _boxes(p: np.ndarray) -> list[np.ndarray]:
    """The places of the points, cut in halves along the widest axis until there are few in each."""
    made, rest = [], [np.arange(len(p))]
    while rest:
        own = rest.pop()
        if len(own) <= _LEAF:
            made.append(own)
            continue
        q = p[own]
        half = np.argpartition(q[:, np.ptp(q, axis=0).argmax()], len(own) // 2)
        rest += [own[half[: len(own) // 2]], own[half[len(own) // 2 :]]]
    return made


def _nearest(p: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and places of the k nearest other points of each point, the nearest first.

    The points of a box are compared with those of other boxes in the order of the boxes' distances, until a box is as far as the
    farthest of the neighbours that were found: the result is that of comparing all.
    """
    if len(p) <= _SMALL or not np.isfinite(p).all():
        return _nearest_of_all(p, k)
    boxes = _boxes(p)
    low, high = (np.array([f(p[b], axis=0) for b in boxes]) for f in (np.min, np.max))
    far, where = np.empty((len(p), k)), np.empty((len(p), k), int)
    for i, own in enumerate(boxes):
        q = p[own]
        gap = np.maximum(0.0, np.maximum(low - high[i], low[i] - high))
        gap = gap[:, 0] * gap[:, 0] + gap[:, 1] * gap[:, 1] + gap[:, 2] * gap[:, 2]
        gap[i] = -1.0
        order = np.argsort(gap, kind="stable")
        best, at = np.full((len(own), k), np.inf), np.zeros((len(own), k), int)
        for a in range(0, len(order), _BOXES):
            if gap[order[a]] >= best.max():
                break
            these = np.concatenate([boxes[j] for j in order[a : a + _BOXES] if gap[j] < best.max()])
            x, y, z = (q[:, None, c] - p[None, these, c] for c in range(3))
            d = x * x + y * y + z * z
            if not a:
                d[np.arange(len(own)), np.arange(len(own))] = np.inf  # the box itself comes first
            d, ids = np.concatenate([best, d], 1), np.concatenate([at, np.broadcast_to(these, d.shape)], 1)
            least = np.argpartition(d, k - 1, axis=1)[:, :k]
            best, at = np.take_along_axis(d, least, 1), np.take_along_axis(ids, least, 1)
        by = np.lexsort((at, best), axis=1)
        far[own], where[own] = np.sqrt(np.take_along_axis(best, by, 1)), np.take_along_axis(at, by, 1)
    return far, where


def _nearest_of_all(p: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The same by comparing all points, a block at a time."""
    far, where = np.empty((len(p), k)), np.empty((len(p), k), int)
    for a in range(0, len(p), _BLOCK):
        d = np.sqrt(((p[a : a + _BLOCK, None, :] - p[None, :, :]) ** 2).sum(2))
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        at = np.argsort(d, axis=1, kind="stable")[:, :k]
        far[a : a + _BLOCK], where[a : a + _BLOCK] = np.take_along_axis(d, at, 1), at
    return far, where


def density(points: DataFrame) -> DataFrame:
    """(cloud_id, pt, density): one over the mean distance to the 10 nearest others, scaled to [0, 1]; 0.5 in clouds of under 10 points."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pt", kind="stable")  # neighbours at one distance go by place
        n = len(g)
        v = np.full(n, 0.5)
        if n >= 10:
            raw = 1 / (_nearest(g[["x", "y", "z"]].to_numpy(float), min(10, n - 1))[0].mean(1) + 1e-8)
            v = (raw - raw.min()) / (raw.max() - raw.min()) if raw.max() > raw.min() else np.zeros(n)
        return pd.DataFrame({"cloud_id": g["cloud_id"], "pt": g["pt"], "density": v})

    return points.groupBy("cloud_id").applyInPandas(one, "cloud_id long, pt long, density double")


def clusters(points: DataFrame, seed: int = 42) -> DataFrame:
    """(cloud_id, pt, cluster): k-means with k of 2 to 8, one for 200 points; -1 in clouds of fewer points than k."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pt", kind="stable")  # trials draw points by place
        p, n = g[["x", "y", "z"]].to_numpy(float), len(g)
        k = min(8, max(2, n // 200))
        label = np.full(n, -1)
        if n >= k:
            best = np.inf
            for trial in range(10):
                rng = np.random.default_rng(seed + trial)
                c = p[[rng.integers(n)]]
                while len(c) < k:
                    d = ((p[:, None] - c[None]) ** 2).sum(2).min(1)
                    c = np.vstack([c, p[rng.choice(n, p=d / d.sum()) if d.sum() > 0 else rng.integers(n)]])
                for _ in range(100):
                    own = ((p[:, None] - c[None]) ** 2).sum(2).argmin(1)
                    moved = np.stack([p[own == i].mean(0) if (own == i).any() else c[i] for i in range(k)])
                    if np.allclose(moved, c):
                        break
                    c = moved
                cost = ((p - c[own]) ** 2).sum()
                if cost < best - 1e-12:
                    best, label = cost, own
        return pd.DataFrame({"cloud_id": g["cloud_id"], "pt": g["pt"], "cluster": label.astype(np.int32)})

    return points.groupBy("cloud_id").applyInPandas(one, "cloud_id long, pt long, cluster int")


def normals(points: DataFrame, radius: float = 0.1, most: int = 30) -> DataFrame:
    """(cloud_id, pt, nx, ny, nz): the direction of least spread of a point and its neighbours; (0, 0, 1) with fewer than 3 points."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pt", kind="stable")
        p, n = g[["x", "y", "z"]].to_numpy(float), len(g)
        v = np.tile([0.0, 0.0, 1.0], (n, 1))
        if n > 1:
            far, where = _nearest(p, min(most - 1, n - 1))
            for a in range(0, n, _BLOCK):
                near = np.concatenate([p[a : a + _BLOCK, None, :], p[where[a : a + _BLOCK]]], 1)
                own = np.concatenate([np.ones((len(near), 1)), far[a : a + _BLOCK] <= radius], 1)[:, :, None]
                size = own.sum(1)
                away = (near - (near * own).sum(1, keepdims=True) / size[:, None]) * own
                v[a : a + _BLOCK] = np.where(size >= 3, np.linalg.eigh(away.transpose(0, 2, 1) @ away)[1][:, :, 0], v[a : a + _BLOCK])
        return pd.DataFrame({"cloud_id": g["cloud_id"], "pt": g["pt"], "nx": v[:, 0], "ny": v[:, 1], "nz": v[:, 2]})

    return points.groupBy("cloud_id").applyInPandas(one, "cloud_id long, pt long, nx double, ny double, nz double")
