"""Nearest-neighbour density, and the densest point of each component."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: More points than ``MANY`` of at most ``FLAT`` dimensions are cut into cells of ``LEAF`` points.
MANY, FLAT, LEAF = 4096, 12, 64


def knn_distances(x: np.ndarray, k: int) -> np.ndarray:
    """Distances of each row to its k nearest others, ascending; k is clipped to n - 1."""
    n = len(x)
    if n <= 1:
        raise ValueError("neighbours need two points at least")
    k = min(k, n - 1)
    out = np.empty((n, k))
    square = (x * x).sum(1)
    for lo in range(0, n, 512):  # slices, so that memory grows with n, not n squared
        d = square[lo : lo + 512, None] + square[None, :] - 2 * x[lo : lo + 512] @ x.T
        d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
        near = np.argpartition(d, k - 1, 1)[:, :k]
        exact = np.sqrt(((x[lo : lo + 512, None, :] - x[near]) ** 2).sum(2))
        out[lo : lo + 512] = np.sort(exact, 1)
    return out


def leaves(x: np.ndarray, most: int = LEAF) -> list[np.ndarray]:
    """The positions of the rows, in cells of ``most`` at most: halved along the widest dimension until they are small enough."""
    out, open_cells = [], [np.arange(len(x))]
    while open_cells:
        at = open_cells.pop()
        if len(at) <= most:
            out.append(at)
            continue
        part = x[at]
        order = np.argpartition(part[:, int((part.max(0) - part.min(0)).argmax())], len(at) // 2)
        open_cells += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
    return out


def _differences(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows, summed over the dimensions in turn."""
    out = (x[:, None, 0] - y[None, :, 0]) ** 2
    for j in range(1, x.shape[1]):
        out += (x[:, None, j] - y[None, :, j]) ** 2
    return out


def _densest_in_cells(ids: np.ndarray, x: np.ndarray, k: int) -> int:
    """``densest`` for few dimensions: neighbours are looked for only where they can lie.

    The neighbours within a point's own cell bound its mean from above; the
    least such bound, u, bounds the result.  A point with a mean up to u has its
    k nearest within k u, so a cell is compared with those cells alone whose
    boxes are so near.  Every point is examined, and no distance is estimated.
    Of equal rows only the k + 1 with the least ids can matter: all of them have
    a mean of 0, and no point has more of them among its neighbours.
    """
    order = np.lexsort((ids, *x.T))
    first = np.flatnonzero(np.concatenate([[True], (x[order[1:]] != x[order[:-1]]).any(1)]))
    place = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
    kept = order[place <= k]
    ids, x = ids[kept], x[kept]
    if len(x) <= MANY:
        return int(kept[np.lexsort((ids, np.round(knn_distances(x, k).mean(1), 12)))[0]])
    cells = leaves(x)
    low, high = np.array([x[c].min(0) for c in cells]), np.array([x[c].max(0) for c in cells])
    bound = np.inf
    for c in cells:
        d = _differences(x[c], x[c])
        np.fill_diagonal(d, np.inf)
        bound = min(bound, np.sqrt(np.partition(d, k - 1, 1)[:, :k]).mean(1).min())
    best = (np.inf, None, -1)
    for i, c in enumerate(cells):
        reach = k * (bound + 1e-11) * (1 + 1e-9)  # means equal to 12 places tie
        gap = np.maximum(0, np.maximum(low - high[i], low[i] - high))
        near = np.concatenate([cells[j] for j in np.flatnonzero((gap * gap).sum(1) <= reach * reach)])
        y = x[near]
        away = np.maximum(0, np.maximum(low[i] - y, y - high[i]))
        near = near[(away * away).sum(1) <= reach * reach]
        if len(near) <= k:
            continue
        d = _differences(x[c], x[near])
        d[c[:, None] == near[None, :]] = np.inf
        use = np.flatnonzero((d <= reach * reach).sum(1) >= k)
        if not len(use):
            continue
        who, nearest = c[use], near[np.argpartition(d[use], k - 1, 1)[:, :k]]
        mean = np.sort(np.sqrt(((x[who][:, None, :] - x[nearest]) ** 2).sum(2)), 1).mean(1)
        first = np.lexsort((ids[who], np.round(mean, 12)))[0]
        best = min(best, (float(np.round(mean[first], 12)), ids[who[first]], int(who[first])))
        bound = min(bound, float(mean.min()))
    return int(kept[best[2]])


def densest(ids: np.ndarray, x: np.ndarray, k: int) -> int:
    """Position of the point with the least mean distance to its neighbours, the smallest id at a tie."""
    if len(x) > MANY and x.shape[1] <= FLAT and k < LEAF // 4:
        return _densest_in_cells(ids, x, k)
    mean = knn_distances(x, k).mean(1)
    return int(np.lexsort((ids, np.round(mean, 12)))[0])


def neighbour_density(points: DataFrame, by: list[str], k: int) -> DataFrame:
    """by, id, mean_dist, density (1 / mean_dist; infinite at 0) within each group; groups of one point are left out.

    A group is a component of a block, whose size is bounded.
    """
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    shape = ", ".join(f"{c} {kinds[c]}" for c in (*by, "id")) + ", mean_dist double, density double"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) < 2:
            return pd.DataFrame({c: [] for c in (*by, "id", "mean_dist", "density")})
        mean = knn_distances(np.stack(rows["v"].to_numpy()), k).mean(1)
        with np.errstate(divide="ignore"):
            return rows[[*by, "id"]].assign(mean_dist=mean, density=1 / mean)

    return points.select(*by, "id", "v").groupBy(*by).applyInPandas(run, shape)


def large_components(points: DataFrame, by: list[str], k: int) -> DataFrame:
    """The points of the groups with more than k + 1 points."""
    return points.join(points.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > k + 1).select(*by), by, "left_semi")


def component_centers(points: DataFrame, by: list[str], k: int) -> DataFrame:
    """by, id: the densest point of each group with more than k + 1 points."""
    d = neighbour_density(large_components(points, by, k), by, k)
    return d.groupBy(*by).agg(F.min_by("id", F.struct(F.round("mean_dist", 12).alias("d"), "id")).alias("id"))
