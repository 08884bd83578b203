"""k-means from given centers: one pass per round, k rows to the driver."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Centers are sent to every task; more than this many numbers are refused.
MOST_NUMBERS = 20_000_000


def center_matrix(centers: DataFrame, column: str = "center", order: list[str] | None = None) -> np.ndarray:
    """The centers as rows, in ``order``; their size is checked before they are collected."""
    rows = centers.filter(F.col(column).isNotNull())
    size = rows.agg(F.coalesce(F.sum(F.size(column)), F.lit(0)).alias("n"), F.min(F.size(column)).alias("a"), F.max(F.size(column)).alias("b")).first()
    if size["n"] > MOST_NUMBERS:
        raise ValueError("too many centers to send to every task")
    if size["a"] != size["b"]:
        raise ValueError("centers differ in length")
    return np.array([r[column] for r in (rows.orderBy(*order) if order else rows).collect()], float)


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of the nearest center (the first at a tie) and squared distance, slice by slice."""
    label, best = np.empty(len(x), np.int32), np.empty(len(x))
    step = max(1, 4_000_000 // max(1, c.size))
    for lo in range(0, len(x), step):
        d = ((x[lo : lo + step, None, :] - c[None, :, :]) ** 2).sum(2)
        label[lo : lo + step] = d.argmin(1)
        best[lo : lo + step] = d.min(1)
    return label, best


def _points(column: pa.Array) -> np.ndarray:
    n = len(column)
    return np.asarray(column.flatten(), float).reshape(n, -1) if n else np.empty((0, 0))


def assign_centers(points: DataFrame, centers: np.ndarray) -> DataFrame:
    """id, label, dist2 of every point: its nearest center, the first at a tie."""
    if not len(centers):
        raise ValueError("there are no centers")
    shared = points.sparkSession.sparkContext.broadcast(centers)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, best = _nearest(_points(b.column(1)), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(label), pa.array(best)], names=["id", "label", "dist2"])

    return points.select("id", "v").mapInArrow(run, f"id {points.schema['id'].dataType.simpleString()}, label int, dist2 double")


def _round(points: DataFrame, centers: np.ndarray) -> list:
    """label, n, total (sum of the points), cost of each center: summed in every task first."""
    shared = points.sparkSession.sparkContext.broadcast(centers)
    dim = centers.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, cost = np.zeros(len(shared.value), np.int64), np.zeros(shared.value.shape), np.zeros(len(shared.value))
        for b in batches:
            x = _points(b.column(0))
            label, best = _nearest(x, shared.value)
            n += np.bincount(label, minlength=len(n))
            np.add.at(total, label, x)
            cost += np.bincount(label, best, len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array(list(total[at]), pa.list_(pa.float64())), pa.array(cost[at])], names=["label", "n", "total", "cost"])

    part = points.select("v").mapInArrow(run, "label int, n bigint, total array<double>, cost double")
    sums = part.groupBy("label").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("total", F.lit(i))) for i in range(dim))).alias("total"), F.sum("cost").alias("cost"))
    return sums.collect()


def lloyd(points: DataFrame, centers: np.ndarray, rounds: int = 100, tolerance: float = 0.0) -> tuple[np.ndarray, int]:
    """(centers, rounds run): Lloyd's rounds until no center moves by more than ``tolerance``.

    A center without points stays where it is.  Unmoved centers give unchanged
    labels, so this is also the rule "until no label changes".
    """
    c = np.array(centers, float)
    for turn in range(rounds):
        new = c.copy()
        for r in _round(points, c):
            new[r["label"]] = np.array(r["total"]) / r["n"]
        moved = float(np.abs(new - c).max(initial=0.0))
        c = new
        if moved <= tolerance:
            return c, turn + 1
    return c, rounds


def cost(points: DataFrame, centers: np.ndarray) -> float:
    """The sum of squared distances to the nearest centers."""
    return float(sum(r["cost"] for r in _round(points, centers)))


def library_kmeans(points: DataFrame, centers: np.ndarray, rounds: int = 100, seed: int = 42, epsilon: float = 1e-4) -> np.ndarray:
    """The same by MLlib's trainer with an initial model (its bridge needs an RDD of vectors)."""
    from pyspark.mllib.clustering import KMeans, KMeansModel
    from pyspark.mllib.linalg import Vectors

    rows = points.select("v").rdd.map(lambda r: Vectors.dense(r[0])).cache()
    try:
        model = KMeans.train(rows, len(centers), maxIterations=rounds, seed=seed, epsilon=epsilon, initialModel=KMeansModel([Vectors.dense(c) for c in centers]))
        return np.array([list(c) for c in model.clusterCenters])
    finally:
        rows.unpersist()


def cluster_counts(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
