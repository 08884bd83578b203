"""Local centers of a block: one task per (block, observer).

For each observer of a block the distance profile is modelled by a gamma
mixture, the points are classed by component, and the densest point of each
class that is large enough is a local center.  Observers are independent of
each other, so they run in parallel even within one block.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.blocks import large_blocks, local_op
from cairn.operators.density import densest
from cairn.operators.mixture import GammaMixture, classify, search_window, select_in_turn, select_in_window

RESULT = "m int, weight array<double>, shape array<double>, scale array<double>, loglik double, aicc double, center_idx int, component int, id bigint, center array<double>"
GROUP = ["block_id", "observer_id"]
#: Terms of a Hermite series over half a bandwidth: the next is below 1e-17.
TERMS = 24


def gauss_sums(t: np.ndarray, direct: int = 4096) -> np.ndarray:
    """The sum of exp(-(t_i - t_j)^2 / 2) over all j, for every i of ascending ``t``.

    Up to ``direct`` values by all pairs.  More of them are put in boxes of width
    1: a box of more than ``TERMS`` values is a Hermite series about its middle,
    whose rest is below rounding, and a value meets the boxes up to ten away
    (beyond, a term is below 1e-19).  The time grows with the number of values.
    """
    n = len(t)
    if n <= direct:
        f = np.empty(n)
        for lo in range(0, n, 512):
            z = t[lo : lo + 512, None] - t[None, :]
            f[lo : lo + 512] = np.exp(-0.5 * z * z).sum(1)
        return f
    box = np.floor(t).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], box[1:] != box[:-1]]))
    names, count = box[first], np.diff(np.append(first, n))
    x, moment = t - box - 0.5, np.empty((TERMS, len(names)))
    power = np.ones(n)
    for k in range(TERMS):
        moment[k] = np.add.reduceat(power, first)
        power = power * x / (k + 1)
    f = np.zeros(n)
    for away in range(-10, 11):
        at = np.searchsorted(names, box + away).clip(0, len(names) - 1)
        there = names[at] == box + away
        use = np.flatnonzero(there & (count[at] > TERMS))
        y, b = x[use] - away, at[use]
        total, before, now = np.zeros(len(use)), np.zeros(len(use)), np.ones(len(use))
        for k in range(TERMS):
            total += now * moment[k][b]
            before, now = now, y * now - k * before
        f[use] += np.exp(-0.5 * y * y) * total
        use = np.flatnonzero(there & (count[at] <= TERMS))
        for k in range(TERMS):
            use = use[count[at[use]] > k]
            if not len(use):
                break
            f[use] += np.exp(-0.5 * (t[use] - t[first[at[use]] + k]) ** 2)
    return f


def _first_guess(d: np.ndarray) -> int:
    """Peaks of the kernel density at the points, 1 at least (robust bandwidth)."""
    s = np.sort(d)
    n = len(s)
    spread = min(s.std(ddof=1), (np.percentile(s, 75) - np.percentile(s, 25)) / 1.34) if n > 1 else 0.0
    h = max(0.9 * spread * n**-0.2, 1e-5)
    f = gauss_sums(s / h)
    return max(1, int(((f[1:-1] > f[:-2]) & (f[1:-1] > f[2:])).sum())) if n > 2 else 1


def fit_profile(ids: np.ndarray, x: np.ndarray, d: np.ndarray, knn: int, selection: str = "window", delta: int = 5, gate: int | None = None, **how) -> tuple[GammaMixture, list[tuple[int, int]]]:
    """The mixture of one profile, and (component, position of its densest point).

    Labels belong to the points whose distances they class.  Components need
    more than ``gate`` points (default knn + 1; at least 2 in any case).
    """
    d = np.where(d == 0, 0.1, d)
    if len(d) < 3 or not np.isfinite(d).all() or (d < 0).any():
        raise ValueError("a profile needs three finite distances at least")
    if selection == "window":
        lo, hi = search_window(_first_guess(d), delta)
        finite = max(1, len(d) // 3 - 1)  # with more components AICc has no finite value
        g = select_in_window(d, min(lo, finite), min(hi, finite), **how)
    elif selection == "sequential":
        g = select_in_turn(d, **how)
    else:
        raise ValueError("selection must be window or sequential")
    label = classify(d, g)
    out = []
    for c in range(g.m):
        at = np.flatnonzero(label == c)
        if len(at) > max(knn + 1 if gate is None else gate, 1):
            out.append((c, int(at[densest(ids[at], x[at], knn)])))
    return g, out


def local_models(points: DataFrame, observers: DataFrame, knn: int = 5, selection: str = "window", delta: int = 5, gate: int | None = None, least_block: int = 2, **how) -> DataFrame:
    """One row per (block, observer, center): the mixture, and the center.

    A fit without any center has one row with null center columns; one that
    failed has null results and the reason in ``error``.  Blocks of fewer than
    ``least_block`` points give nothing.
    """
    if knn < 1:
        raise ValueError("knn must be positive")
    rows = large_blocks(points.select("block_id", "id", "v"), least_block).join(observers.select(*GROUP, "observer_v"), "block_id")

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(part["v"].to_numpy()).astype(float)
        ids = part["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        x, ids = x[order], ids[order]
        seen = np.asarray(part["observer_v"].iloc[0], float)
        if not np.isfinite(x).all() or x.shape[1] != len(seen):
            raise ValueError("points must be finite and of one length")
        d = np.sqrt(((x - seen) ** 2).sum(1))
        g, centers = fit_profile(ids, x, d, knn, selection, delta, gate, **how)
        model = {"m": g.m, "weight": g.weight.tolist(), "shape": g.shape.tolist(), "scale": g.scale.tolist(), "loglik": g.loglik, "aicc": g.aicc if math.isfinite(g.aicc) else None}
        found = [{**model, "center_idx": i, "component": c, "id": int(ids[p]), "center": x[p].tolist()} for i, (c, p) in enumerate(centers)]
        return pd.DataFrame(found or [{**model, "center_idx": None, "component": None, "id": None, "center": None}]).astype({"m": "Int32", "center_idx": "Int32", "component": "Int32", "id": "Int64"})

    return local_op(rows, GROUP, fit, RESULT)


def local_centers(models: DataFrame) -> DataFrame:
    """block_id, observer_id, center_idx, id, center of every center found."""
    return models.filter("error is null and center is not null").select(*GROUP, "center_idx", "id", "center")


def checked_points(points: DataFrame, n_observers: int, knn: int) -> DataFrame:
    """``points`` after the checks of the strict interface: raises if empty or if lengths differ."""
    if n_observers < 1 or knn < 1:
        raise ValueError("the numbers of observers and neighbours must be positive")
    sizes = points.agg(F.min(F.size("v")).alias("a"), F.max(F.size("v")).alias("b"), F.count_if(F.col("v").isNull()).alias("n")).first()
    if sizes["a"] is None or sizes["n"]:
        raise ValueError("there are no points, or a null one")
    if sizes["a"] != sizes["b"]:
        raise ValueError("points differ in length")
    return points


def best_observer(models: DataFrame) -> DataFrame:
    """The centers of each block's observer with most centers, the first one at a tie."""
    centers = local_centers(models)
    count = centers.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"))
    best = count.groupBy("block_id").agg(F.max_by("observer_id", F.struct("n", -F.col("observer_id"))).alias("observer_id"))
    return centers.join(best, GROUP, "left_semi")


def two_layer_check(labelled: DataFrame, knn: int = 5, seed: int = 0, **how) -> DataFrame:
    """label, n_centers of the clusters that one observer splits in more than one.

    ``labelled`` has id, v and label; each cluster is a block of its own, so all
    are checked in parallel.
    """
    from cairn.operators.blocks import sample_observers

    blocks = labelled.select(F.col("label").cast("int").alias("block_id"), "id", "v")
    models = local_models(blocks, sample_observers(blocks, 1, seed), knn, selection="sequential", **how)
    return local_centers(models).groupBy(F.col("block_id").alias("label")).agg(F.count(F.lit(1)).alias("n_centers")).filter("n_centers > 1")
