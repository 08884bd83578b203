"""From local centers to global ones.

Centers are few by construction (observers x components x blocks) and carry an
explicit position ``pos``, since consolidation by order depends on it.  Pairs are
measured in NumPy, every partition of centers against *chunks* of all centers
that go to every task one after the other (``CHUNK`` numbers at most), so any
number of centers can be handled; what only needs a sum, a count or a minimum
per center never gives out pairs.  The greedy pass reads the centers in their
order and keeps only those that stay: j goes if a kept i < j is nearer than the
threshold, distances being those of the original coordinates.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.runtime import durable, numbered, release

#: Numbers of a chunk of centers: 80 MB.
CHUNK = 10_000_000
#: Spectral grouping holds the square of this many numbers (0.8 GB) in one task; more centers are refused.
MOST_SPECTRAL = 10_000
#: Up to so many centers, all eigenvectors are computed at once (five square arrays).
DENSE = 1_000
#: Rows of a part of the sorted distances.
PART = 100_000


def with_position(centers: DataFrame, order: list[str]) -> DataFrame:
    """``centers`` with ``pos`` from 0 in ``order`` (range partitions, no task holds all)."""
    return numbered(centers, order, "pos")


def _chunks(centers: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, centers) of all centers, a bounded part at a time."""
    size = centers.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("center")).alias("d")).first()
    parts = max(1, math.ceil(size["n"] * (size["d"] or 1) / CHUNK))
    for k in range(parts):
        rows = (centers if parts == 1 else centers.filter(F.col("pos") % parts == k)).select("pos", "center").toArrow()
        pos = np.asarray(rows.column("pos")).astype(np.int64)
        order = np.argsort(pos)
        x = np.asarray(rows.column("center").combine_chunks().flatten(), float).reshape(len(pos), size["d"] or 0)
        yield pos[order], x[order]


def against_all(centers: DataFrame, measure: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]], schema: str, extra: str = "pos") -> DataFrame:
    """What ``measure`` makes of (pos, extra, center) of some centers and (pos, center) of a chunk of all, for every chunk.

    ``extra`` is a numeric column that goes along.  The squared distances that
    ``squared`` gives are those of the differences, not of dot products.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    out = None
    for chunk in _chunks(centers):
        shared = centers.sparkSession.sparkContext.broadcast(chunk)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            pos, all_centers = shared.value
            for batch in batches:
                for lo in range(0, batch.num_rows, 64):
                    part = batch.slice(lo, 64)
                    x = np.asarray(part.column(2).flatten(), float).reshape(part.num_rows, -1)
                    for at in range(0, len(pos), 1024):
                        found = measure(np.asarray(part.column(0)), np.asarray(part.column(1)), x, pos[at : at + 1024], all_centers[at : at + 1024])
                        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in found], names=names)

        got = centers.select("pos", F.col(extra).alias("__extra"), "center").mapInArrow(run, schema)
        out = got if out is None else out.unionByName(got)
    return out


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - y[None, :, :]) ** 2).sum(2)


def center_distances(centers: DataFrame, below: float | None = None) -> DataFrame:
    """i < j, d of the pairs of ``centers`` (pos, center), those with d < ``below`` if it is given."""

    def pairs(pos, _, x, other, y):
        d = np.sqrt(squared(x, y))
        a, b = np.nonzero((pos[:, None] < other[None, :]) & ((d < below) if below is not None else True))
        return [pos[a].astype(np.int32), other[b].astype(np.int32), d[a, b]]

    return against_all(centers, pairs, "i int, j int, d double")


def merge_threshold(centers: DataFrame, percentage: float) -> float | None:
    """The mean of the smallest max(1, trunc(P p)) of the P pair distances; None for fewer than two centers.

    A lower percentage gives a lower threshold, which merges less.
    """
    if not 0 <= percentage <= 1:
        raise ValueError("the percentage must lie between 0 and 1")
    return threshold_table(centers, percentage).first()["threshold"]


def threshold_table(centers: DataFrame, percentage: float) -> DataFrame:
    """``merge_threshold`` as one row (n_pairs, n_used, threshold).

    The pairs are numbered by range partitions, so no task sorts all of them.
    """
    d = numbered(center_distances(centers), ["d", "i", "j"], "r", "bigint")
    n = d.groupBy().agg(F.count(F.lit(1)).alias("n")).first()["n"]
    return d.filter(F.col("r") < max(1, int(n * percentage))).agg(F.when(F.count(F.lit(1)) > 0, F.lit(n)).cast("bigint").alias("n_pairs"), F.count(F.lit(1)).alias("n_used"), F.avg("d").alias("threshold"))


def greedy_kept(edges: list[tuple[int, int]], positions: list[int]) -> dict[int, int]:
    """pos -> the kept center it belongs to (itself if kept), for edges i < j below the threshold."""
    before: dict[int, list[int]] = {}
    for i, j in edges:
        before.setdefault(j, []).append(i)
    owner: dict[int, int] = {}
    for p in sorted(positions):
        kept = [i for i in before.get(p, ()) if owner.get(i) == i]
        owner[p] = min(kept) if kept else p
    return owner


def _owners(centers: DataFrame, threshold: float | None) -> DataFrame:
    """pos, owner of every center: one pass in order of ``pos`` by one task, whose memory is the kept centers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kept, n = np.empty(0, np.int32), np.empty((0, 0)), 0
        for batch in batches:
            pos = np.asarray(batch.column(0)).astype(np.int32)
            x = np.asarray(batch.column(1).flatten(), float).reshape(len(pos), -1)
            owner = pos.copy()
            for k in range(len(pos)):
                if threshold is not None and n:
                    near = np.flatnonzero(((kept[:n] - x[k]) ** 2).sum(1) < threshold**2) if threshold > 0 else ()
                    if len(near):
                        owner[k] = names[near[0]]
                        continue
                if n == len(names):
                    names = np.concatenate([names, np.empty(max(64, n), np.int32)])
                    kept = np.concatenate([kept.reshape(n, x.shape[1]), np.empty((max(64, n), x.shape[1]))])
                names[n], kept[n] = pos[k], x[k]
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(pos), pa.array(owner)], names=["pos", "owner"])

    return durable(centers.select("pos", "center").repartition(1).sortWithinPartitions("pos").mapInArrow(run, "pos int, owner int"))


def keep_first(centers: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The centers that no kept earlier one is nearer to than ``threshold``."""
    owners = _owners(centers, threshold)
    return centers.join(owners.filter("pos = owner").select("pos"), "pos", "left_semi")


def merge_average(centers: DataFrame, percentage: float = 0.3, mode: str = "last") -> DataFrame:
    """pos, center of the kept centers, those they absorbed averaged in.

    ``last``: each absorption overwrites the one before, so the result is the
    mean of the center and the last it absorbed.  ``centroid``: the mean of all.
    One center is returned unchanged.
    """
    if mode not in ("last", "centroid"):
        raise ValueError("mode must be last or centroid")
    owners = _owners(centers, merge_threshold(centers, percentage))
    members = centers.select("pos", "center").join(owners, "pos")
    own = members.filter("pos = owner").select(F.col("pos").alias("k"), F.col("center").alias("c"))
    if mode == "last":
        last = members.filter("pos <> owner").groupBy("owner").agg(F.max_by("center", "pos").alias("l"))
        out = own.join(last, F.col("k") == F.col("owner"), "left")
        return out.select(F.col("k").alias("pos"), F.when(F.col("l").isNull(), F.col("c")).otherwise(F.zip_with("c", "l", lambda x, y: (x + y) / 2)).alias("center"))
    means = members.select(F.col("owner").alias("pos"), F.posexplode("center").alias("d", "x")).groupBy("pos", "d").agg(F.avg("x").alias("x"))
    return means.groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("e")).select("pos", F.transform("e", lambda e: e["x"]).alias("center"))


def steepest_threshold(centers: DataFrame, window: int = 200) -> DataFrame:
    """One row (n_entries, start, threshold); threshold null for fewer than ``window`` entries.

    The whole distance matrix, diagonal included, is flattened and sorted; of
    the windows that begin in its first half the one with the greatest rise is
    taken, the first at a tie (index 0 if there is none), and its mean is the threshold.
    """
    d = durable(center_distances(centers).select("d"))
    both = d.unionAll(d).unionAll(centers.select(F.lit(0.0).alias("d")))
    rows = durable(numbered(both, ["d"], "r", "bigint"))
    release(d)
    n = rows.count()
    # windows span parts of the order: the first rows of a part are also the last ones of the part before
    part = F.floor(F.col("r") / PART)
    cut = rows.select("d", "r", F.explode(F.when((F.col("r") % PART < window - 1) & (part > 0), F.array(part, part - 1)).otherwise(F.array(part))).alias("part"))
    at = Window.partitionBy("part").orderBy("r")
    ends = cut.select("r", "part", (F.lead("d", window - 1).over(at) - F.col("d")).alias("rise"), F.avg("d").over(at.rowsBetween(0, window - 1)).alias("mean"))
    ends = ends.filter((F.floor(F.col("r") / PART) == F.col("part")))
    ok = (F.col("r") < n // 2 - (window - 1)) & F.col("rise").isNotNull()
    best = ends.agg(F.max_by("mean", F.when(ok, F.struct("rise", -F.col("r")))).alias("m"), F.max_by("r", F.when(ok, F.struct("rise", -F.col("r")))).alias("s"), F.min_by("mean", "r").alias("m0"))
    enough = F.lit(n >= window)
    return best.select(F.lit(n).cast("bigint").alias("n_entries"), F.when(enough, F.coalesce("s", F.lit(0).cast("bigint"))).alias("start"), F.when(enough, F.coalesce("m", "m0")).alias("threshold"))


def keep_first_steepest(centers: DataFrame, window: int = 200) -> DataFrame:
    """Keep-first with the threshold of the steepest window; unchanged if there are too few entries."""
    t = steepest_threshold(centers, window).first()["threshold"]
    return centers if t is None else keep_first(centers, t)


def label_means(labelled: DataFrame) -> DataFrame:
    """label, center: the mean vector of each label."""
    means = labelled.select("label", F.posexplode("center").alias("d", "x")).groupBy("label", "d").agg(F.avg("x").alias("x"))
    return means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("e")).select("label", F.transform("e", lambda e: e["x"]).alias("center"))


def similarities(x: np.ndarray) -> np.ndarray:
    """exp(-d^2) of all pairs of rows: the one square array, filled in slices of 16 MB, each pair once."""
    n = len(x)
    s = np.empty((n, n))
    step = max(1, 2_000_000 // max(1, x.size))
    for lo in range(0, n, step):
        part = np.exp(-squared(x[lo : lo + step], x[lo:]))
        s[lo : lo + step, lo:] = part
        s[lo:, lo : lo + step] = part.T
    return s


def smallest_eigenvectors(s: np.ndarray, small: float, width: int = 16, tolerance: float = 1e-12, seed: int = 0) -> np.ndarray:
    """Eigenvectors of the Laplacian D - S with eigenvalue below ``small``, ascending; at least the first one.

    Block Lanczos with all blocks kept orthogonal: the similarities are only
    multiplied, never copied.  It ends when the values below ``small`` and the
    first one above are at rest, the latter beyond its residual, and no more than
    half a block is below (so none of several equal values can be hidden; else
    the blocks are doubled); at the latest when the blocks span everything.
    """
    n, degree = len(s), s.sum(1)
    rng = np.random.default_rng(seed)
    while True:
        part = np.linalg.qr(rng.standard_normal((n, min(width, n))))[0]
        basis, image = np.empty((n, 0)), np.empty((n, 0))
        while True:
            basis, image = np.concatenate([basis, part], 1), np.concatenate([image, degree[:, None] * part - s @ part], 1)
            core = basis.T @ image
            theta, y = np.linalg.eigh((core + core.T) / 2)
            k = max(1, int((theta < small).sum()))
            full = basis.shape[1] == n
            if full or 2 * k > width:
                break
            use = y[:, : k + 1]
            residual = np.linalg.norm(image @ use - basis @ use * theta[: k + 1], axis=0)
            if (residual[:k] <= tolerance * degree.max()).all() and theta[k] - residual[k] > max(small, theta[k - 1]) and residual[k] <= 1e-3 * theta[k]:
                break
            new = image[:, -part.shape[1] :].copy()
            for _ in range(2):  # twice is enough
                new -= basis @ (basis.T @ new)
            u, size, _ = np.linalg.svd(new, full_matrices=False)
            part = u[:, size > 1e-10 * degree.max()]
            if not part.shape[1]:  # an invariant subspace: go on from elsewhere
                part = rng.standard_normal((n, min(width, n - basis.shape[1])))
            part = part[:, : n - basis.shape[1]]
            for _ in range(2):
                part = np.linalg.qr(part - basis @ (basis.T @ part))[0]
        if full or 2 * k <= width:
            return basis @ y[:, :k]
        width *= 2


def spectral_groups(x: np.ndarray, small: float, rounds: int = 100) -> np.ndarray:
    """The label of each row of ``x`` by ``spectral_labels``; one square array in memory."""
    s = similarities(x)
    if len(x) <= DENSE:
        values, vectors = np.linalg.eigh(np.diag(s.sum(1)) - s)
        rows = vectors[:, : max(1, int((values < small).sum()))].copy()
    else:
        rows = np.ascontiguousarray(smallest_eigenvectors(s, small))
    del s
    k = rows.shape[1]
    pick, away = [0], ((rows - rows[0]) ** 2).sum(1)
    while len(pick) < k:
        pick.append(int(away.round(9).argmax()))  # copies are equally far: the first of them
        away = np.minimum(away, ((rows - rows[pick[-1]]) ** 2).sum(1))
    c = rows[pick]
    label = np.full(len(rows), -1)
    step = max(1, 2_000_000 // max(1, k * k))
    for _ in range(rounds):
        new = np.concatenate([squared(rows[lo : lo + step], c).round(12).argmin(1) for lo in range(0, len(rows), step)])
        if (new == label).all():
            break
        label = new
        c = np.array([rows[label == j].mean(0) if (label == j).any() else c[j] for j in range(k)])
    return label


def spectral_labels(centers: DataFrame, small: float = 1e-4, rounds: int = 100) -> DataFrame:
    """pos, label: spectral grouping of the centers in one grouped call.

    Similarity exp(-d^2); Laplacian D - S; the eigenvectors with eigenvalue
    below ``small`` (one at least) are the coordinates; k-means with as many
    centers, started from the farthest points in turn, gives the labels.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        label = spectral_groups(np.stack(part["center"].to_numpy()).astype(float), small, rounds)
        return pd.DataFrame({"pos": part["pos"].to_numpy(), "label": label.astype("int32")})

    if centers.count() > MOST_SPECTRAL:
        raise ValueError("too many centers for a dense decomposition")
    return centers.select("pos", "center", F.lit(0).alias("g")).groupBy("g").applyInPandas(run, "pos int, label int")


def spectral_centers(centers: DataFrame, small: float = 1e-4) -> DataFrame:
    return label_means(centers.join(spectral_labels(centers, small), "pos"))


def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """1 - exp(-squared distance / 2)."""
    return 1 - np.exp(-squared(x, y) / 2)


def kernel_range(centers: DataFrame) -> tuple[float, float] | None:
    """The least and the greatest kernel distance of two centers; None for fewer than two."""

    def ends(pos, _, x, other, y):
        d = kernel(x, y)[pos[:, None] < other[None, :]]
        return [np.array([d.min()] if len(d) else [], float), np.array([d.max()] if len(d) else [], float)]

    r = against_all(centers, ends, "a double, b double").agg(F.min("a").alias("a"), F.max("b").alias("b")).first()
    return None if r["a"] is None else (float(r["a"]), float(r["b"]))


def cut_off(centers: DataFrame, low: float = 0.01, high: float = 0.02, steps: int = 100, ahead: int = 6) -> float:
    """A kernel distance below which the share of ordered pairs among n * n lies in [low, high], by bisection.

    A pass over the pairs counts for all values that the next ``ahead`` steps can
    come to.
    """
    ends, n = kernel_range(centers), centers.count()
    if ends is None:
        return 0.0
    a, b = ends
    known: dict[float, float] = {}

    def shares(a: float, b: float) -> None:
        tree, level = [], [(a, b)]
        for _ in range(ahead):
            tree += [(x + y) / 2 for x, y in level]
            level = [p for x, y in level for p in ((x, (x + y) / 2), ((x + y) / 2, y))]
        cuts = np.array(sorted(set(tree)))

        def count(pos, _, x, other, y):
            d = np.sort(kernel(x, y)[pos[:, None] < other[None, :]])
            return [np.arange(len(cuts), dtype=np.int32), np.searchsorted(d, cuts, "left").astype(np.int64)]

        for r in against_all(centers, count, "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect():
            known[float(cuts[r["k"]])] = r["n"] * 2 / (n * n)

    dc = (a + b) / 2
    for _ in range(steps):
        if dc not in known:
            shares(a, b)
        share = known[dc]
        if low <= share <= high:
            break
        a, b = (dc, b) if share < low else (a, dc)
        dc = (a + b) / 2
        if b - a < 1e-14:
            break
    return dc


def density_peaks_table(centers: DataFrame, dc: float) -> DataFrame:
    """pos, rho, delta, nearest: neighbours below ``dc`` by kernel distance; distance to the nearest denser center.

    Ties of rho are broken by position: the earlier one counts as denser.  The
    densest center has the greatest distance of all as delta and no ``nearest``.
    Two passes give a few numbers per center; no pairs are written.
    """

    def count(pos, _, x, other, y):
        return [pos.astype(np.int32), ((kernel(x, y) < dc) & (pos[:, None] != other[None, :])).sum(1).astype(np.int64)]

    rho = durable(against_all(centers, count, "pos int, rho bigint").groupBy("pos").agg(F.sum("rho").alias("rho")))
    dense = durable(centers.select("pos", "center").join(rho, "pos"))
    out = None
    for at, _ in _chunks(dense):  # the ranks of a chunk's centers go along with it
        part = dense.filter(F.col("pos").isin(at.tolist())) if len(at) < dense.count() else dense
        ranks = {r["pos"]: r["rho"] for r in part.select("pos", "rho").collect()}
        shared = dense.sparkSession.sparkContext.broadcast((np.array(sorted(ranks)), np.array([ranks[k] for k in sorted(ranks)])))

        def nearest(pos, own, x, other, y, shared=shared):
            names, values = shared.value
            k = np.searchsorted(names, other).clip(0, len(names) - 1)
            known = names[k] == other
            denser = known & ((values[k] > own[:, None]) | ((values[k] == own[:, None]) & (other[None, :] < pos[:, None])))
            d = np.where(denser, kernel(x, y), np.inf)
            best = d.argmin(1)
            use = np.isfinite(d[np.arange(len(pos)), best])
            return [pos[use].astype(np.int32), d[np.arange(len(pos)), best][use], other[best[use]].astype(np.int32)]

        got = against_all(dense, nearest, "pos int, d double, other int", "rho")
        out = got if out is None else out.unionByName(got)
    near = out.groupBy("pos").agg(F.min(F.struct("d", "other")).alias("m")) if out is not None else centers.select("pos", F.lit(None).cast("struct<d:double,other:int>").alias("m")).limit(0)
    ends = kernel_range(centers)
    return rho.join(near, "pos", "left").select("pos", "rho", F.coalesce(F.col("m.d"), F.lit(ends[1] if ends else 0.0)).alias("delta"), F.col("m.other").alias("nearest"))


def density_peak_labels(peaks: DataFrame, delta: float, rho: float) -> DataFrame:
    """pos, is_center, label: the position of the center each one follows, -1 if it follows none.

    Centers have at least ``delta`` and ``rho``; the others take the label of
    their nearest denser one.  Pointers double, so chains of any length end
    after few joins.
    """
    spark = peaks.sparkSession
    is_center = (F.col("delta") >= delta) & (F.col("rho") >= rho)
    table = durable(peaks.select("pos", is_center.alias("is_center"), F.when(is_center, F.col("pos")).otherwise(F.coalesce("nearest", F.lit(-1))).alias("to")))
    n = table.count()
    to = table.select("pos", "to")
    for _ in range(max(1, math.ceil(math.log2(max(2, n))))):
        step = to.select(F.col("pos").alias("to"), F.col("to").alias("next")).unionAll(spark.createDataFrame([(-1, -1)], "to int, next int"))
        before, to = to, durable(to.join(step, "to").select("pos", F.col("next").alias("to")))  # the plan would double with the pointers
        release(before)
    return table.select("pos", "is_center").join(to, "pos").select("pos", "is_center", F.col("to").alias("label"))


def density_peak_centers(centers: DataFrame, delta: float, rho: float) -> DataFrame:
    """pos, center of the density-peak centers."""
    centers = durable(centers.select("pos", "center"))
    chosen = density_peaks_table(centers, cut_off(centers)).filter((F.col("delta") >= delta) & (F.col("rho") >= rho)).select("pos")
    return centers.join(chosen, "pos", "left_semi")


def center_statistics(counts: DataFrame) -> DataFrame:
    """One row: total, least, most and mean number of centers per block (columns block_id, n)."""
    return counts.agg(F.sum("n").alias("total"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"))


def cumulative_statistics(centers: DataFrame, threshold: float = 0.3, batch: int = 1) -> DataFrame:
    """Per prefix of blocks: partitions, local_centers, total, average, merged, ratio, reduction.

    ``centers`` has block_id, pos, center, and pos grows with block_id.  A
    removed center never blocks another one, so the centers that keep-first
    keeps in the first b blocks are those of one pass over all that lie in them:
    one pass gives every prefix.  Rows at the end of every ``batch`` blocks, and
    of the last block.
    """
    if batch < 1:
        raise ValueError("a batch has one block at least")
    owners = _owners(centers, threshold)
    per = centers.join(owners, "pos").groupBy("block_id").agg(F.count(F.lit(1)).alias("local_centers"), F.count_if(F.col("pos") == F.col("owner")).alias("kept"))
    w = Window.orderBy("block_id").rowsBetween(Window.unboundedPreceding, 0)
    running = per.select(F.row_number().over(Window.orderBy("block_id")).alias("partitions"), "local_centers", F.sum("local_centers").over(w).alias("total"), F.sum("kept").over(w).alias("merged"), F.count(F.lit(1)).over(Window.partitionBy()).alias("all"))
    ratio = F.col("merged") / F.col("total")
    return running.filter((F.col("partitions") % batch == 0) | (F.col("partitions") == F.col("all"))).select("partitions", "local_centers", "total", F.round(F.col("total") / F.col("partitions"), 0).cast("bigint").alias("average"), "merged", ratio.alias("ratio"), ((1 - ratio) * 100).alias("reduction"))


def fold_blocks(kept: list[list[float]], block: list[list[float]], threshold: float) -> list[list[float]]:
    """The centers kept so far, and those of a new block that none of them (or of the block's kept ones) is nearer to than ``threshold``."""
    out = [np.asarray(c, float) for c in kept]
    for c in block:
        c = np.asarray(c, float)
        if all(math.sqrt(((c - k) ** 2).sum()) >= threshold for k in out):
            out.append(c)
    return [k.tolist() for k in out]


def checked_centers(centers: DataFrame, percentage: float | None = None) -> DataFrame:
    """``centers``; raises if there is none, if lengths differ or if the percentage is no share."""
    if percentage is not None and not 0 <= percentage <= 1:
        raise ValueError("the percentage must lie between 0 and 1")
    s = centers.agg(F.min(F.size("center")).alias("a"), F.max(F.size("center")).alias("b")).first()
    if s["a"] is None:
        raise ValueError("there are no centers")
    if s["a"] != s["b"]:
        raise ValueError("centers differ in length")
    return centers

