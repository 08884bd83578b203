"""Composed pipelines: one parameterised function, and the named variants.

points (id, v) -> blocks -> observers -> local models -> merge within the block
-> centers with positions -> global consolidation -> k-means.  The local models
are written once and read by everything after them.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import blocks as B
from cairn.operators import consolidate as C
from cairn.operators import evaluate as E
from cairn.operators import reduce as R
from cairn.operators import terms as T
from cairn.operators.fit import best_observer, local_centers, local_models
from cairn.operators.kmeans import assign_centers, center_matrix, cost, lloyd
from cairn.runtime import durable, release


@dataclass(frozen=True)
class Plan:
    """What a variant does at each stage.

    ``merge_block`` and ``merge_all`` are tuples: ("average", percentage),
    ("keep_first", threshold), ("steepest", window), ("spectral",), ("peaks",
    delta, rho) or None.
    """

    n_blocks: int = 1
    use_blocks: int | None = None
    observers: str = "sampled"
    n_observers: int = 10
    knn: int = 10
    selection: str = "sequential"
    gate: int | None = None
    only_best: bool = False
    merge_block: tuple | None = None
    merge_all: tuple | None = None
    kmeans_rounds: int = 100
    local: bool = True
    seed: int = 0
    fit: dict = field(default_factory=dict)


#: The parameters of the named method variants.
VARIANTS: dict[str, Plan] = {
    "sampled_blocks": Plan(20, 5, merge_all=("average", 0.3)),
    "two_merges_grid": Plan(5, 5, observers="grid", knn=5, merge_block=("average", 0.1), merge_all=("steepest", 200)),
    "two_merges_sampled": Plan(5, 5, gate=0, merge_block=("average", 0.1), merge_all=("steepest", 200)),
    "peaks_then_spectral": Plan(5, 5, merge_block=("peaks", 0.3, 1), merge_all=("spectral",)),
    "one_node": Plan(merge_all=("average", 0.1)),
    "best_single_observer": Plan(only_best=True),
    "observers_then_peaks": Plan(merge_all=("peaks", 0.1, 0.5)),
    "peaks_only": Plan(local=False, merge_all=("peaks", 0.1, 0.5)),
    "window_average": Plan(5, 5, n_observers=2, knn=5, selection="window", merge_all=("average", 0.15)),
    "window_keep_first": Plan(5, 5, n_observers=2, knn=5, selection="window", merge_all=("keep_first", 0.3)),
    "all_partitions": Plan(5, 5, n_observers=5, knn=10, selection="window", merge_all=("keep_first", 0.3), kmeans_rounds=0),
    "no_merge": Plan(5, 5, n_observers=5, knn=10, selection="window", kmeans_rounds=0),
    "text_two_blocks": Plan(2, 2, observers="grid", knn=5, merge_block=("average", 0.1), merge_all=("steepest", 200), kmeans_rounds=0),
    "text_one_node": Plan(observers="grid", knn=5),
    "one_file": Plan(n_observers=2, knn=5, selection="window", merge_all=("average", 0.3)),
    "file_blocks": Plan(4, 4, n_observers=3, knn=3, selection="window", merge_all=("average", 0.3)),
}


def _merge_within(rows: pd.DataFrame, how: tuple) -> pd.DataFrame:
    """The centers of one block, consolidated in NumPy: a block has few."""
    rows = rows.sort_values(["observer_id", "center_idx"])
    x = np.stack(rows["center"].to_numpy()).astype(float)
    n = len(x)
    i, j = np.triu_indices(n, 1)
    if how[0] == "average":
        d = np.sqrt(((x[i] - x[j]) ** 2).sum(1))
        if n > 1:
            limit = np.sort(d)[: max(1, int(len(d) * how[1]))].mean()
            owner = C.greedy_kept([(int(a), int(b)) for a, b, e in zip(i, j, d) if e < limit], list(range(n)))
            last = {o: p for p, o in sorted(owner.items()) if p != o}
            x = np.array([(x[k] + x[last[k]]) / 2 if k in last else x[k] for k in sorted(set(owner.values()))])
    elif how[0] == "peaks":
        d = 1 - np.exp(-((x[i] - x[j]) ** 2).sum(1) / 2)
        if n > 1:
            a, b = float(d.min()), float(d.max())
            dc = (a + b) / 2
            for _ in range(100):
                share = (d < dc).sum() * 2 / n**2
                if 0.01 <= share <= 0.02:
                    break
                a, b = (dc, b) if share < 0.01 else (a, dc)
                dc = (a + b) / 2
            full = np.zeros((n, n))
            full[i, j] = full[j, i] = d
            rho = (full < dc).sum(1) - (0 < dc)
            order = np.lexsort((np.arange(n), -rho))
            delta = np.empty(n)
            delta[order[0]] = d.max()
            for k in range(1, n):
                delta[order[k]] = full[order[k], order[:k]].min()
            x = x[(delta >= how[1]) & (rho >= how[2])]
    else:
        raise ValueError(f"blocks cannot be merged by {how[0]}")
    return pd.DataFrame({"center_idx": np.arange(len(x), dtype="int32"), "center": pd.Series([c.tolist() for c in x], dtype=object)})


def consolidated(centers: DataFrame, how: tuple | None) -> DataFrame:
    """pos, center after a global step."""
    if how is None:
        return centers.select("pos", "center")
    kind, *args = how
    if kind == "average":
        return C.merge_average(centers, *args)
    if kind == "keep_first":
        return C.keep_first(centers, *args).select("pos", "center")
    if kind == "steepest":
        return C.keep_first_steepest(centers, *args).select("pos", "center")
    if kind == "spectral":
        return C.spectral_centers(centers).select(F.col("label").alias("pos"), "center")
    if kind == "peaks":
        return C.density_peak_centers(centers, *args)
    raise ValueError(f"unknown consolidation {kind}")


@dataclass
class Result:
    models: DataFrame | None
    local: DataFrame
    centers: DataFrame
    labels: DataFrame | None
    cost: float | None


def run(points: DataFrame, plan: Plan, dim: int | None = None) -> Result:
    """Points (id bigint, v array<double>) through all stages of ``plan``; a column ``block_id`` from 0 keeps given blocks."""
    if plan.local:
        rows = points.select("block_id", "id", "v") if "block_id" in points.columns else B.with_block(points.select("id", "v"), "id", plan.n_blocks, plan.seed)
        if plan.use_blocks and plan.use_blocks < plan.n_blocks:
            rows = B.choose_blocks(rows.withColumnRenamed("id", "pid"), plan.n_blocks, plan.use_blocks, plan.seed).withColumnRenamed("pid", "id")
        rows = durable(rows.select("block_id", "id", "v"))
        seen = B.sample_observers(rows, plan.n_observers, plan.seed) if plan.observers == "sampled" else B.grid_observers(rows, plan.n_observers, dim or len(points.first()["v"]), plan.seed)
        models = durable(local_models(rows, seen, plan.knn, plan.selection, gate=plan.gate, **plan.fit))
        found = best_observer(models) if plan.only_best else local_centers(models)
        if plan.merge_block:
            merged = B.local_op(found.select("block_id", "observer_id", "center_idx", "center"), ["block_id"], lambda key, part: _merge_within(part, plan.merge_block), "center_idx int, center array<double>")
            found = merged.filter("error is null").select("block_id", F.lit(0).alias("observer_id"), "center_idx", "center")
        local = durable(C.with_position(found.select("block_id", "observer_id", "center_idx", "center"), ["block_id", "observer_id", "center_idx"]))
    else:
        models = None
        local = C.with_position(points.select(F.lit(0).alias("block_id"), F.lit(0).alias("observer_id"), F.col("id").alias("center_idx"), F.col("v").alias("center")), ["center_idx"])
        local = durable(local)
    centers = durable(consolidated(local, plan.merge_all))
    if not plan.kmeans_rounds or centers.isEmpty():
        return Result(models, local, centers, None, None)
    moved, _ = lloyd(points, center_matrix(centers, order=["pos"]), plan.kmeans_rounds)
    final = points.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(moved)], "pos int, center array<double>")
    return Result(models, local, final, assign_centers(points, moved), cost(points, moved))


def variant(points: DataFrame, name: str, **changes) -> Result:
    return run(points, replace(VARIANTS[name], **changes))


def repeated(points: DataFrame, plan: Plan, repeats: int = 5) -> DataFrame:
    """run, clusters, purity, ari, seconds of ``plan`` on labelled points (id, v, label), once for each of ``repeats`` seeds."""
    rows = []
    for r in range(repeats):
        began = time.time()
        out = run(points.select("id", "v"), replace(plan, seed=r))
        if out.labels is None:
            rows.append((r, out.centers.count(), None, None, time.time() - began))
            continue
        labels = durable(out.labels.join(points.select("id", F.col("label").alias("truth")), "id").withColumnRenamed("label", "cluster"))
        rows.append((r, labels.select("cluster").distinct().count(), E.purity(labels).first()["purity"], E.adjusted_rand(labels).first()["ari"], time.time() - began))
        release(labels)
    return points.sparkSession.createDataFrame(rows, "run int, clusters bigint, purity double, ari double, seconds double")


def stored_merge(lists: DataFrame, threshold: float = 0.3, blocks: int | None = None) -> DataFrame:
    """Stored lists of local centers (partition_id, centers_list) of the first ``blocks`` partitions, by keep-first."""
    flat = lists.select(F.col("partition_id").alias("block_id"), F.posexplode("centers_list").alias("center_idx", "center")).filter("center is not null")
    if blocks is not None:
        flat = B.first_blocks(flat, blocks)
    return C.keep_first(C.with_position(flat, ["block_id", "center_idx"]), threshold)


def stored_statistics(lists: DataFrame, threshold: float = 0.3, batch: int = 1) -> DataFrame:
    flat = lists.select(F.col("partition_id").alias("block_id"), F.posexplode("centers_list").alias("center_idx", "center")).filter("center is not null")
    return C.cumulative_statistics(C.with_position(flat, ["block_id", "center_idx"]), threshold, batch)


def term_filter_report(entries: DataFrame, dictionary: DataFrame, min_df: int = 1000, max_ratio: float = 0.5, min_variance: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """(filtered entries, valid terms with their words, old and new indices)."""
    kept, valid = T.term_filter(entries, min_df, min_variance, max_ratio=max_ratio)
    return kept, valid.join(dictionary.dropDuplicates(["term_index"]), "term_index", "left")


def corpus_report(entries: DataFrame, documents: DataFrame, codes: DataFrame, n: int = 100) -> tuple[DataFrame, DataFrame]:
    """(top terms of the mean vector, summary of the document lengths)."""
    size = documents.agg(F.count(F.lit(1)).alias("cluster_size"))
    top = E.ranked_terms(E.mean_entries(entries, size, []), [], n, codes)
    return top, T.length_summary(T.document_lengths(entries))


def seeded_kmeans_report(points: DataFrame, centers: np.ndarray, rounds: int = 100) -> tuple[DataFrame, DataFrame, float]:
    """(assignment, size distribution, cost) of k-means from given centers."""
    moved, _ = lloyd(points, centers, rounds)
    labels = durable(assign_centers(points, moved))
    return labels, E.cluster_distribution(labels, "label"), cost(points, moved)


def rank_report(points: DataFrame, most: int = 2000, threshold: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """(rank for the share of variance, elbows) from the leading singular values."""
    width = len(points.first()["v"])
    values, _ = R.singular_values(points, min(most, width))
    table = R.scree(R.sigma_table(points.sparkSession, values))
    return R.rank_by_variance(table, threshold), R.elbows(table)


def monthly_reconstruction(spark: SparkSession, months: list[str], chunks, dictionary: DataFrame) -> DataFrame:
    """month, doc_id, term_index, value: the wide chunks of each month (``chunks(month)``) as one long table."""
    parts = [T.wide_to_entries(chunks(m), dictionary).withColumn("month", F.lit(m)) for m in months]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("month", "doc_id", "term_index", "value")


def full_flow(points: DataFrame, plan: Plan, rank: int) -> Result:
    """Vectors -> SVD of ``rank`` -> standard scaling -> ``plan``."""
    values, right = R.singular_values(points, rank)
    reduced = R.scaled_vectors(R.project(points, values, right).withColumnRenamed("u", "v"))
    return run(durable(reduced), plan)


def sparse_flow(rows: DataFrame, size: int, plan: Plan, rank: int) -> Result:
    """``full_flow`` of sparse vectors (id, idx, vals) of ``size`` columns."""
    values, right = R.sparse_singular_values(rows, size, rank)
    reduced = R.scaled_vectors(R.sparse_project(rows, values, right).withColumnRenamed("u", "v"))
    return run(durable(reduced), plan)
