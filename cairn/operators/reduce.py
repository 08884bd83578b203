"""Dimension reduction: truncated SVD, choice of rank, standard scaling."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def singular_values(points: DataFrame, k: int, r_cond: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors as columns) of the matrix whose rows are ``v``.

    The distributed row matrix takes the DataFrame itself, so rows never pass
    through Python; its results are k numbers and a (columns x k) matrix.
    """
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    rows = MLUtils.convertVectorColumnsFromML(points.select(array_to_vector("v").alias("x")), "x").persist()
    try:
        svd = RowMatrix(rows).computeSVD(k, computeU=False, rCond=r_cond)
        return np.array(svd.s.toArray()), np.array(svd.V.toArray())
    finally:
        rows.unpersist()


def _sparse_rows(idx: pa.Array, vals: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, value) of the entries of two list columns."""
    n = np.diff(np.asarray(idx.offsets))
    return np.repeat(np.arange(len(n)), n), np.asarray(idx.flatten()).astype(np.int64), np.asarray(vals.flatten(), float)


def _summed(at: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
    """Rows of ``x`` added up by ``at``, as ``size`` rows."""
    out = np.zeros((size, x.shape[1]))
    if len(at):
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(at[order]) > 0]))
        out[at[order][first]] = np.add.reduceat(x[order], first, axis=0)
    return out


def sparse_singular_values(rows: DataFrame, size: int, k: int, tolerance: float = 1e-8, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """``singular_values`` of sparse rows (idx array<int>, vals array<double>) of ``size`` columns, never made dense.

    Block Lanczos: a pass over the rows multiplies a block of k + 6 vectors by
    A'A; each task adds up its part, and a sum per column comes to the driver,
    which holds the blocks.  It ends when the residuals of the k greatest values
    are below ``tolerance`` of the greatest, or the blocks span all columns.
    """
    spark = rows.sparkSession
    k = min(k, size)
    width = min(size, k + 6)
    part = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0]
    basis, image = np.empty((size, 0)), np.empty((size, 0))
    while True:
        shared = spark.sparkContext.broadcast(part)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q = shared.value
            total = np.zeros(q.shape)
            for b in batches:
                row, at, x = _sparse_rows(b.column(0), b.column(1))
                y = _summed(row, q[at] * x[:, None], b.num_rows)
                total += _summed(at, y[row] * x[:, None], len(q))
            used = np.flatnonzero(total.any(1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(used) * q.shape[1] + 1, q.shape[1], dtype=np.int32)), pa.array(total[used].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), lists], names=["at", "z"])

        sums = rows.select("idx", "vals").mapInArrow(run, "at int, z array<double>").groupBy("at").agg(F.array(*(F.sum(F.get("z", F.lit(i))) for i in range(part.shape[1]))).alias("z"))
        z = np.zeros(part.shape)
        for r in sums.collect():
            z[r["at"]] = r["z"]
        basis, image = np.concatenate([basis, part], 1), np.concatenate([image, z], 1)
        small = basis.T @ image
        theta, y = np.linalg.eigh((small + small.T) / 2)
        theta, y = theta[::-1][:k], y[:, ::-1][:, :k]
        vectors = basis @ y
        residual = np.linalg.norm(image @ y - vectors * theta, axis=0)
        new = z.copy()
        for _ in range(2):  # twice is enough
            new -= basis @ (basis.T @ new)
        u, s, _ = np.linalg.svd(new, full_matrices=False)
        part = u[:, s > 1e-10 * max(theta[0], 1e-300)][:, : size - basis.shape[1]]
        if len(theta) == k and (residual <= tolerance * max(theta[0], 1e-300)).all() or not part.shape[1]:
            return np.sqrt(np.maximum(theta, 0.0)), vectors


def sparse_project(rows: DataFrame, values: np.ndarray, right: np.ndarray) -> DataFrame:
    """``project`` for sparse rows (id, idx, vals)."""
    shared = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(right / np.where(values > 0, values, np.inf)))
    k = right.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            row, at, x = _sparse_rows(b.column(1), b.column(2))
            u = _summed(row, m[at] * x[:, None], b.num_rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, u.size + 1, k, dtype=np.int32)), pa.array(u.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["id", "u"])

    return rows.select("id", "idx", "vals").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, u array<double>")


def project(points: DataFrame, values: np.ndarray, right: np.ndarray) -> DataFrame:
    """id, u: each row's left singular coordinates A V / s, by id.

    The (columns x k) matrix goes to every task, and a batch of rows is one
    matrix product.
    """
    shared = points.sparkSession.sparkContext.broadcast(np.ascontiguousarray(right / np.where(values > 0, values, np.inf)))
    k = right.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            u = np.asarray(b.column(1).flatten(), float).reshape(b.num_rows, len(m)) @ m
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, u.size + 1, k, dtype=np.int32)), pa.array(u.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["id", "u"])

    return points.select("id", "v").mapInArrow(run, f"id {points.schema['id'].dataType.simpleString()}, u array<double>")


def scree(sigma: DataFrame) -> DataFrame:
    """k, variance, individual_variance_ratio, cumulative_variance_ratio from a table (k from 1, s)."""
    var = F.col("s") * F.col("s")
    total = F.sum(var).over(Window.partitionBy())
    up = F.sum(var).over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    return sigma.select("k", var.alias("variance"), (var / total).alias("individual_variance_ratio"), (up / total).alias("cumulative_variance_ratio"))


def sigma_table(spark, values) -> DataFrame:
    return spark.createDataFrame([(i + 1, float(s)) for i, s in enumerate(values)], "k int, s double")


def rank_by_variance(table: DataFrame, threshold: float) -> DataFrame:
    """One row (k, reached): the least k whose cumulative ratio is at least ``threshold``; all of them if none is.

    ``table`` is a scree table; if it holds only the leading values, the ratios
    are those among them.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie in (0, 1]")
    c = F.col("cumulative_variance_ratio")
    k = F.coalesce(F.min(F.when(c >= threshold - 1e-12, F.col("k"))), F.max("k"))
    return table.agg(k.alias("k"), F.coalesce(F.min(F.when(c >= threshold - 1e-12, c)), F.max(c)).alias("reached"))


def elbows(table: DataFrame) -> DataFrame:
    """One row: second_difference, curvature, combined, robust.

    second_difference: the k (from 1) at which v[i] - 2 v[i-1] + v[i-2] is
    greatest, reported at i counted from 0.  curvature: the k where the slope angle
    of the cumulative curve changes most.  combined: the smaller of both.
    robust: the smallest of the 0-based positions of the second difference, the
    first ratio below a tenth of the greatest and the first cumulative ratio
    above 0.8; a rule that never holds is left out.
    """
    w = Window.orderBy("k")
    v, c, r = F.col("variance"), F.col("cumulative_variance_ratio"), F.col("individual_variance_ratio")
    x = table.select(
        "k", r.alias("r"), c.alias("c"),
        (v - 2 * F.lag(v).over(w) + F.lag(v, 2).over(w)).alias("d2"),
        F.abs(F.atan2(F.lead(c).over(w) - c, F.lit(1.0)) - F.atan2(c - F.lag(c).over(w), F.lit(1.0))).alias("bend"),
        F.max(r).over(Window.partitionBy()).alias("top"),
    )
    first = lambda cond: F.min(F.when(cond, F.col("k") - 1))
    second = F.max_by(F.col("k") - 1, F.when(F.col("d2").isNotNull(), F.struct(F.round("d2", 12).alias("d"), -F.col("k"))))
    bend = F.max_by(F.col("k"), F.when(F.col("bend").isNotNull(), F.struct(F.round("bend", 12).alias("d"), -F.col("k"))))
    one = x.agg(second.cast("int").alias("second_difference"), bend.cast("int").alias("curvature"), first(F.col("r") < 0.1 * F.col("top")).cast("int").alias("low_ratio"), first(F.col("c") > 0.8).cast("int").alias("most_variance"))
    return one.select("second_difference", "curvature", F.least("second_difference", "curvature").alias("combined"), F.least("second_difference", "low_ratio", "most_variance").alias("robust"))


def standard_scaled(df: DataFrame, columns: list[str], with_mean: bool = True, with_std: bool = True) -> DataFrame:
    """``df`` with ``columns`` centred and divided by their sample deviation (a constant column becomes 0).

    One pass for the statistics (two numbers per column), one narrow projection.
    """
    s = df.agg(*(f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_samp)))).first()

    def scaled(i: int, c: str) -> Column:
        x = F.col(c) - F.lit(s[f"m{i}"]) if with_mean else F.col(c)
        return (F.when(F.lit(s[f"s{i}"] or 0.0) > 0, x / F.lit(s[f"s{i}"] or 1.0)).otherwise(F.lit(0.0)) if with_std else x).alias(c)

    return df.select(*(scaled(columns.index(c), c) if c in columns else F.col(c) for c in df.columns))


def scaled_vectors(points: DataFrame, with_mean: bool = True, with_std: bool = True) -> DataFrame:
    """The same for a vector column ``v``, by the library's scaler."""
    from pyspark.ml.feature import StandardScaler

    x = points.withColumn("__v", array_to_vector("v"))
    model = StandardScaler(inputCol="__v", outputCol="__s", withMean=with_mean, withStd=with_std).fit(x)
    return model.transform(x).withColumn("v", vector_to_array("__s")).drop("__v", "__s")
