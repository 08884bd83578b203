"""Distance profiles: how far the points of a block are from an observer.

One row per (block, observer, point).  Bandwidths, kernel densities and peaks
are computed per (block, observer); the number of peaks is the first guess of
the number of components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.vectors import euclidean

GROUP = ["block_id", "observer_id"]
#: Beyond this many bandwidths a Gaussian kernel is below 1e-15.
REACH = 8.3


def distance_profile(points: DataFrame, observers: DataFrame, zero: float | None = 0.1) -> DataFrame:
    """block_id, observer_id, id, dist of every point to every observer of its block.

    Distance 0 becomes ``zero`` (a gamma density needs positive values; None
    keeps it).  Ids stay with their distances.  Each point meets only the few
    observers of its block: an equi-join on the block.
    """
    d = euclidean(F.col("v"), F.col("observer_v"))
    joined = points.select("block_id", "id", "v").join(observers.select(*GROUP, "observer_v"), "block_id")
    return joined.select(*GROUP, "id", (d if zero is None else F.when(d == 0, F.lit(zero)).otherwise(d)).alias("dist"))


def checked_profile(profile: DataFrame, least: int = 3) -> DataFrame:
    """``profile``; raises on a null or negative distance and on a group of fewer than ``least`` points."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*GROUP))
    bad = F.col("dist").isNull() | (F.col("dist") < 0)
    return profile.withColumn("__n", n).withColumn("dist", F.when(bad, F.raise_error(F.lit("null or negative distance"))).when(F.col("__n") < least, F.raise_error(F.lit(f"fewer than {least} distances"))).otherwise(F.col("dist"))).drop("__n")


def _spread(kind: str) -> Column:
    if kind == "linear":
        return F.percentile("dist", F.lit(0.75)) - F.percentile("dist", F.lit(0.25))
    # position p (n + 1) in the sorted values, the rule of older statistics libraries
    def at(p: float) -> Column:
        s, n = F.sort_array(F.collect_list("dist")), F.count(F.lit(1))
        pos = F.lit(p) * (n + 1)
        low = F.greatest(F.least(F.floor(pos), n), F.lit(1))
        high = F.least(low + 1, n)
        part = F.greatest(F.lit(0.0), F.least(pos - low, F.lit(1.0)))
        return F.element_at(s, low.cast("int")) + part * (F.element_at(s, high.cast("int")) - F.element_at(s, low.cast("int")))

    return at(0.75) - at(0.25)


def bandwidths(profile: DataFrame, kind: str = "robust", iqr: str = "linear") -> DataFrame:
    """block_id, observer_id, n, h.

    ``basic``: 1.06 s n^-0.2 with the sample deviation s.  ``robust``: 0.9
    min(s, IQR / 1.34) n^-0.2, at least 1e-5.  ``iqr`` is ``linear`` or ``legacy``
    (position p (n + 1)).
    """
    s, n = F.stddev_samp("dist"), F.count(F.lit(1))
    shrink = F.pow(n, F.lit(-0.2))
    h = 1.06 * s * shrink if kind == "basic" else F.greatest(0.9 * F.least(s, _spread(iqr) / 1.34) * shrink, F.lit(1e-5))
    return profile.groupBy(*GROUP).agg(n.alias("n"), h.alias("h"))


def kernel_density(profile: DataFrame, bands: DataFrame) -> DataFrame:
    """block_id, observer_id, id, dist, density: Gaussian kernel density at the points themselves.

    Within a group only points up to ``REACH`` bandwidths apart are summed (the
    rest is below rounding), along the sorted distances in slices; a group is a
    block, whose size is bounded.
    """

    def density(table: pa.Table) -> pa.Table:
        x = np.asarray(table.column("dist"), dtype=float)
        h = float(table.column("h")[0].as_py() or 0.0)
        order = np.argsort(x, kind="stable")
        s = x[order]
        out = np.empty(len(s))
        lo, hi = np.searchsorted(s, s - REACH * h, "left"), np.searchsorted(s, s + REACH * h, "right")
        for a in range(0, len(s), 256):
            b = min(a + 256, len(s))
            near = s[lo[a] : hi[b - 1]]
            z = (s[a:b, None] - near[None, :]) / h if h > 0 else np.full((b - a, len(near)), np.inf)
            out[order[a:b]] = np.exp(-0.5 * z * z).sum(1) / (len(s) * h * np.sqrt(2 * np.pi)) if h > 0 else np.nan
        return table.select([*GROUP, "id", "dist"]).append_column("density", pa.array(out))

    kinds = {f.name: f.dataType.simpleString() for f in profile.schema.fields}
    shape = ", ".join(f"{c} {kinds[c]}" for c in (*GROUP, "id", "dist")) + ", density double"
    return profile.join(bands.select(*GROUP, "h"), GROUP).groupBy(*GROUP).applyInArrow(density, shape)


def density_peaks(density: DataFrame) -> DataFrame:
    """The rows that are strict local maxima along the distance, ends excepted; ties in order of id."""
    w = Window.partitionBy(*GROUP).orderBy("dist", "id")
    return density.withColumn("__a", F.lag("density").over(w)).withColumn("__b", F.lead("density").over(w)).filter((F.col("density") > F.col("__a")) & (F.col("density") > F.col("__b"))).drop("__a", "__b")


def component_counts(density: DataFrame, least: int = 1) -> DataFrame:
    """block_id, observer_id, peaks, components (at least ``least``) of every group."""
    peaks = density_peaks(density).groupBy(*GROUP).agg(F.count(F.lit(1)).alias("peaks"))
    every = density.select(*GROUP).distinct()
    n = F.coalesce("peaks", F.lit(0).cast("bigint"))
    return every.join(peaks, GROUP, "left").select(*GROUP, n.alias("peaks"), F.greatest(n, F.lit(least).cast("bigint")).alias("components"))

