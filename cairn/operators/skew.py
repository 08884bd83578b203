"""Per-key joins and aggregates when a handful of keys own most rows.

Heavy hitters are found with a frequent-items sketch, which merges per task and
sends at most ``1 / share`` items to the driver.  Heavy keys are joined by
broadcast (the broadcast side holds one row per heavy key, so its size is
bounded by ``1 / share`` rows), the rest by an ordinary shuffle; the union is
the whole result.  Both branches are exact whatever the sketch says: a key
misjudged as heavy or light only changes the route its rows take.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.runtime import same


def key_hash(keys: list[str]) -> Column:
    """64-bit hash of a composite key; null components are part of the hash."""
    return F.xxhash64(*(F.coalesce(F.col(k).cast("string"), F.lit("\0null")) for k in keys), *(F.col(k).isNull() for k in keys))


def heavy_hitters(rows: DataFrame, keys: list[str], share: float = 0.01) -> list[int]:
    """Hashes of the keys that may hold more than ``share`` of ``rows``.

    The sketch never misses a key above ``share``; it may name a lighter one.
    An empty table has no heavy key.
    """
    if not 0 < share < 1:
        raise ValueError("share must lie between 0 and 1")
    most = math.ceil(1 / share)
    tracked = min(1_000_000, 1 << (16 * most - 1).bit_length())
    found = rows.select(key_hash(keys).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(h, {most}, {tracked})").alias("top")).first()
    return sorted(x["item"] for x in found["top"] or [] if x["count"] > share * found["n"])


def split_by_weight(rows: DataFrame, keys: list[str], heavy: list[int]) -> tuple[DataFrame, DataFrame]:
    """(rows with a heavy key, all other rows)."""
    is_heavy = key_hash(keys).isin(heavy) if heavy else F.lit(False)
    return rows.filter(is_heavy), rows.filter(~is_heavy)


def skew_join(facts: DataFrame, dims: DataFrame, keys: list[str], heavy: list[int], how: str = "left") -> DataFrame:
    """``facts`` joined with ``dims`` (unique per key) without moving heavy facts.

    Keys match null-safely.  ``how`` is ``left`` or ``inner``; columns of
    ``dims`` that clash with a fact column get the suffix ``_dim``.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be left or inner")
    for c in [c for c in dims.columns if c in facts.columns and c not in keys]:
        dims = dims.withColumnRenamed(c, f"{c}_dim")
    right = dims.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in dims.columns if c not in keys))

    def joined(f: DataFrame, d: DataFrame) -> DataFrame:
        on = [same(f[k], d[f"__{k}"]) for k in keys]
        return f.join(d, on, how).drop(*(f"__{k}" for k in keys))

    facts_heavy, facts_light = split_by_weight(facts, keys, heavy)
    dims_heavy, dims_light = split_by_weight(dims, keys, heavy)
    named = [F.col(k).alias(f"__{k}") for k in keys]
    rest = [c for c in right.columns if not c.startswith("__")]
    light = joined(facts_light, dims_light.select(*named, *rest).hint("shuffle_merge"))
    if not heavy:
        return light
    return joined(facts_heavy, F.broadcast(dims_heavy.select(*named, *rest))).unionByName(light)


def member_counts(facts: DataFrame, dims: DataFrame, keys: list[str], size: str, sample: DataFrame | None = None, share: float = 0.01) -> DataFrame:
    """Members per key in ``facts`` beside the ``size`` that ``dims`` states.

    ``dims`` has at most one row per key.  Every key of either side gives one
    row: ``keys``, ``members`` (0 if ``facts`` has none) and ``size`` (null if
    ``dims`` has no row or no value).  Null keys count as a key.  ``sample`` is
    the table on which heavy keys are looked for (default ``facts``): give the
    raw table where ``facts`` is expensive.  Empty tables give empty results.
    """
    heavy = heavy_hitters(facts if sample is None else sample, keys, share)
    flag = F.col("__h").isin(heavy) if heavy else F.lit(False)
    hashed = dims.select(key_hash(keys).alias("__h"), *(F.col(k).alias(f"__{k}") for k in keys), F.col(size).alias("__size"))
    stated_light = hashed.filter(~flag).drop("__h")
    rows_heavy, rows_light = split_by_weight(facts.select(*keys), keys, heavy)

    counted = rows_light.groupBy(*keys).agg(F.count(F.lit(1)).alias("members"), F.lit(True).alias("__here"))
    on = [same(counted[k], stated_light[f"__{k}"]) for k in keys]
    light = counted.join(stated_light, on, "full").select(
        *(F.when(F.col("__here"), F.col(k)).otherwise(F.col(f"__{k}")).alias(k) for k in keys),
        F.coalesce("members", F.lit(0).cast("bigint")).alias("members"),
        F.col("__size").alias(size),
    )
    if not heavy:
        return light
    stated_heavy = hashed.filter(flag).drop("__h")
    on = [same(rows_heavy[k], stated_heavy[f"__{k}"]) for k in keys]
    big = rows_heavy.join(F.broadcast(stated_heavy), on, "left").groupBy(*keys).agg(F.count(F.lit(1)).alias("members"), F.max("__size").alias(size))
    memberless = stated_heavy.join(big.select(*(F.col(k).alias(f"_b_{k}") for k in keys)), [same(F.col(f"__{k}"), F.col(f"_b_{k}")) for k in keys], "left_anti").select(
        *(F.col(f"__{k}").alias(k) for k in keys), F.lit(0).cast("bigint").alias("members"), F.col("__size").alias(size)
    )
    return light.unionByName(big).unionByName(memberless)
