"""Random sample blocks, observers, and per-block application.

A data set is cut into blocks by a hash of its id, so that a block is a random
sample whatever the physical partitions are, and the same on every run.  A
*local* operation works on each block by itself, a *global* one on the small
results of all blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.runtime import numbered


def hash_number(*parts: Column | str | int) -> Column:
    """A 32-bit number from the md5 of the parts' text, joined by colons."""
    text = F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def with_block(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``df`` with ``block_id`` in 0..n-1; a null key goes to the block of the empty text."""
    if n < 1:
        raise ValueError("there must be at least one block")
    return df.withColumn("block_id", (hash_number(seed, F.coalesce(F.col(key).cast("string"), F.lit(""))) % n).cast("int"))


def file_blocks(df: DataFrame, path: Column) -> DataFrame:
    """``df`` with ``block_id`` counting its files in order of their paths."""
    order = numbered(df.select(path.alias("__path")).distinct(), ["__path"], "block_id")
    return df.withColumn("__path", path).join(order, "__path").drop("__path")


def block_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("block_id").agg(F.count(F.lit(1)).alias("n_rows"))


def first_blocks(df: DataFrame, n: int) -> DataFrame:
    return df.filter(F.col("block_id") < n)


def one_block(df: DataFrame, block: int) -> DataFrame:
    return df.filter(F.col("block_id") == block)


def choose_blocks(df: DataFrame, n: int, q: int, seed: int = 0) -> DataFrame:
    """The rows of ``q`` of the blocks 0..n-1, chosen at random by ``seed``, renumbered from 0."""
    if not 0 < q <= n:
        raise ValueError("q must lie between 1 and n")
    order = Window.orderBy(hash_number("choose", seed, F.col("id")), "id")
    chosen = df.sparkSession.range(n).select(F.col("id").cast("int").alias("block_id"), (F.row_number().over(order) - 1).cast("int").alias("new")).filter(F.col("new") < q)
    return df.join(F.broadcast(chosen), "block_id").drop("block_id").withColumnRenamed("new", "block_id")  # q rows


def large_blocks(df: DataFrame, least: int = 2) -> DataFrame:
    """The rows of the blocks with at least ``least`` rows."""
    return df.join(block_sizes(df).filter(F.col("n_rows") >= least).select("block_id"), "block_id", "left_semi")


def pack_blocks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """block_id, rows: the block's rows as one ordered array of structs (a block must fit one row)."""
    return df.groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rows"))


def unpack_blocks(packed: DataFrame) -> DataFrame:
    return packed.select("block_id", F.explode("rows").alias("r")).select("block_id", "r.*")


def local_op(df: DataFrame, keys: Sequence[str], f: Callable[[tuple, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``f`` applied to each group of ``keys``, with a column ``error``.

    A group on which ``f`` raises gives one row with null results and the
    message in ``error``; the others are not affected.
    """
    shape = T._parse_datatype_string(schema)
    names = [x.name for x in shape.fields]
    key_fields = [df.schema[k] for k in keys]
    out = T.StructType([*key_fields, *shape.fields, T.StructField("error", T.StringType())])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        try:
            got = f(key, rows)[names].copy()
            got["error"] = None
        except Exception as e:  # one bad block must not end the job
            got = pd.DataFrame({n: [None] for n in names})
            got["error"] = f"{type(e).__name__}: {e}"[:200]
        for i, k in enumerate(keys):
            got.insert(i, k, key[i])
        return got

    return df.groupBy(*keys).applyInPandas(run, out)


def global_op(local: DataFrame, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``f`` of the results of all blocks that did not fail."""
    return f(local.filter("error is null").drop("error") if "error" in local.columns else local)


def sample_observers(points: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """block_id, observer_id, observer_v: ``n`` of each block's points, without replacement.

    The choice follows the md5 of seed and id.  A block with fewer points gives
    all of them.  No more than ``n`` rows per block and task are shuffled.
    """
    order = Window.partitionBy("block_id").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))), "id")
    return points.select("block_id", "id", "v").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= n).select("block_id", (F.col("r") - 1).alias("observer_id"), F.col("v").alias("observer_v"))


def grid_observers(points: DataFrame, n: int, dim: int, seed: int = 0) -> DataFrame:
    """block_id, observer_id, observer_v: ``n`` grid points of each block's bounding box.

    Each dimension has ceil(n ** (1 / dim)) evenly spaced steps including both
    ends, the first dimension varying slowest; the first ``n`` distinct points
    are taken.  Where a box is flat and has fewer of them, points of the box
    drawn from ``seed`` fill up to ``n``.  The numbers are an order drawn from
    ``seed``.  Above eight dimensions only the last ones of the grid would vary:
    sample observers there.
    """
    steps = max(2, math.ceil(round(n ** (1 / dim), 9)))
    ends = points.groupBy("block_id").agg(*(f(F.get("v", F.lit(d))).alias(f"{e}{d}") for d in range(dim) for e, f in (("lo", F.min), ("hi", F.max))))
    cells = ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(min(n, steps**dim) - 1))).alias("k"))
    digit = lambda d: F.floor(F.col("k") / min(steps ** (dim - 1 - d), 2**62)) % steps
    at = F.array(*(F.col(f"lo{d}") + (F.col(f"hi{d}") - F.col(f"lo{d}")) * digit(d) / float(steps - 1) for d in range(dim)))
    grid = cells.select("block_id", F.col("k").cast("int").alias("k"), at.alias("observer_v")).groupBy("block_id", "observer_v").agg(F.min("k").alias("k"))
    lacking = grid.groupBy("block_id").agg(F.count(F.lit(1)).alias("have")).filter(F.col("have") < n).join(ends, "block_id").select("*", F.explode(F.sequence(F.col("have"), F.lit(n - 1))).alias("j"))
    share = lambda d: (hash_number("fill", seed, F.col("block_id"), F.col("j"), d) + 0.5) / float(2**32)
    drawn = F.array(*(F.col(f"lo{d}") + (F.col(f"hi{d}") - F.col(f"lo{d}")) * share(d) for d in range(dim)))
    grid = grid.unionByName(lacking.select("block_id", drawn.alias("observer_v"), (F.lit(2**30) + F.col("j")).cast("int").alias("k")))
    order = Window.partitionBy("block_id").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("k").cast("string"))), "k")
    return grid.select("block_id", (F.row_number().over(order) - 1).alias("observer_id"), "observer_v")


def gaussian_clusters(spark: SparkSession, centers: Sequence[Sequence[float]], per_center: int, sigma: float, seed: int = 42) -> DataFrame:
    """id, v, label: ``per_center`` normal points around each center; the same for the same seed."""
    k, dim = len(centers), len(centers[0])
    u = lambda d, part: (hash_number(seed, F.col("id"), d, part) + 0.5) / float(2**32)
    normal = lambda d: F.sqrt(-2.0 * F.log(u(d, "r"))) * F.cos(2 * math.pi * u(d, "a"))
    mean = F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in centers))
    label = (F.col("id") % k).cast("int")
    return spark.range(k * per_center).select("id", F.array(*(mean[label][d] + sigma * normal(d) for d in range(dim))).alias("v"), label.alias("label"))


def gaussian_datasets(spark: SparkSession, n: int, per_center: int = 20, seed: int = 42) -> DataFrame:
    """block_id, id, v, label: ``n`` small plane data sets of two or three unit normal clusters each.

    The centers of a data set lie about (10 c, 10 c), each coordinate up to 2
    further; the same for the same seed.
    """
    u = lambda *parts: (hash_number(seed, *parts) + 0.5) / float(2**32)
    sets = spark.range(n).select(F.col("id").cast("int").alias("block_id"), (2 + hash_number(seed, "clusters", F.col("id")) % 2).cast("int").alias("k"))
    rows = sets.select("block_id", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("label")).select("*", F.explode(F.sequence(F.lit(0), F.lit(per_center - 1))).alias("p"))
    normal = lambda d: F.sqrt(-2.0 * F.log(u("r", F.col("block_id"), F.col("label"), F.col("p"), d))) * F.cos(2 * math.pi * u("a", F.col("block_id"), F.col("label"), F.col("p"), d))
    v = F.array(*(10.0 * F.col("label") + 2.0 * u("c", F.col("block_id"), F.col("label"), d) + normal(d) for d in range(2)))
    return rows.select("block_id", (F.col("label") * per_center + F.col("p")).cast("bigint").alias("id"), v.alias("v"), "label")
