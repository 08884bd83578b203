"""Agreement with known labels, cluster reports, and top terms."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def purity(pairs: DataFrame, cluster: str = "cluster", truth: str = "truth") -> DataFrame:
    """One row: purity, the share of rows in the largest class of their cluster; null without rows.

    Rows in which either is null take no part.
    """
    cells = pairs.filter(F.col(cluster).isNotNull() & F.col(truth).isNotNull()).groupBy(cluster, truth).agg(F.count(F.lit(1)).alias("n"))
    return cells.groupBy(cluster).agg(F.max("n").alias("top"), F.sum("n").alias("n")).agg((F.sum("top") / F.sum("n")).alias("purity"))


def adjusted_rand(pairs: DataFrame, cluster: str = "cluster", truth: str = "truth") -> DataFrame:
    """One row: the adjusted Rand index in double arithmetic.

    1 if both partitions are trivial in the same way, null without rows.  One
    contingency count gives all three sums.
    """
    two = lambda n: n * (n - 1.0) / 2.0
    cells = pairs.filter(F.col(cluster).isNotNull() & F.col(truth).isNotNull()).groupBy(F.col(cluster).alias("c"), F.col(truth).alias("t")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    sums = cells.cube("c", "t").agg(F.sum("n").alias("n"), F.grouping_id().alias("g")).agg(
        F.sum(F.when(F.col("g") == 0, two(F.col("n")))).alias("both"), F.sum(F.when(F.col("g") == 1, two(F.col("n")))).alias("a"),
        F.sum(F.when(F.col("g") == 2, two(F.col("n")))).alias("b"), F.max(F.when(F.col("g") == 3, F.col("n"))).alias("n"),
    )
    expected = F.col("a") * F.col("b") / two(F.col("n"))
    most = (F.col("a") + F.col("b")) / 2.0
    trivial = (most == expected) | (F.col("n") < 2)
    return sums.select(F.when(F.col("n").isNull(), None).when(F.col("n") < 2, F.lit(1.0)).when(trivial, F.when(F.col("both") == most, F.lit(1.0))).otherwise((F.col("both") - expected) / F.nullif(most - expected, F.lit(0.0))).alias("ari"))


def run_statistics(runs: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Mean and population standard deviation of repeated runs."""
    return runs.groupBy(*(by or [])).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def cluster_distribution(labels: DataFrame, label: str = "cluster_label") -> DataFrame:
    """label, cluster_size, percent of each label, null included."""
    n = labels.groupBy(label).agg(F.count(F.lit(1)).alias("cluster_size"))
    return n.withColumn("percent", F.col("cluster_size") * 100.0 / F.sum("cluster_size").over(Window.partitionBy()))


def cluster_extremes(labels: DataFrame, k: int, label: str = "cluster_label", warn: float = 5.0) -> DataFrame:
    """One row: largest and smallest label and size (the smaller label at a tie), mean size over ``k`` clusters, ratio, imbalanced."""
    n = labels.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    out = n.agg(
        F.max_by(label, F.struct("n", -F.col(label))).alias("largest"), F.max("n").alias("most"), F.min_by(label, F.struct("n", label)).alias("smallest"), F.min("n").alias("least"),
        (F.sum("n") / float(k)).alias("mean_size"), (F.max("n") / F.min("n")).alias("ratio"),
    )
    return out.withColumn("imbalanced", F.col("ratio") > warn)


def mean_vectors(rows: DataFrame, by: list[str], v: str = "v") -> DataFrame:
    """by, cluster_size, mean: the mean of array<double> vectors, combined in every task before the shuffle."""
    return rows.select(*by, array_to_vector(v).alias("u")).groupBy(*by).agg(F.count(F.lit(1)).alias("cluster_size"), Summarizer.mean(F.col("u")).alias("m")).select(*by, "cluster_size", vector_to_array("m").alias("mean"))


def mean_entries(entries: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    """by, term_index, weight: the mean of sparse rows in long form, absent entries being zero.

    ``entries``: by, term_index, value.  ``sizes``: by, cluster_size.  Only
    entries are moved, never dense vectors.
    """
    sums = entries.groupBy(*by, "term_index").agg(F.sum("value").alias("s"))
    if not by:
        n = sizes.first()  # one row
        return sums.select("term_index", (F.col("s") / F.lit(n["cluster_size"] if n else None)).alias("weight"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by]
    right = sizes.select(*(F.col(k).alias(f"__{k}") for k in by), "cluster_size")
    return sums.join(right, on).select(*by, "term_index", (F.col("s") / F.col("cluster_size")).alias("weight"))


def ranked_terms(weights: DataFrame, by: list[str], n: int, codes: DataFrame | None = None, positive: bool = True, code: str = "term_code") -> DataFrame:
    """by, term_rank, term_index, weight and the code of the ``n`` greatest weights.

    Equal weights in order of term_index; a term without a code is
    ``unknown_<index>``.  ``positive`` leaves out weights that are not above 0.
    """
    rows = weights.filter("weight > 0") if positive else weights.filter("weight is not null")
    order = Window.partitionBy(*by).orderBy(F.col("weight").desc(), "term_index")
    best = rows.withColumn("term_rank", F.row_number().over(order)).filter(F.col("term_rank") <= n).select(*by, "term_rank", "term_index", "weight")
    if codes is None:
        return best
    one = codes.groupBy("term_index").agg(F.min(code).alias(code))
    return best.join(one, "term_index", "left").select(*by, "term_rank", "term_index", "weight", F.coalesce(code, F.concat(F.lit("unknown_"), F.col("term_index").cast("string"))).alias(code))


def merge_dictionary(terms: DataFrame, dictionary: DataFrame, key: str = "term_code") -> DataFrame:
    """``terms`` with the dictionary's columns; terms it lacks are dropped, repeated dictionary rows count once."""
    return terms.join(dictionary.dropDuplicates(), key)


def sample_rows(df: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """The first ``n`` rows in ``order``, for inspection."""
    return df.orderBy(*order).limit(n)


def vector_profile(kinds: DataFrame) -> DataFrame:
    """kind, n, least, most, mean size of a table with columns kind and size."""
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("least"), F.max("size").alias("most"), F.avg("size").alias("mean"))


def describe_column(c: str) -> list[Column]:
    """count, mean, sample deviation, least and most of a column."""
    return [F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("stddev"), F.min(c).alias("least"), F.max(c).alias("most")]
