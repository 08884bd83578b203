"""Problem 5: members per cluster and partition, though few labels hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.skew import member_counts
from cairn.runtime import latest, read_table

KEYS = ["partition_id", "cluster_label"]


def group_sizes(predictions: DataFrame, clusterstats: DataFrame) -> DataFrame:
    """partition_id, cluster_label, members, cluster_size of every group of either table.

    Standing rows only; rows with a null label belong to no group; a null
    partition is a partition of its own.
    """
    labelled = F.col("cluster_label").isNotNull()
    members = latest(predictions, ["submission_id"], "loaded_at", KEYS).filter(labelled)
    stated = latest(clusterstats.filter(labelled), KEYS, "updated_at", ["cluster_size"])
    return member_counts(members, stated, KEYS, "cluster_size", sample=predictions.filter(labelled))


def p5_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_sizes(read_table(spark, sf_dir, "predictions"), read_table(spark, sf_dir, "clusterstats"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_group_sizes(spark, sf_dir).filter(~F.col("cluster_size").eqNullSafe(F.col("members"))).select(*KEYS)


_SIZES = """
WITH m AS (
  SELECT partition_id, cluster_label, count(*) AS members FROM (
    SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY loaded_at DESC) AS r FROM predictions)
  WHERE r = 1 AND cluster_label IS NOT NULL GROUP BY 1, 2),
s AS (
  SELECT partition_id, cluster_label, cluster_size FROM (
    SELECT *, row_number() OVER (PARTITION BY partition_id, cluster_label ORDER BY updated_at DESC) AS r FROM clusterstats)
  WHERE r = 1 AND cluster_label IS NOT NULL),
g AS (
  SELECT coalesce(m.partition_id, s.partition_id) AS partition_id, coalesce(m.cluster_label, s.cluster_label) AS cluster_label,
         coalesce(members, 0) AS members, cluster_size
  FROM m FULL JOIN s ON m.partition_id = s.partition_id AND m.cluster_label = s.cluster_label)
"""

QUERIES = {"p5_found": p5_found, "p5_group_sizes": p5_group_sizes}
SQL = {
    "p5_found": _SIZES + "SELECT partition_id, cluster_label FROM g WHERE cluster_size IS DISTINCT FROM members",
    "p5_group_sizes": _SIZES + "SELECT partition_id, cluster_label, members, cluster_size FROM g",
}
