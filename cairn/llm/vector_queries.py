"""Problems 2 and 4 on the reduced vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.markov import Clusters, cluster_vectors, nearest_center
from cairn.llm.neighbours import mutual_neighbours, nearest, usable
from cairn.runtime import durable, latest, read_table

#: The length of a usable vector of svd_100d_features.
DIM = 100


def submission_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """submission_id, v: the standing vector of every submission, usable or not."""
    return latest(read_table(spark, sf_dir, "data_normalized_svd"), ["submission_id"], "loaded_at", ["svd_100d_features"]).select("submission_id", F.col("svd_100d_features").alias("v"))


def local_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name (c<partition>_<position>), v of every local center; a repeated partition row counts once."""
    lists = read_table(spark, sf_dir, "localcentersperpartition").groupBy("partition_id").agg(F.max("centers_list").alias("centers"))
    return lists.select("partition_id", F.posexplode("centers").alias("at", "v")).select(F.concat(F.lit("c"), F.col("partition_id").cast("string"), F.lit("_"), F.col("at").cast("string")).alias("name"), "v")


def named_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = submission_vectors(spark, sf_dir).select(F.concat(F.lit("s"), "submission_id").alias("name"), "v")
    return own.unionByName(local_centers(spark, sf_dir)).filter("name is not null")


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_a, vec_b, cos of the mutual neighbours."""
    return mutual_neighbours(named_vectors(spark, sf_dir), DIM).withColumn("cos", F.round("cos", 6))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_pairs(spark, sf_dir).select("vec_a", "vec_b")


def clusters(spark: SparkSession, sf_dir: str) -> Clusters:
    """The Markov clusters of the usable vectors; members by submission_id."""
    own = durable(submission_vectors(spark, sf_dir).filter(usable(F.col("v"), DIM)).select(F.col("submission_id").alias("id"), "v"))
    return cluster_vectors(own, DIM)


def _with_labels(spark: SparkSession, sf_dir: str, members: DataFrame) -> DataFrame:
    """submission_id, cluster, cos, inflow, cluster_label (stated), majority (label most of the cluster carry, the smaller at a tie)."""
    stated = latest(read_table(spark, sf_dir, "predictions"), ["submission_id"], "loaded_at", ["cluster_label"])
    rows = durable(members.withColumnRenamed("id", "submission_id").join(stated, "submission_id", "left"))
    votes = rows.filter("cluster_label is not null").groupBy("cluster", "cluster_label").agg(F.count(F.lit(1)).alias("n"))
    majority = votes.groupBy("cluster").agg(F.max_by("cluster_label", F.struct("n", -F.col("cluster_label"))).alias("majority"))
    return rows.join(majority, "cluster", "left")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_labels(spark, sf_dir, clusters(spark, sf_dir).members)
    return rows.filter("majority is not null and not cluster_label <=> majority").select("submission_id", F.col("majority").alias("cluster_label"))


def p2_clusters(spark: SparkSession, sf_dir: str, typical: int = 5) -> DataFrame:
    """cluster, size, cluster_label, center_id, center_cos, typical_members.

    ``cluster_label`` is the label most members carry, ``center_id`` the merged
    center nearest to the mean direction (null if no center is usable), and
    ``typical_members`` are those with most flow, then nearest to the mean.
    """
    found = clusters(spark, sf_dir)
    rows = _with_labels(spark, sf_dir, found.members)
    centers = read_table(spark, sf_dir, "mergedcentersfromallblocks").filter(usable(F.col("center_array"), DIM)).select("center_id", F.col("center_array").alias("c"))
    near = nearest_center(found.means, centers, DIM)
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.col("inflow").desc(), F.col("cos").desc(), "submission_id"))
    best = rows.withColumn("place", place).filter(F.col("place") <= typical).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("place", "submission_id"))).alias("m"))
    labels = rows.groupBy("cluster").agg(F.max("majority").alias("cluster_label"))
    return found.means.join(near, "cluster", "left").join(best, "cluster").join(labels, "cluster").select("cluster", "size", "cluster_label", "center_id", "center_cos", F.transform("m", lambda x: x["submission_id"]).alias("typical_members"))


def p4_neighbours(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """The ``k`` most similar vectors of all for every submission whose id is divisible by 20."""
    every = named_vectors(spark, sf_dir)
    asked = submission_vectors(spark, sf_dir).filter(F.col("submission_id").try_cast("bigint") % 20 == 0).select(F.concat(F.lit("s"), "submission_id").alias("name"), "v")
    return nearest(every, asked, DIM, k)


QUERIES = {"p2_found": p2_found, "p2_clusters": p2_clusters, "p4_found": p4_found, "p4_pairs": p4_pairs, "p4_neighbours": p4_neighbours}
#: All pairs: for the small data sets on which rows are compared, not a plan for large ones.
_PAIRS = f"""
WITH s AS (
  SELECT 's' || submission_id AS name, svd_100d_features AS v FROM (
    SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY loaded_at DESC) AS k FROM data_normalized_svd) WHERE k = 1),
l AS (SELECT partition_id, max(centers_list) AS c FROM localcentersperpartition GROUP BY 1),
u AS (
  SELECT name, v FROM (
    SELECT name, v FROM s UNION ALL SELECT 'c' || partition_id || '_' || unnest(range(0, len(c))), unnest(c) FROM l)
  WHERE len(v) = {DIM} AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_max(list_transform(v, lambda x: abs(x))) > 0),
p AS (
  SELECT a.name AS x, b.name AS y, round(list_cosine_similarity(a.v, b.v), 9) AS cos
  FROM u a JOIN u b ON a.name <> b.name AND list_cosine_similarity(a.v, b.v) >= 0.9499999),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY cos DESC, y) AS k FROM p WHERE cos >= 0.95) WHERE k <= 10),
m AS (SELECT a.x AS vec_a, a.y AS vec_b, a.cos FROM r a JOIN r b ON a.x = b.y AND a.y = b.x WHERE a.x < a.y)
"""
SQL = {"p4_found": _PAIRS + "SELECT vec_a, vec_b FROM m", "p4_pairs": _PAIRS + "SELECT vec_a, vec_b, round(cos, 6) AS cos FROM m"}
