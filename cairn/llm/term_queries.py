"""Problems 1 and 3 on the document-term tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.vectors import nonzero_entries
from cairn.llm.term_counts import mark_terms, term_counts
from cairn.llm.top_items import top_items
from cairn.runtime import latest, read_table


def p1_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """term_index, total, records, mark of every term of the dictionary and of the matrix."""
    standing = latest(read_table(spark, sf_dir, "r2012_01"), ["submission_id"], "loaded_at", ["features"]).filter("features is not null")
    entries = standing.select("submission_id", nonzero_entries(F.col("features")).alias("e"))
    counts = term_counts(entries, "submission_id", F.col("e.term_index"), F.col("e.value"), "int")
    dictionary = read_table(spark, sf_dir, "termstats").select(F.col("term_index").alias("term")).distinct()
    return mark_terms(counts, dictionary).withColumnRenamed("term", "term_index")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_term_stats(spark, sf_dir).filter("mark is not null").select("term_index", "mark")


def p3_top_terms(spark: SparkSession, sf_dir: str, n: int = 20) -> DataFrame:
    """partition_id, cluster_label, term_rank, term_index, weight, term_code of the ``n`` heaviest terms."""
    groups = ["partition_id", "cluster_label"]
    # a delivery's items are ranked where they are read, so only n of them meet the other deliveries of the group
    rows = read_table(spark, sf_dir, "clusterstats").select(F.monotonically_increasing_id().alias("delivery"), *groups, "updated_at", "tfidf_mean")
    items = rows.filter("tfidf_mean is not null").select("delivery", F.explode(nonzero_entries(F.col("tfidf_mean"))).alias("e")).select("delivery", "e.term_index", F.col("e.value").alias("weight")).filter("weight > 0")
    best = top_items(items, ["delivery"], [F.col("weight").desc(), F.col("term_index")], n, "term_rank")
    standing = latest(rows, groups, "updated_at", ["delivery"])
    best = best.join(standing, "delivery")
    codes = read_table(spark, sf_dir, "valid_terms").groupBy("term_index").agg(F.min("term_code").alias("term_code"))
    code = F.coalesce("term_code", F.concat(F.lit("unknown_"), F.col("term_index").cast("string")))
    return best.join(codes, "term_index", "left").select(*groups, "term_rank", "term_index", "weight", code.alias("term_code"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_top_terms(spark, sf_dir).select("partition_id", "cluster_label", "term_rank", "term_code")


_TERMS = """
WITH r AS (
  SELECT submission_id, features AS f FROM (
    SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY loaded_at DESC) AS k FROM r2012_01)
  WHERE k = 1 AND features IS NOT NULL),
e AS (
  SELECT submission_id, unnest(CASE WHEN f.kind = 1 THEN range(0, len(f.vals)) ELSE f.idx END)::INTEGER AS term_index, unnest(f.vals) AS value FROM r),
d AS (
  SELECT term_index, sum(value) AS total, count(DISTINCT submission_id) AS records FROM e WHERE value <> 0 AND term_index IS NOT NULL GROUP BY 1),
a AS (
  SELECT term_index, coalesce(max(total), 0) AS total, coalesce(max(records), 0) AS records FROM (
    SELECT term_index, total, records FROM d UNION ALL SELECT term_index, NULL, NULL FROM termstats WHERE term_index IS NOT NULL) GROUP BY 1),
t AS (
  SELECT term_index, total, records,
         CASE WHEN records * 1000 < 2 * (SELECT count(*) FROM r) THEN 'rare' WHEN records * 2 > (SELECT count(*) FROM r) THEN 'common' END AS mark FROM a)
"""
_TOP = """
WITH s AS (
  SELECT partition_id, cluster_label, tfidf_mean AS f FROM (
    SELECT *, row_number() OVER (PARTITION BY partition_id, cluster_label ORDER BY updated_at DESC) AS k FROM clusterstats)
  WHERE k = 1 AND tfidf_mean IS NOT NULL),
e AS (
  SELECT partition_id, cluster_label, unnest(CASE WHEN f.kind = 1 THEN range(0, len(f.vals)) ELSE f.idx END)::INTEGER AS term_index, unnest(f.vals) AS weight FROM s),
n AS (
  SELECT *, row_number() OVER (PARTITION BY partition_id, cluster_label ORDER BY weight DESC, term_index)::INTEGER AS term_rank FROM e WHERE weight > 0),
c AS (SELECT term_index, min(term_code) AS term_code FROM valid_terms GROUP BY 1),
t AS (
  SELECT partition_id, cluster_label, term_rank, n.term_index, weight, coalesce(term_code, 'unknown_' || n.term_index) AS term_code
  FROM n LEFT JOIN c ON n.term_index = c.term_index WHERE term_rank <= 20)
"""

QUERIES = {"p1_found": p1_found, "p1_term_stats": p1_term_stats, "p3_found": p3_found, "p3_top_terms": p3_top_terms}
SQL = {
    "p1_found": _TERMS + "SELECT term_index, mark FROM t WHERE mark IS NOT NULL",
    "p1_term_stats": _TERMS + "SELECT term_index, total, records, mark FROM t",
    "p3_found": _TOP + "SELECT partition_id, cluster_label, term_rank, term_code FROM t",
    "p3_top_terms": _TOP + "SELECT * FROM t",
}
