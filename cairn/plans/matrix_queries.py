"""Queries of the document-term, reduction, reporting and file operators, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import vectors as V
from cairn.operators import blocks as B
from cairn.operators import evaluate as E
from cairn.operators import kmeans as K
from cairn.operators import reduce as R
from cairn.operators import terms as T
from cairn.plans import pipelines
from cairn.plans.cluster_queries import points, r6
from cairn.runtime import durable, latest, read_table, shared_dir
from cairn.sources import files as S
from cairn.streaming import fold

MIN_DF, MAX_DF, RATIO, MIN_VAR = 5, 400, 0.3, 1e-6
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
#: Literal singular values on which the rank rules are compared with SQL.
SIGMA = [9.0, 7.5, 4.0, 3.5, 1.2, 0.9, 0.5, 0.4, 0.2, 0.1]


def documents(s: SparkSession, d: str) -> DataFrame:
    """doc_id, features of the standing submissions with a vector."""
    return latest(read_table(s, d, "r2012_01"), ["submission_id"], "loaded_at", ["features"]).filter("features is not null").withColumnRenamed("submission_id", "doc_id")


def entries(s: SparkSession, d: str) -> DataFrame:
    return documents(s, d).select("doc_id", F.explode(V.nonzero_entries(F.col("features"))).alias("e")).select("doc_id", "e.term_index", "e.value")


def labelled_entries(s: SparkSession, d: str) -> DataFrame:
    """partition_id, cluster_label, doc_id, term_index, value of the submissions with a label."""
    labels = latest(read_table(s, d, "predictions"), ["submission_id"], "loaded_at", ["partition_id", "cluster_label"]).filter("cluster_label is not null").withColumnRenamed("submission_id", "doc_id")
    return entries(s, d).join(labels, "doc_id")


def labelled_sizes(s: SparkSession, d: str, by: list[str]) -> DataFrame:
    labels = latest(read_table(s, d, "predictions"), ["submission_id"], "loaded_at", ["partition_id", "cluster_label"]).filter("cluster_label is not null").withColumnRenamed("submission_id", "doc_id")
    return documents(s, d).select("doc_id").join(labels, "doc_id").groupBy(*by).agg(F.count(F.lit(1)).alias("cluster_size"))


_E = """
WITH r AS (SELECT submission_id AS doc_id, features AS f FROM (SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY loaded_at DESC) AS k FROM r2012_01) WHERE k = 1 AND features IS NOT NULL),
e AS (SELECT * FROM (SELECT doc_id, unnest(CASE WHEN f.kind = 1 THEN range(0, len(f.vals)) ELSE f.idx END)::INTEGER AS term_index, unnest(f.vals) AS value FROM r) WHERE value <> 0),
df AS (SELECT term_index, count(DISTINCT doc_id) AS doc_freq, sum(value) AS s, sum(value * value) AS q, count(*) AS n FROM e GROUP BY 1),
va AS (SELECT *, CASE WHEN n > 1 THEN greatest(0, q - s * s / n) / (n - 1) ELSE 0 END AS variance FROM df)
"""
_VALID = _E + f", v AS (SELECT term_index, (row_number() OVER (ORDER BY term_index) - 1)::INTEGER AS new_index, doc_freq, variance FROM va WHERE doc_freq BETWEEN {MIN_DF} AND {MAX_DF} AND variance >= {MIN_VAR})"
_RATIO = _E + f", v AS (SELECT term_index, (row_number() OVER (ORDER BY term_index) - 1)::INTEGER AS new_index, doc_freq, variance FROM va WHERE doc_freq BETWEEN {MIN_DF} AND greatest({MIN_DF}, floor((SELECT count(DISTINCT doc_id) FROM e) * {RATIO})) AND variance >= {MIN_VAR})"
_LAB = _E + ", l AS (SELECT submission_id AS doc_id, partition_id, cluster_label FROM (SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY loaded_at DESC) AS k FROM predictions) WHERE k = 1 AND cluster_label IS NOT NULL), n AS (SELECT partition_id, cluster_label, count(*) AS cluster_size FROM r JOIN l USING (doc_id) GROUP BY 1, 2), nl AS (SELECT cluster_label, sum(cluster_size) AS cluster_size FROM n GROUP BY 1), c AS (SELECT term_index, min(term_code) AS term_code FROM valid_terms GROUP BY 1)"


def df_percentiles(s, d):
    f = T.document_frequency(entries(s, d))
    a = T.frequency_percentiles(f).withColumn("low", F.lit(0.05)).withColumn("high", F.lit(0.95))
    return a.unionByName(T.frequency_percentiles(f, 0.1, 0.9).withColumn("low", F.lit(0.1)).withColumn("high", F.lit(0.9)))


def percentile_details(s, d):
    return T.percentile_details(durable(T.document_frequency(entries(s, d)))).select("total_terms", "low_freq", "high_freq", "kept", "removed_low", "removed_high", "removed", *r6("kept_share", "mean"), "least", "most")


def filter_compact(s, d):
    e = durable(entries(s, d))
    return T.term_filter(e, MIN_DF, MIN_VAR, max_df=MAX_DF)[0]


def filter_by_ratio(s, d):
    e = durable(entries(s, d))
    return T.term_filter(e, MIN_DF, MIN_VAR, max_ratio=RATIO)[0]


def filter_same_size(s, d):
    e = entries(s, d)
    return T.filter_same_size(e, T.valid_terms(e, MIN_DF, MAX_DF, MIN_VAR))


def filter_keep_empty(s, d):
    return T.with_all_documents(filter_same_size(s, d), documents(s, d))


def wide_to_sparse(s, d):
    t = read_table(s, d, "lineitem").withColumn("key", F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    words = s.createDataFrame([(i, w) for i, w in enumerate(sorted([*NUMBERS, "l_linenumber"]))], "term_index int, original_word string")
    return T.wide_to_entries([(t.select("key", *NUMBERS), "key"), (t.select("key", "l_linenumber", "l_shipdate"), "key")], words).select("doc_id", "term_index", *r6("value"))


def l2_normalise(s, d):
    return T.l2_normalised(entries(s, d)).select("doc_id", "term_index", *r6("value"))


def doc_length_stats(s, d):
    return T.length_summary(T.document_lengths(entries(s, d))).select("documents", *r6("mean", "stddev"), "least", "most")


def standard_scale(s, d):
    t = read_table(s, d, "lineitem").select("l_orderkey", "l_linenumber", *NUMBERS)
    return R.standard_scaled(t, NUMBERS).select("l_orderkey", "l_linenumber", *r6(*NUMBERS))


def scaled_embedding(s, d):
    return R.scaled_vectors(points(s, d)).select("id", F.posexplode("v").alias("dim", "x")).select("id", "dim", *r6("x"))


def _scree(s):
    return R.scree(R.sigma_table(s, SIGMA))


def singular_value_trace(s, d):
    p = points(s, d)
    values, _ = R.singular_values(p, 64)
    return s.createDataFrame([(float((values**2).sum()),)], "total double").select(F.round("total", 4).alias("total"))


def svd_projection(s, d):
    p = points(s, d)
    values, right = R.singular_values(p, 10)
    return R.project(p, values, right).select(F.round(F.aggregate(F.transform("u", lambda x: x * x), F.lit(0.0), lambda a, x: a + x), 6).alias("norm2"), "id")


def rank_and_elbows(s, d):
    rank, elbow = pipelines.rank_report(points(s, d))
    r = rank.first()
    return elbow.withColumn("k", F.lit(r["k"])).withColumn("reached", F.round(F.lit(r["reached"]), 6))


def top_terms(s, d):
    w = E.mean_entries(labelled_entries(s, d), labelled_sizes(s, d, ["cluster_label"]), ["cluster_label"])
    return E.ranked_terms(w.withColumn("weight", F.round("weight", 9)), ["cluster_label"], 20, read_table(s, d, "valid_terms"))


def top_terms_per_partition(s, d):
    by = ["partition_id", "cluster_label"]
    w = E.mean_entries(labelled_entries(s, d), labelled_sizes(s, d, by), by)
    return E.ranked_terms(w.withColumn("weight", F.round("weight", 9)), by, 5, read_table(s, d, "valid_terms"))


def top_terms_corpus(s, d):
    n = documents(s, d).agg(F.count(F.lit(1)).alias("cluster_size"))
    w = E.mean_entries(entries(s, d), n, [])
    return E.ranked_terms(w.withColumn("weight", F.round("weight", 9)), [], 100, read_table(s, d, "valid_terms"))


def partition_cluster_stats(s, d):
    by = ["partition_id", "cluster_label"]
    return E.mean_entries(labelled_entries(s, d), labelled_sizes(s, d, by), by).select(*by, "term_index", *r6("weight"))


def dictionary_merge(s, d):
    codes = T.code_dictionary(read_table(s, d, "valid_terms"))
    return E.merge_dictionary(top_terms_corpus(s, d), codes.select("term_code", "original_word"))


def zero_rows(s, d):
    return read_table(s, d, "lineitem").agg(F.count_if(V.all_zero(["l_discount", "l_tax"])).alias("n"))


def empty_vectors(s, d):
    every = latest(read_table(s, d, "r2012_01"), ["submission_id"], "loaded_at", ["features"])
    return every.agg(F.count_if(F.coalesce(F.size(V.nonzero_entries(F.col("features"))), F.lit(0)) == 0).alias("n"))


def vec_profile(s, d):
    t = read_table(s, d, "r2012_01")
    return t.select(V.vector_kind(t, "features").alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def dense_vectors(s, d):
    t = read_table(s, d, "clusterstats").select("partition_id", "cluster_label", "updated_at", V.vec_to_array(F.col("tfidf_mean")).alias("v"))
    return t.groupBy("partition_id", "cluster_label").agg(F.max(F.size("v")).alias("size"), F.round(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)), 6).alias("total"))


def nested_centers(s, d):
    t = read_table(s, d, "localcentersperpartition").distinct()
    return S.nested_centers(t).select("partition_id", "center_index", F.posexplode("center_values").alias("dim", "x")).select("partition_id", "center_index", "dim", *r6("x"))


def stored_merge_stats(s, d):
    t = read_table(s, d, "localcentersperpartition").groupBy("partition_id").agg(F.max("centers_list").alias("centers_list"))
    return pipelines.stored_statistics(t, 0.9).select("partitions", "local_centers", "total", "average", "merged", *r6("ratio", "reduction"))


def stored_merge(s, d):
    t = read_table(s, d, "localcentersperpartition").groupBy("partition_id").agg(F.max("centers_list").alias("centers_list"))
    return pipelines.stored_merge(t, 0.9).select("pos", "block_id", "center_idx")


def streamed_merge(s, d):
    """The same merge by a stream of files, one block and one batch each: the centers kept after each."""
    t = read_table(s, d, "localcentersperpartition").groupBy("partition_id").agg(F.max("centers_list").alias("centers_list"))
    at = f"{shared_dir(s)}/cairn/{uuid.uuid4().hex}"
    flat = t.select(F.col("partition_id").alias("block_id"), F.posexplode("centers_list").alias("center_index", "center"))
    S.write_arrivals(flat, "block_id", f"{at}/in")
    stream = s.readStream.schema(flat.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{at}/in")
    fold.fold_stream(stream, f"{at}/state", f"{at}/log", 0.9).awaitTermination()
    return fold.fold_report(s, f"{at}/state")


def _folder(s) -> str:
    return f"{shared_dir(s)}/cairn/{uuid.uuid4().hex}"


def io_matrix(s, d):
    """Points written as a headerless CSV matrix and read back."""
    at = _folder(s)
    S.write_matrix(points(s, d), at)
    return S.read_matrix(s, at).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.get("v", F.lit(0))), 4).alias("first"), F.round(F.sum(F.get("v", F.lit(63))), 4).alias("last"))


def io_block_folder(s, d):
    """One CSV file per block, read as a folder of blocks."""
    at = _folder(s)
    S.write_block_folder(B.with_block(points(s, d), "id", 4), 4, at)
    return B.block_sizes(S.read_block_folder(s, at))


def io_labels(s, d):
    at = _folder(s)
    S.write_lines(points(s, d), "label", at)
    return S.read_labels(s, at).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def io_partitioned(s, d):
    """Blocks written in one pass, one folder each, and one of them read with partition pruning."""
    at = _folder(s)
    S.write_parquet(B.with_block(points(s, d), "id", 4).select("id", "block_id"), at, blocks=True)
    return B.one_block(s.read.parquet(at), 1).select("id", F.col("block_id").cast("int").alias("block_id"))


def io_csv_report(s, d):
    """A report with fixed decimals written as CSV with a header and read back."""
    at = _folder(s)
    S.write_csv(S.fixed_decimals(points(s, d).groupBy("label").agg(F.avg(F.get("v", F.lit(0))).alias("x")), ["x"]), at)
    return S.read_csv(s, at, header=True).select(F.col("label").cast("int").alias("label"), F.col("x"))


def io_exploded(s, d):
    at = _folder(s)
    S.write_csv(S.exploded_elements(points(s, d).select("id", "v"), "v", 64), at, header=False)
    t = S.read_csv(s, at, infer=True)
    return t.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("_c1"), 4).alias("first"))


def scatter_rows(s, d):
    return S.scatter(points(s, d), points(s, d).filter("id < 5").select(F.col("v").alias("center"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 5).alias("x"), F.round(F.sum("y"), 5).alias("y"))


def synthetic_blocks(s, d):
    """Four normal clusters in five blocks: a constant input, the sizes per block and label."""
    g = B.gaussian_clusters(s, [[10.0 * c, 10.0 * c] for c in range(4)], 250, 1.5)
    return B.with_block(g, "id", 5).groupBy("block_id", "label").agg(F.count(F.lit(1)).alias("n"))


def corpus_report(s, d):
    """The summary of the document lengths, beside the code of the corpus' first term."""
    top, lengths = pipelines.corpus_report(entries(s, d), documents(s, d), read_table(s, d, "valid_terms"))
    return lengths.select("documents", *r6("mean", "stddev"), "least", "most").withColumn("first_term", F.lit(top.filter("term_rank = 1").first()["term_code"]))


def term_filter_report(s, d):
    kept, valid = pipelines.term_filter_report(durable(entries(s, d)), read_table(s, d, "valid_terms"), MIN_DF, RATIO)
    return valid.select("term_index", "new_index", "original_word", "doc_freq")


def seeded_kmeans_report(s, d):
    """Size and share of the clusters that k-means from the stored merged centers finds."""
    c = read_table(s, d, "mergedcentersfromallblocks").filter("center_array is not null")
    start = K.center_matrix(c.select("center_id", F.col("center_array").alias("center")), order=["center_id"])
    v = latest(read_table(s, d, "data_normalized_svd"), ["submission_id"], "loaded_at", ["svd_100d_features"]).filter(F.size("svd_100d_features") == start.shape[1])
    p = durable(v.select(F.xxhash64("submission_id").alias("id"), F.col("svd_100d_features").alias("v")))
    _, sizes, cost = pipelines.seeded_kmeans_report(p, start)
    return sizes.select("label", "cluster_size", *r6("percent")).withColumn("cost", F.round(F.lit(cost), 6))


def monthly_reconstruction(s, d):
    """lineitem's numbers by month of shipping, as wide chunks put into one long table."""
    t = read_table(s, d, "lineitem").withColumn("key", F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    words = s.createDataFrame([(0, "l_discount"), (1, "l_tax")], "term_index int, original_word string")
    month = lambda m: t.filter(F.date_format("l_shipdate", "yyyy-MM") == m)
    months = [r["month"] for r in T.month_list("2000-01", "2000-03", s).orderBy("month").collect()]
    out = pipelines.monthly_reconstruction(s, months, lambda m: [(month(m).select("key", "l_discount"), "key"), (month(m).select("key", "l_tax"), "key")], words)
    return out.groupBy("month", "term_index").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def monthly_reconstruction_all(s, d):
    """The same for every month of the table, in one pass: the month leads the key."""
    t = read_table(s, d, "lineitem").filter("l_shipdate is not null").withColumn("key", F.concat_ws(":", F.date_format("l_shipdate", "yyyy-MM"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    words = s.createDataFrame([(0, "l_discount"), (1, "l_tax")], "term_index int, original_word string")
    out = T.wide_to_entries([(t.select("key", "l_discount"), "key"), (t.select("key", "l_tax"), "key")], words)
    return out.groupBy(F.substring_index("doc_id", ":", 1).alias("month"), "term_index").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def first_block_centers(s, d):
    """Stored local centers of the first three blocks."""
    t = read_table(s, d, "localcentersperpartition").groupBy("partition_id").agg(F.max("centers_list").alias("centers_list"))
    return B.first_blocks(S.nested_centers(t).withColumnRenamed("partition_id", "block_id"), 3).groupBy("block_id").agg(F.count(F.lit(1)).alias("n_centers"), F.max("center_index").alias("last"))


def normalised_documents(s, d):
    """Filtered, normalised documents reduced to ten dimensions: sizes and norms per document."""
    kept, valid = T.term_filter(durable(entries(s, d)), MIN_DF, MIN_VAR, max_ratio=RATIO)
    unit = T.l2_normalised(kept)
    size = valid.count()
    v = _sparse_documents(unit)
    values, right = R.sparse_singular_values(v, size, 10)
    return R.sparse_project(v, values, right).select("id", F.transform("u", lambda x: F.round(x, 6)).alias("u"))


def _sparse_documents(unit: DataFrame) -> DataFrame:
    """id, doc_id, idx, vals of the documents' entries."""
    rows = unit.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("term_index", "value"))).alias("e"))
    return durable(rows.select(F.xxhash64("doc_id").alias("id"), "doc_id", F.col("e.term_index").alias("idx"), F.col("e.value").alias("vals")))


def flagship(s, d):
    """cluster, size, top_code: documents through the whole flow, from the term filter to the clusters' top terms."""
    kept, valid = T.term_filter(durable(entries(s, d)), 3, MIN_VAR, max_ratio=0.5)
    unit = durable(T.l2_normalised(kept))
    size = valid.count()
    v = _sparse_documents(unit)
    plan = pipelines.Plan(2, 2, n_observers=2, knn=3, selection="window", merge_all=("keep_first", 0.3), fit={"delta": 2})
    out = pipelines.sparse_flow(v, size, plan, 5)
    ids = v.select("id", "doc_id")
    if out.labels is None:
        return s.createDataFrame([], "cluster int, size bigint, top_code string")
    labels = out.labels.join(ids, "id").select("doc_id", F.col("label").alias("cluster"))
    sizes = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("cluster_size"))
    old = valid.select(F.col("new_index").alias("term_index"), F.col("term_index").alias("old"))
    weights = E.mean_entries(unit.join(labels, "doc_id"), sizes, ["cluster"]).join(old, "term_index").select("cluster", F.col("old").alias("term_index"), "weight")
    top = E.ranked_terms(weights, ["cluster"], 1, read_table(s, d, "valid_terms"))
    return sizes.join(top, "cluster", "left").select("cluster", F.col("cluster_size").alias("size"), F.col("term_code").alias("top_code"))


QUERIES = {
    "doc_freq": lambda s, d: T.document_frequency(entries(s, d)),
    "doc_freq_zero_filled": lambda s, d: T.document_frequency_filled(entries(s, d), 3020),
    "term_moments": lambda s, d: T.term_moments(entries(s, d)).select("term_index", *r6("sum_values", "sum_squares"), "count"),
    "term_stats": lambda s, d: T.term_statistics(entries(s, d), 3020).select("term_index", *r6("mean", "variance", "std_dev", "sum_values", "sum_squares"), "count"),
    "df_percentiles": df_percentiles, "df_percentile_details": percentile_details,
    "term_counts": lambda s, d: T.kept_counts(T.document_frequency(entries(s, d)), MIN_DF, MAX_DF),
    "valid_terms_abs": lambda s, d: T.valid_terms(entries(s, d), MIN_DF, MAX_DF, MIN_VAR).select("term_index", "new_index", "doc_freq", *r6("variance")),
    "valid_terms_ratio": lambda s, d: T.valid_terms_by_ratio(entries(s, d), MIN_DF, RATIO, MIN_VAR, entries(s, d).select("doc_id").distinct().count()).select("term_index", "new_index", "doc_freq", *r6("variance")),
    "filter_compact": filter_compact, "filter_by_ratio": filter_by_ratio, "filter_same_size": filter_same_size, "filter_keep_empty": filter_keep_empty,
    "dictionary_alpha": lambda s, d: T.alphabetical_dictionary(read_table(s, d, "valid_terms")),
    "dictionary_code": lambda s, d: T.code_dictionary(read_table(s, d, "valid_terms")),
    "dictionary_merge": dictionary_merge, "wide_to_sparse": wide_to_sparse, "l2_normalise": l2_normalise, "doc_length_stats": doc_length_stats,
    "doc_density": lambda s, d: T.density_percent(T.document_lengths(entries(s, d)), 3020).select("doc_id", "n_terms", *r6("density")),
    "month_list": lambda s, d: T.month_list("2005-12", "2007-02", s), "zero_rows": zero_rows, "empty_vectors": empty_vectors, "vec_profile": vec_profile, "dense_vectors": dense_vectors,
    "standard_scale": standard_scale, "scaled_embedding": scaled_embedding,
    "scree": lambda s, d: _scree(s).select("k", *r6("variance", "individual_variance_ratio", "cumulative_variance_ratio")),
    "rank_by_variance": lambda s, d: R.rank_by_variance(_scree(s), 0.9).select("k", *r6("reached")),
    "elbows": lambda s, d: R.elbows(_scree(s)), "rank_and_elbows": rank_and_elbows, "singular_value_trace": singular_value_trace, "svd_projection": svd_projection,
    "top_terms": top_terms, "top_terms_per_partition": top_terms_per_partition, "top_terms_corpus": top_terms_corpus, "partition_cluster_stats": partition_cluster_stats,
    "nested_centers": nested_centers, "stored_merge": stored_merge, "stored_merge_stats": stored_merge_stats, "streamed_merge": streamed_merge,
    "io_matrix": io_matrix, "io_block_folder": io_block_folder, "io_labels": io_labels, "io_partitioned": io_partitioned, "io_csv_report": io_csv_report, "io_exploded": io_exploded,
    "scatter_rows": scatter_rows, "synthetic_blocks": synthetic_blocks, "normalised_documents": normalised_documents, "flagship": flagship,
    "corpus_report": corpus_report, "term_filter_report": term_filter_report, "seeded_kmeans_report": seeded_kmeans_report, "monthly_reconstruction": monthly_reconstruction, "monthly_reconstruction_all": monthly_reconstruction_all, "first_block_centers": first_block_centers,
}

_SIG = "WITH s AS (SELECT * FROM (VALUES " + ", ".join(f"({i + 1}, {x}::DOUBLE)" for i, x in enumerate(SIGMA)) + ") AS t(k, s)), sc AS (SELECT k, s * s AS variance, s * s / sum(s * s) OVER () AS r, sum(s * s) OVER (ORDER BY k) / sum(s * s) OVER () AS c FROM s)"
_STORED = """
WITH RECURSIVE t AS (SELECT partition_id, max(centers_list) AS l FROM localcentersperpartition GROUP BY 1),
u AS (SELECT partition_id, unnest(l) AS center, unnest(range(0, len(l))) AS idx FROM t),
c AS (SELECT (row_number() OVER (ORDER BY partition_id, idx) - 1)::INTEGER AS pos, partition_id AS block_id, idx::INTEGER AS center_idx, center FROM u WHERE center IS NOT NULL),
d AS (SELECT a.pos AS i, b.pos AS j FROM c a JOIN c b ON a.pos < b.pos AND list_distance(a.center, b.center) < 0.9),
k(step, kept) AS (SELECT 0, [0] UNION ALL SELECT step + 1, CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.j = step + 1 AND list_contains(kept, d.i)) THEN kept ELSE list_append(kept, step + 1) END FROM k WHERE step + 1 < (SELECT count(*) FROM c)),
kept AS (SELECT unnest(kept) AS pos FROM (SELECT kept FROM k ORDER BY step DESC LIMIT 1))
"""
SQL = {
    "doc_freq": _E + "SELECT term_index, doc_freq FROM df",
    "doc_freq_zero_filled": _E + "SELECT range::INTEGER AS term_index, coalesce(doc_freq, 0) AS doc_freq FROM range(3020) LEFT JOIN df ON term_index = range",
    "term_moments": _E + "SELECT term_index, round(s, 6) AS sum_values, round(q, 6) AS sum_squares, n AS count FROM df",
    "term_stats": _E + "SELECT range::INTEGER AS term_index, round(coalesce(s / n, 0), 6) AS mean, round(coalesce(variance, 0), 6) AS variance, round(sqrt(coalesce(variance, 0)), 6) AS std_dev, round(coalesce(s, 0), 6) AS sum_values, round(coalesce(q, 0), 6) AS sum_squares, coalesce(n, 0) AS count FROM range(3020) LEFT JOIN va ON term_index = range",
    "df_percentiles": _E + ", o AS (SELECT list(doc_freq ORDER BY doc_freq) AS x, count(*) AS n FROM df) SELECT x[floor(n * low)::INTEGER + 1] AS low_freq, x[floor(n * high)::INTEGER + 1] AS high_freq, low::DOUBLE AS low, high::DOUBLE AS high FROM o, (VALUES (0.05, 0.95), (0.1, 0.9)) AS t(low, high)",
    "df_percentile_details": _E + ", o AS (SELECT list(doc_freq ORDER BY doc_freq) AS x, count(*) AS n FROM df), b AS (SELECT x[floor(n * 0.05)::INTEGER + 1] AS lo, x[floor(n * 0.95)::INTEGER + 1] AS hi FROM o) SELECT count(*) AS total_terms, any_value(lo) AS low_freq, any_value(hi) AS high_freq, count(*) FILTER (doc_freq BETWEEN lo AND hi) AS kept, count(*) FILTER (doc_freq < lo) AS removed_low, count(*) FILTER (doc_freq > hi) AS removed_high, count(*) FILTER (doc_freq NOT BETWEEN lo AND hi) AS removed, round(count(*) FILTER (doc_freq BETWEEN lo AND hi) / count(*), 6) AS kept_share, round(avg(doc_freq), 6) AS mean, min(doc_freq) AS least, max(doc_freq) AS most FROM df, b",
    "term_counts": _E + f"SELECT count(*) FILTER (doc_freq BETWEEN {MIN_DF} AND {MAX_DF}) AS kept, count(*) FILTER (doc_freq NOT BETWEEN {MIN_DF} AND {MAX_DF}) AS removed FROM df",
    "valid_terms_abs": _VALID + " SELECT term_index, new_index, doc_freq, round(variance, 6) AS variance FROM v",
    "valid_terms_ratio": _RATIO + " SELECT term_index, new_index, doc_freq, round(variance, 6) AS variance FROM v",
    "filter_compact": _VALID + " SELECT doc_id, new_index AS term_index, value FROM e JOIN v USING (term_index)",
    "filter_by_ratio": _RATIO + " SELECT doc_id, new_index AS term_index, value FROM e JOIN v USING (term_index)",
    "filter_same_size": _VALID + " SELECT doc_id, term_index, value FROM e JOIN v USING (term_index)",
    "filter_keep_empty": _VALID + ", x AS (SELECT doc_id, count(*) AS n FROM e JOIN v USING (term_index) GROUP BY 1) SELECT doc_id, coalesce(n, 0) AS n_terms FROM r LEFT JOIN x USING (doc_id)",
    "dictionary_alpha": "SELECT (row_number() OVER (ORDER BY original_word) - 1)::INTEGER AS term_index, original_word FROM (SELECT DISTINCT original_word FROM valid_terms WHERE original_word IS NOT NULL)",
    "dictionary_code": "SELECT (row_number() OVER (ORDER BY try_cast(substr(term_code, 2) AS BIGINT) NULLS LAST, term_code, original_word) - 1)::INTEGER AS term_index, original_word, term_code FROM (SELECT DISTINCT original_word, term_code FROM valid_terms WHERE original_word IS NOT NULL AND term_code IS NOT NULL)",
    "dictionary_merge": _LAB + ", w AS (SELECT term_index, round(sum(value) / (SELECT count(*) FROM r), 9) AS weight FROM e GROUP BY 1), t AS (SELECT row_number() OVER (ORDER BY weight DESC, term_index)::INTEGER AS term_rank, term_index, weight FROM w WHERE weight > 0), k AS (SELECT DISTINCT original_word, term_code FROM valid_terms WHERE original_word IS NOT NULL AND term_code IS NOT NULL) SELECT term_rank, t.term_index, weight, term_code, original_word FROM t JOIN c USING (term_index) JOIN k USING (term_code) WHERE term_rank <= 100",
    "wide_to_sparse": "WITH t AS (SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS doc_id, * FROM lineitem), u AS (SELECT doc_id, term_index, value FROM (SELECT doc_id, l_discount::DOUBLE AS \"0\", l_extendedprice::DOUBLE AS \"1\", l_linenumber::DOUBLE AS \"2\", l_quantity::DOUBLE AS \"3\", l_tax::DOUBLE AS \"4\" FROM t) UNPIVOT (value FOR term_index IN (\"0\", \"1\", \"2\", \"3\", \"4\"))) SELECT doc_id, term_index::INTEGER AS term_index, round(sum(value), 6) AS value FROM u WHERE value <> 0 GROUP BY 1, 2",
    "l2_normalise": _E + "SELECT doc_id, term_index, round(value / sqrt(sum(value * value) OVER (PARTITION BY doc_id)), 6) AS value FROM e",
    "doc_length_stats": _E + ", x AS (SELECT doc_id, count(*) AS n FROM e GROUP BY 1) SELECT count(*) AS documents, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS stddev, min(n) AS least, max(n) AS most FROM x",
    "doc_density": _E + "SELECT doc_id, count(*) AS n_terms, round(count(*) * 100.0 / 3020, 6) AS density FROM e GROUP BY 1",
    "month_list": "SELECT strftime(m, '%Y-%m') AS month FROM (SELECT unnest(generate_series(DATE '2005-12-01', DATE '2007-02-01', INTERVAL 1 MONTH)) AS m)",
    "zero_rows": "SELECT count(*) FILTER (l_discount = 0 AND l_tax = 0) AS n FROM lineitem",
    "empty_vectors": _E + "SELECT (SELECT count(DISTINCT submission_id) FROM r2012_01) - (SELECT count(DISTINCT doc_id) FROM e) AS n",
    "vec_profile": "SELECT CASE WHEN features IS NULL THEN 'null' WHEN features.kind = 0 THEN 'sparse' ELSE 'dense' END AS kind, count(*) AS n FROM r2012_01 GROUP BY 1",
    "dense_vectors": "SELECT partition_id, cluster_label, max(CASE WHEN tfidf_mean.kind = 1 THEN len(tfidf_mean.vals) ELSE tfidf_mean.dim END)::INTEGER AS size, round(max(list_sum(tfidf_mean.vals)), 6) AS total FROM clusterstats GROUP BY 1, 2",
    "standard_scale": "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 6) AS {c}" for c in NUMBERS) + " FROM lineitem",
    "scaled_embedding": "WITH e AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding)))::INTEGER AS dim FROM embeddings) SELECT id, dim, round((x - avg(x) OVER (PARTITION BY dim)) / stddev_samp(x) OVER (PARTITION BY dim), 6) AS x FROM e",
    "scree": _SIG + " SELECT k, round(variance, 6) AS variance, round(r, 6) AS individual_variance_ratio, round(c, 6) AS cumulative_variance_ratio FROM sc",
    "rank_by_variance": _SIG + " SELECT min(k) AS k, round(min(c), 6) AS reached FROM sc WHERE c >= 0.9",
    "elbows": _SIG + ", x AS (SELECT k, r, c, variance - 2 * lag(variance) OVER w + lag(variance, 2) OVER w AS d2, abs(atan2(lead(c) OVER w - c, 1) - atan2(c - lag(c) OVER w, 1)) AS bend FROM sc WINDOW w AS (ORDER BY k)), y AS (SELECT (SELECT k - 1 FROM x WHERE d2 IS NOT NULL ORDER BY round(d2, 12) DESC, k LIMIT 1) AS a, (SELECT k FROM x WHERE bend IS NOT NULL ORDER BY round(bend, 12) DESC, k LIMIT 1) AS b, (SELECT min(k) - 1 FROM x WHERE r < 0.1 * (SELECT max(r) FROM x)) AS p, (SELECT min(k) - 1 FROM x WHERE c > 0.8) AS q) SELECT a::INTEGER AS second_difference, b::INTEGER AS curvature, least(a, b)::INTEGER AS combined, least(a, p, q)::INTEGER AS robust FROM y",
    "singular_value_trace": "SELECT round(sum(x * x), 4) AS total FROM (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings)",
    "top_terms": _LAB + ", w AS (SELECT cluster_label, term_index, round(sum(value) / any_value(cluster_size), 9) AS weight FROM e JOIN l USING (doc_id) JOIN nl USING (cluster_label) GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY cluster_label ORDER BY weight DESC, term_index)::INTEGER AS term_rank FROM w WHERE weight > 0) SELECT cluster_label, term_rank, t.term_index, weight, coalesce(term_code, 'unknown_' || t.term_index) AS term_code FROM t LEFT JOIN c ON t.term_index = c.term_index WHERE term_rank <= 20",
    "top_terms_per_partition": _LAB + ", w AS (SELECT l.partition_id, l.cluster_label, term_index, round(sum(value) / any_value(cluster_size), 9) AS weight FROM e JOIN l USING (doc_id) JOIN n ON n.partition_id = l.partition_id AND n.cluster_label = l.cluster_label GROUP BY 1, 2, 3), t AS (SELECT *, row_number() OVER (PARTITION BY partition_id, cluster_label ORDER BY weight DESC, term_index)::INTEGER AS term_rank FROM w WHERE weight > 0) SELECT partition_id, cluster_label, term_rank, t.term_index, weight, coalesce(term_code, 'unknown_' || t.term_index) AS term_code FROM t LEFT JOIN c ON t.term_index = c.term_index WHERE term_rank <= 5",
    "top_terms_corpus": _LAB + ", w AS (SELECT term_index, round(sum(value) / (SELECT count(*) FROM r), 9) AS weight FROM e GROUP BY 1), t AS (SELECT row_number() OVER (ORDER BY weight DESC, term_index)::INTEGER AS term_rank, term_index, weight FROM w WHERE weight > 0) SELECT term_rank, t.term_index, weight, coalesce(term_code, 'unknown_' || t.term_index) AS term_code FROM t LEFT JOIN c ON t.term_index = c.term_index WHERE term_rank <= 100",
    "partition_cluster_stats": _LAB + " SELECT l.partition_id, l.cluster_label, term_index, round(sum(value) / any_value(cluster_size), 6) AS weight FROM e JOIN l USING (doc_id) JOIN n ON n.partition_id = l.partition_id AND n.cluster_label = l.cluster_label GROUP BY 1, 2, 3",
    "nested_centers": "WITH t AS (SELECT DISTINCT partition_id, centers_list FROM localcentersperpartition), u AS (SELECT partition_id, unnest(centers_list) AS c, unnest(range(0, len(centers_list)))::INTEGER AS center_index FROM t) SELECT partition_id, center_index, unnest(range(0, len(c)))::INTEGER AS dim, round(unnest(c), 6) AS x FROM u",
    "stored_merge": _STORED + " SELECT c.pos, block_id, center_idx FROM c JOIN kept USING (pos)",
    "stored_merge_stats": _STORED + ", b AS (SELECT block_id, count(*) AS local_centers, count(kept.pos) AS k FROM c LEFT JOIN kept USING (pos) GROUP BY 1), r AS (SELECT row_number() OVER (ORDER BY block_id) AS partitions, local_centers, sum(local_centers) OVER (ORDER BY block_id) AS total, sum(k) OVER (ORDER BY block_id) AS merged FROM b) SELECT partitions::INTEGER AS partitions, local_centers, total::BIGINT AS total, round(total / partitions)::BIGINT AS average, merged::BIGINT AS merged, round(merged / total, 6) AS ratio, round((1 - merged / total) * 100, 6) AS reduction FROM r",
    "streamed_merge": _STORED + ", b AS (SELECT block_id, count(kept.pos) AS k FROM c LEFT JOIN kept USING (pos) GROUP BY 1) SELECT (row_number() OVER (ORDER BY block_id) - 1)::INTEGER AS batch, (sum(k) OVER (ORDER BY block_id))::BIGINT AS kept FROM b",
    "corpus_report": _LAB + ", x AS (SELECT doc_id, count(*) AS n FROM e GROUP BY 1), w AS (SELECT term_index, sum(value) AS s FROM e GROUP BY 1 ORDER BY s DESC, term_index LIMIT 1) SELECT count(*) AS documents, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS stddev, min(n) AS least, max(n) AS most, (SELECT coalesce(term_code, 'unknown_' || w.term_index) FROM w LEFT JOIN c USING (term_index)) AS first_term FROM x",
    "term_filter_report": _RATIO + ", k AS (SELECT DISTINCT ON (term_index) term_index, original_word FROM valid_terms) SELECT v.term_index, new_index, original_word, doc_freq FROM v LEFT JOIN k ON v.term_index = k.term_index",
    "monthly_reconstruction": "WITH t AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k, l_discount, l_tax FROM lineitem WHERE strftime(l_shipdate, '%Y-%m') BETWEEN '2000-01' AND '2000-03'), u AS (SELECT month, k, 0 AS term_index, sum(l_discount) AS value FROM t GROUP BY 1, 2 UNION ALL SELECT month, k, 1, sum(l_tax) FROM t GROUP BY 1, 2) SELECT month, term_index, count(*) AS n, round(sum(value), 4) AS total FROM u WHERE value <> 0 GROUP BY 1, 2",
    "first_block_centers": "SELECT partition_id AS block_id, len(any_value(centers_list)) AS n_centers, (len(any_value(centers_list)) - 1)::INTEGER AS last FROM localcentersperpartition WHERE partition_id < 3 GROUP BY 1",
    "io_matrix": "SELECT count(*) AS n, round(sum(embedding[1]::DOUBLE), 4) AS first, round(sum(embedding[64]::DOUBLE), 4) AS last FROM embeddings",
    "io_labels": "SELECT label, count(*) AS n FROM embeddings GROUP BY 1",
    "io_partitioned": "SELECT vec_id AS id, 1::INTEGER AS block_id FROM embeddings WHERE ('0x' || substr(md5('0:' || vec_id), 1, 8))::UBIGINT % 4 = 1",
    "io_block_folder": "SELECT (('0x' || substr(md5('0:' || vec_id), 1, 8))::UBIGINT % 4)::INTEGER AS block_id, count(*) AS n_rows FROM embeddings GROUP BY 1",
    "io_csv_report": "SELECT label, printf('%.6f', avg(embedding[1]::DOUBLE)) AS x FROM embeddings GROUP BY 1",
    "io_exploded": "SELECT count(*) AS n, round(sum(embedding[1]::DOUBLE), 4) AS first FROM embeddings",
    "scatter_rows": "SELECT kind, count(*) AS n, round(sum(x), 5) AS x, round(sum(y), 5) AS y FROM (SELECT 'point' AS kind, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings UNION ALL SELECT 'center', embedding[1]::DOUBLE, embedding[2]::DOUBLE FROM embeddings WHERE vec_id < 5) GROUP BY 1",
    "synthetic_blocks": "SELECT (('0x' || substr(md5('0:' || range), 1, 8))::UBIGINT % 5)::INTEGER AS block_id, (range % 4)::INTEGER AS label, count(*) AS n FROM range(1000) GROUP BY 1, 2",
}
#: The same without the bounds of the months.
SQL["monthly_reconstruction_all"] = SQL["monthly_reconstruction"].replace(" WHERE strftime(l_shipdate, '%Y-%m') BETWEEN '2000-01' AND '2000-03'", " WHERE l_shipdate IS NOT NULL")
