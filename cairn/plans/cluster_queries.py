"""Queries of the clustering operators on the embeddings, with their SQL."""

from __future__ import annotations

import math
import uuid
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import vectors as V
from cairn.functions.special import gamma_pdf
from cairn.operators import blocks as B
from cairn.operators import consolidate as C
from cairn.operators import density as D
from cairn.operators import evaluate as E
from cairn.operators import kmeans as K
from cairn.operators import mixture as M
from cairn.operators import profile as P
from cairn.operators import reduce as R
from cairn.operators.fit import best_observer, local_centers, local_models, two_layer_check
from cairn.plans import pipelines
from cairn.runtime import durable, numbered, read_table, shared_dir
from cairn.sources import files as S

BLOCKS, OBSERVERS, KNN = 4, 2, 5
#: Literal mixture on which the density operators are compared with SQL.
MIXTURE = M.GammaMixture(np.array([0.3, 0.5, 0.2]), np.array([150.0, 220.0, 180.0]), np.array([0.0085, 0.0064, 0.0084]))
N_CENTERS = 24


def points(spark: SparkSession, d: str) -> DataFrame:
    return V.extract_points(read_table(spark, d, "embeddings").withColumnRenamed("vec_id", "id"), "embedding", ["id", "label"])


def blocked(spark: SparkSession, d: str) -> DataFrame:
    return B.with_block(points(spark, d), "id", BLOCKS)


def profile(spark: SparkSession, d: str) -> DataFrame:
    p = blocked(spark, d)
    return P.distance_profile(p, B.sample_observers(p, OBSERVERS))


def r6(*cols: str):
    return [F.round(c, 6).alias(c) for c in cols]


HASH = "('0x' || substr(md5({}), 1, 8))::UBIGINT"
_P = f"""
WITH p AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v, ({HASH.format("'0:' || vec_id")} % {BLOCKS})::INTEGER AS block_id FROM embeddings WHERE embedding IS NOT NULL),
o AS (SELECT block_id, (r - 1)::INTEGER AS observer_id, v AS ov FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY md5('0:' || id), id) AS r FROM p) WHERE r <= {OBSERVERS}),
f AS (SELECT block_id, observer_id, id, CASE WHEN d = 0 THEN 0.1 ELSE d END AS dist FROM (SELECT block_id, observer_id, id, list_distance(v, ov) AS d FROM p JOIN o USING (block_id))),
h AS (SELECT block_id, observer_id, count(*) AS n, greatest(0.9 * least(stddev_samp(dist), (quantile_cont(dist, 0.75) - quantile_cont(dist, 0.25)) / 1.34) * power(count(*), -0.2), 1e-5) AS h, 1.06 * stddev_samp(dist) * power(count(*), -0.2) AS hb FROM f GROUP BY 1, 2),
k AS (SELECT a.block_id, a.observer_id, a.id, a.dist, sum(exp(-0.5 * power((a.dist - b.dist) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())) AS density
  FROM f a JOIN f b USING (block_id, observer_id) JOIN h USING (block_id, observer_id) GROUP BY 1, 2, 3, 4),
q AS (SELECT *, lag(density) OVER w AS da, lead(density) OVER w AS db FROM k WINDOW w AS (PARTITION BY block_id, observer_id ORDER BY dist, id))
"""


def _gamma_sql(x: str, w: float, a: float, b: float) -> str:
    constant = -a * math.log(b) - math.lgamma(a)
    return f"{w!r} * CASE WHEN {x} <= 0 THEN 0 ELSE exp(({a!r} - 1) * ln({x}) - {x} / {b!r} + ({constant!r})) END"


_W = [_gamma_sql("dist", float(w), float(a), float(b)) for w, a, b in zip(MIXTURE.weight, MIXTURE.shape, MIXTURE.scale)]
_G = _P + f", g AS (SELECT *, {_W[0]} AS f0, {_W[1]} AS f1, {_W[2]} AS f2 FROM f)"
_LABEL = "CASE WHEN f0 >= f1 AND f0 >= f2 THEN 0 WHEN f1 >= f2 THEN 1 ELSE 2 END"


def observer_sample(s, d):
    o = B.sample_observers(blocked(s, d), OBSERVERS)
    return o.select("block_id", "observer_id", F.posexplode("observer_v").alias("pos", "x")).select("block_id", "observer_id", "pos", *r6("x"))


def observer_grid(s, d):
    t = read_table(s, d, "lineitem")
    rows = t.select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id"), V.row_vector(t, ["l_quantity", "l_discount", "l_tax"]).alias("v"))
    g = B.grid_observers(rows.withColumn("block_id", F.lit(0)), 20, 3)
    return g.select(*(F.round(F.get("observer_v", F.lit(i)), 6).alias(f"x{i}") for i in range(3)))


def distance_profile(s, d):
    return P.checked_profile(profile(s, d)).select("block_id", "observer_id", "id", *r6("dist"))


def bandwidth_basic(s, d):
    return P.bandwidths(profile(s, d), "basic").select("block_id", "observer_id", "n", *r6("h"))


def bandwidth_robust(s, d):
    return P.bandwidths(profile(s, d)).select("block_id", "observer_id", "n", *r6("h"))


def bandwidth_legacy(s, d):
    return P.bandwidths(profile(s, d), iqr="legacy").select("block_id", "observer_id", "n", *r6("h"))


def _density(s, d):
    f = profile(s, d)
    return P.kernel_density(f, P.bandwidths(f))


def kde_values(s, d):
    return _density(s, d).select("block_id", "observer_id", "id", *r6("dist", "density"))


def kde_peaks(s, d):
    return P.density_peaks(_density(s, d)).select("block_id", "observer_id", "id", *r6("dist", "density"))


def component_count(s, d):
    return P.component_counts(_density(s, d))


def search_windows(s, d):
    """The windows of the first guesses, and those of a few guesses near and above the cap (as block -1)."""
    c = P.component_counts(_density(s, d)).select("block_id", "observer_id", F.col("components").cast("int").alias("first"))
    high = s.createDataFrame([(-1, g, g) for g in (1, 6, 480, 496, 505, 600)], "block_id int, observer_id int, first int")
    lo, hi = M.search_window_columns(F.col("first"))
    return c.unionByName(high).select("block_id", "observer_id", lo.alias("lo"), hi.alias("hi"))


def gamma_density(s, d):
    return profile(s, d).select("block_id", "observer_id", "id", *(F.round(float(w) * gamma_pdf(F.col("dist"), float(a), float(b)), 6).alias(f"f{i}") for i, (w, a, b) in enumerate(zip(MIXTURE.weight, MIXTURE.shape, MIXTURE.scale))))


def gamma_classify(s, d):
    return profile(s, d).select("block_id", "observer_id", "id", M.component(F.col("dist"), MIXTURE).alias("component"))


def component_sizes(s, d):
    return profile(s, d).select("block_id", "observer_id", M.component(F.col("dist"), MIXTURE).alias("component")).groupBy("block_id", "observer_id", "component").agg(F.count(F.lit(1)).alias("n"))


def mixture_loglik(s, d):
    return M.log_likelihood(profile(s, d), MIXTURE, ["block_id", "observer_id"]).select("block_id", "observer_id", "n", *r6("loglik"))


def mixture_aicc(s, d):
    x = M.log_likelihood(profile(s, d), MIXTURE, ["block_id", "observer_id"])
    return x.select("block_id", "observer_id", F.round(M.aicc_column(F.col("loglik"), F.lit(3), F.col("n")), 6).alias("aicc"))


def gamma_em_step(s, d):
    return M.em_sums(profile(s, d), MIXTURE).select("component", *r6("s0", "s1", "s2"))


def gamma_em_global(s, d):
    g = M.global_em(profile(s, d), M.moments_start(np.array([r["dist"] for r in profile(s, d).filter("block_id = 0").select("dist").collect()]), 3), steps=8)
    return s.createDataFrame([(i, float(w), float(a), float(b), g.loglik) for i, (w, a, b) in enumerate(zip(g.weight, g.shape, g.scale))], "component int, weight double, shape double, scale double, loglik double")


def densest_under_gamma(s, d):
    return M.densest_under(blocked(s, d).withColumn("v", F.transform("v", lambda x: x + 1)), ["block_id"], 4.0, 0.3)


def knn_density(s, d):
    return D.neighbour_density(blocked(s, d), ["block_id"], KNN).select("block_id", "id", *r6("mean_dist"))


def density_peak_center(s, d):
    return D.component_centers(blocked(s, d).withColumn("component", F.col("label") % 3), ["block_id", "component"], KNN)


def _models(s, d, **how):
    p = durable(blocked(s, d).select("block_id", "id", "v"))
    return local_models(p, B.sample_observers(p, OBSERVERS), KNN, **how)


def local_model_table(s, d):
    return _models(s, d).select("block_id", "observer_id", "m", "loglik", "aicc", "center_idx", "component", "id", "error")


def local_center_table(s, d):
    return local_centers(_models(s, d)).select("block_id", "observer_id", "center_idx", "id")


def local_center_sequential(s, d):
    return local_centers(_models(s, d, selection="sequential")).select("block_id", "observer_id", "center_idx", "id")


def best_observer_centers(s, d):
    return best_observer(_models(s, d)).select("block_id", "observer_id", "center_idx", "id")


def two_layers(s, d):
    return two_layer_check(points(s, d).select("id", "v", "label"), KNN)


def centers(s, d) -> DataFrame:
    """The vectors with the smallest ids as centers, in six blocks."""
    p = points(s, d).filter(F.col("id") < N_CENTERS).select((F.col("id") % 6).cast("int").alias("block_id"), "id", F.col("v").alias("center"))
    return C.with_position(p, ["block_id", "id"])


def stored_centers(s, d) -> DataFrame:
    """All stored local centers: one list per partition (a repeated row counts once), in the order of the lists."""
    t = read_table(s, d, "localcentersperpartition").groupBy("partition_id").agg(F.max("centers_list").alias("centers_list"))
    flat = t.select(F.col("partition_id").alias("block_id"), F.posexplode("centers_list").alias("id", "center")).filter("center is not null")
    return C.with_position(flat, ["block_id", "id"])


_C = f"WITH c AS (SELECT (row_number() OVER (ORDER BY vec_id % 6, vec_id) - 1)::INTEGER AS pos, (vec_id % 6)::INTEGER AS block_id, vec_id AS id, embedding::DOUBLE[] AS center FROM embeddings WHERE vec_id < {N_CENTERS}), d AS (SELECT a.pos AS i, b.pos AS j, list_distance(a.center, b.center) AS d FROM c a JOIN c b ON a.pos < b.pos)"
THRESHOLD = 1.25


def _greedy(threshold: str, before: str = "") -> str:
    """The kept positions of the greedy pass, as a recursive query over the positions."""
    return (
        _C.replace("WITH c AS", "WITH RECURSIVE c AS")
        + before
        + f""", k(step, kept) AS (
  SELECT 0, [0]
  UNION ALL
  SELECT step + 1, CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.j = step + 1 AND d.d < {threshold} AND list_contains(kept, d.i)) THEN kept ELSE list_append(kept, step + 1) END
  FROM k WHERE step + 1 < (SELECT count(*) FROM c)),
kept AS (SELECT unnest(kept) AS pos FROM (SELECT kept FROM k ORDER BY step DESC LIMIT 1))"""
    )


_GREEDY = _greedy(str(THRESHOLD))
_SHARE = ", r AS (SELECT d, row_number() OVER (ORDER BY d, i, j) AS r, count(*) OVER () AS n FROM d), t AS (SELECT avg(d) AS t FROM r WHERE r <= greatest(1, floor(n * 0.3)))"
_OWNED = _greedy("(SELECT t FROM t)", _SHARE) + ", own AS (SELECT c.pos, coalesce((SELECT min(d.i) FROM d JOIN kept ON kept.pos = d.i WHERE d.j = c.pos AND d.d < (SELECT t FROM t)), c.pos) AS owner FROM c), ow AS (SELECT pos, CASE WHEN pos IN (SELECT pos FROM kept) THEN pos ELSE owner END AS owner FROM own)"
_STEEP = ", a AS (SELECT d FROM d UNION ALL SELECT d FROM d UNION ALL SELECT 0.0 FROM c), r AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS r, count(*) OVER () AS n FROM a), w AS (SELECT r, n, lead(d, 199) OVER (ORDER BY r) - d AS rise, avg(d) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND 199 FOLLOWING) AS m FROM r), t AS (SELECT m AS t FROM w WHERE r < n // 2 - 199 AND rise IS NOT NULL ORDER BY rise DESC, r LIMIT 1)"



def center_distances(s, d, of=centers):
    return C.center_distances(of(s, d)).select("i", "j", *r6("d"))


def merge_threshold(s, d, of=centers):
    return C.threshold_table(of(s, d), 0.3).select("n_pairs", "n_used", *r6("threshold"))


def keep_first(s, d, of=centers):
    return C.keep_first(of(s, d), THRESHOLD).select("pos", "block_id", "id")


def merge_average(s, d, of=centers):
    return C.merge_average(of(s, d), 0.3).select("pos", F.posexplode("center").alias("dim", "x")).select("pos", "dim", *r6("x"))


def merge_centroid(s, d, of=centers):
    return C.merge_average(of(s, d), 0.3, "centroid").select("pos", F.posexplode("center").alias("dim", "x")).select("pos", "dim", *r6("x"))


def steepest_threshold(s, d, of=centers):
    return C.steepest_threshold(of(s, d)).select("n_entries", "start", *r6("threshold"))


def keep_first_steepest(s, d, of=centers):
    return C.keep_first_steepest(of(s, d)).select("pos")


def center_counts(s, d, of=centers):
    return C.center_statistics(B.block_sizes(of(s, d)).withColumnRenamed("n_rows", "n"))


def cumulative_center_stats(s, d, of=centers):
    return C.cumulative_statistics(of(s, d), THRESHOLD).select("partitions", "local_centers", "total", "average", "merged", *r6("ratio", "reduction"))


def batched_center_stats(s, d, of=centers):
    return C.cumulative_statistics(of(s, d), THRESHOLD, 4).select("partitions", "total", "merged")


DC = 0.5


def density_rho_delta(s, d, of=centers):
    c = of(s, d)
    return C.density_peaks_table(c, DC).select("pos", "rho", *r6("delta"), "nearest")


def density_labels(s, d, of=centers):
    c = of(s, d)
    return C.density_peak_labels(C.density_peaks_table(c, DC), 0.5, 3)


def density_cut_off(s, d):
    c = stored_centers(s, d)
    return s.createDataFrame([(C.cut_off(durable(c)),)], "dc double").select(*r6("dc"))


def spectral_centers(s, d):
    return C.spectral_labels(stored_centers(s, d), small=5.0)


def label_means(s, d):
    return C.label_means(points(s, d).select("label", F.col("v").alias("center"))).select("label", F.posexplode("center").alias("dim", "x")).select("label", "dim", *r6("x"))


def _start(s, d, k: int = 8):
    return K.center_matrix(points(s, d).filter(F.col("id") < k).select("id", F.col("v").alias("center")), order=["id"])


def kmeans_assign(s, d):
    return K.assign_centers(points(s, d), _start(s, d)).select("id", "label", *r6("dist2"))


def kmeans_three_rounds(s, d):
    c, _ = K.lloyd(points(s, d), _start(s, d), 3)
    return K.assign_centers(points(s, d), c).select("id", "label", *r6("dist2"))


def kmeans_cost(s, d):
    c, _ = K.lloyd(points(s, d), _start(s, d), 3)
    return s.createDataFrame([(K.cost(points(s, d), _start(s, d)), K.cost(points(s, d), c))], "before double, after double").select(*r6("before", "after"))


def kmeans_counts(s, d):
    return K.cluster_counts(K.assign_centers(points(s, d), _start(s, d)))


def kmeans_library(s, d):
    c = K.library_kmeans(points(s, d), _start(s, d))
    return K.assign_centers(points(s, d), c).select("id", "label", *r6("dist2"))


def _assigned(s, d):
    return K.assign_centers(points(s, d), _start(s, d)).join(points(s, d).select("id", F.col("label").alias("truth")), "id").withColumnRenamed("label", "cluster")


def purity(s, d):
    return E.purity(_assigned(s, d)).select(*r6("purity"))


def adjusted_rand(s, d):
    return E.adjusted_rand(_assigned(s, d)).select(*r6("ari"))


def run_stats(s, d):
    return E.run_statistics(K.assign_centers(points(s, d), _start(s, d)), "dist2", ["label"]).select("label", *r6("mean", "std"))


def _labels(s, d):
    return K.assign_centers(points(s, d), _start(s, d)).withColumnRenamed("label", "cluster_label")


def cluster_distribution(s, d):
    return E.cluster_distribution(_labels(s, d)).select("cluster_label", "cluster_size", *r6("percent"))


def cluster_extremes(s, d):
    return E.cluster_extremes(_labels(s, d), 8).select("largest", "most", "smallest", "least", *r6("mean_size", "ratio"), "imbalanced")


def cluster_means(s, d):
    return E.mean_vectors(points(s, d), ["label"]).select("label", "cluster_size", F.posexplode("mean").alias("dim", "x")).select("label", "cluster_size", "dim", *r6("x"))


def _from_file(s, p: DataFrame) -> DataFrame:
    """The points by way of one headerless CSV matrix, numbered in the order of their values."""
    at = f"{shared_dir(s)}/cairn/{uuid.uuid4().hex}"
    S.write_matrix(p, at)
    return durable(numbered(S.read_matrix(s, at).select("v"), ["v"], "id", "bigint"))


def _from_folder(s, p: DataFrame, n: int) -> DataFrame:
    """The points by way of a folder of ``n`` CSV files, one block each."""
    at = f"{shared_dir(s)}/cairn/{uuid.uuid4().hex}"
    S.write_block_folder(B.with_block(p, "id", n), n, at)
    return durable(numbered(S.read_block_folder(s, at), ["block_id", "v"], "id", "bigint"))


def pipeline_variant(name: str, **changes):
    def query(s, d):
        p = points(s, d).select("id", "v")
        if name == "one_file":
            p = _from_file(s, p)
        if name == "file_blocks":
            p = _from_folder(s, p, pipelines.VARIANTS[name].n_blocks)
        if name.startswith("text_"):  # these begin with a reduction to ten dimensions
            p = durable(R.project(p, *R.singular_values(p, 10)).withColumnRenamed("u", "v"))
        out = pipelines.variant(p, name, **changes)
        shown = lambda c: F.transform(c, lambda x: F.round(x, 6)).alias("center")
        local = out.local.select(F.lit("local").alias("stage"), "block_id", "observer_id", "pos", shown("center"))
        last = out.centers.select(F.lit("final").alias("stage"), F.lit(None).cast("int").alias("block_id"), F.lit(None).cast("int").alias("observer_id"), "pos", shown("center"))
        return local.unionByName(last).withColumn("cost", F.lit(out.cost).cast("double"))

    query.__doc__ = f"The pipeline {name} on the embeddings: its local centers by block and observer, its final centers, and the cost."
    return query


_K1 = """
WITH p AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings),
c0 AS (SELECT id::INTEGER AS label, v AS c FROM p WHERE id < 8)
"""


def _assign_sql(name: str, source: str) -> str:
    return f", {name} AS (SELECT id, label, d2 FROM (SELECT p.id, c.label, power(list_distance(v, c), 2) AS d2, row_number() OVER (PARTITION BY p.id ORDER BY list_distance(v, c), c.label) AS r FROM p, {source} c) WHERE r = 1)"


def _move_sql(name: str, assigned: str, source: str) -> str:
    return f""", {name} AS (SELECT c.label, coalesce(m.c, c.c) AS c FROM {source} c LEFT JOIN (
  SELECT label, list(x ORDER BY dim) AS c FROM (SELECT a.label, dim, avg(x) AS x FROM (SELECT id, unnest(v) AS x, unnest(range(0, len(v))) AS dim FROM p) e JOIN {assigned} a USING (id) GROUP BY 1, 2) GROUP BY 1) m USING (label))"""


_A0 = _K1 + _assign_sql("a0", "c0")
_A3 = _A0 + _move_sql("c1", "a0", "c0") + _assign_sql("a1", "c1") + _move_sql("c2", "a1", "c1") + _assign_sql("a2", "c2") + _move_sql("c3", "a2", "c2") + _assign_sql("a3", "c3")
_PAIRS = _A0 + ", t AS (SELECT a0.label AS cluster, p.label AS truth FROM a0 JOIN p USING (id))"
_D2 = _C + f", e AS (SELECT i, j, 1 - exp(-d * d / 2) AS d FROM d), b AS (SELECT i AS pos, j AS other, d FROM e UNION ALL SELECT j, i, d FROM e), rho AS (SELECT c.pos, count(b.pos) AS rho FROM c LEFT JOIN b ON b.pos = c.pos AND b.d < {DC} GROUP BY 1), near AS (SELECT b.pos, min(b.d) AS delta, arg_min(b.other, b.d) AS nearest FROM b JOIN rho x ON x.pos = b.pos JOIN rho y ON y.pos = b.other WHERE y.rho > x.rho OR (y.rho = x.rho AND y.pos < x.pos) GROUP BY 1), dp AS (SELECT rho.pos, rho, coalesce(delta, (SELECT max(d) FROM e)) AS delta, nearest FROM rho LEFT JOIN near USING (pos))"

#: Consolidation queries whose SQL is bound to the 24 vectors of ``centers``; each also runs on all stored centers, as stored_<name>.
CONSOLIDATION = {
    "center_distances": center_distances, "merge_threshold": merge_threshold, "keep_first": keep_first, "merge_average": merge_average, "merge_centroid": merge_centroid, "fastest_change_threshold": steepest_threshold, "keep_first_fastest": keep_first_steepest,
    "center_counts": center_counts, "cumulative_center_stats": cumulative_center_stats, "batched_center_stats": batched_center_stats, "density_rho_delta": density_rho_delta, "density_labels": density_labels,
}

QUERIES = {
    "feature_cast": lambda s, d: points(s, d).select("id", F.posexplode("v").alias("pos", "x")).select("id", "pos", *r6("x")),
    "vector_profile": lambda s, d: E.vector_profile((lambda t: t.select(V.vector_kind(t, "embedding").alias("kind"), V.vector_size(t, "embedding").alias("size")))(read_table(s, d, "embeddings"))),
    "array_to_columns": lambda s, d: points(s, d).select("id", *(F.round(c, 6).alias(f"feature_{i}") for i, c in enumerate(V.element_columns(F.col("v"), 8)))),
    "block_assign": lambda s, d: blocked(s, d).select("id", "block_id"),
    "block_sizes": lambda s, d: B.block_sizes(blocked(s, d)),
    "first_blocks": lambda s, d: B.first_blocks(blocked(s, d), 2).select("id", "block_id"),
    "chosen_blocks": lambda s, d: B.block_sizes(B.choose_blocks(blocked(s, d).withColumnRenamed("id", "vid"), BLOCKS, 2)),
    "packed_blocks": lambda s, d: B.unpack_blocks(B.pack_blocks(blocked(s, d), ["id", "label"])),
    "observer_sample": observer_sample, "observer_grid": observer_grid, "distance_profile": distance_profile,
    "bandwidth_basic": bandwidth_basic, "bandwidth_robust": bandwidth_robust, "bandwidth_legacy": bandwidth_legacy,
    "kde_values": kde_values, "kde_peaks": kde_peaks, "component_count": component_count, "search_windows": search_windows,
    "gamma_density": gamma_density, "gamma_classify": gamma_classify, "component_sizes": component_sizes, "mixture_loglik": mixture_loglik, "mixture_aicc": mixture_aicc, "gamma_em_step": gamma_em_step, "gamma_em_global": gamma_em_global, "densest_under_gamma": densest_under_gamma,
    "knn_density": knn_density, "density_peak_center": density_peak_center, "local_models": local_model_table, "local_centers": local_center_table, "local_centers_sequential": local_center_sequential, "best_observer": best_observer_centers, "two_layer_check": two_layers,
    **CONSOLIDATION, **{f"stored_{n}": partial(q, of=stored_centers) for n, q in CONSOLIDATION.items()},
    "density_cut_off": density_cut_off, "spectral_labels": spectral_centers, "label_means": label_means,
    "kmeans_assign": kmeans_assign, "kmeans_three_rounds": kmeans_three_rounds, "kmeans_cost": kmeans_cost, "kmeans_counts": kmeans_counts, "kmeans_library": kmeans_library,
    "purity": purity, "adjusted_rand": adjusted_rand, "run_stats": run_stats, "cluster_distribution": cluster_distribution, "cluster_extremes": cluster_extremes, "cluster_means": cluster_means,
    **{f"pipeline_{n}": pipeline_variant(n) for n in pipelines.VARIANTS},
    "repeated_runs": lambda s, d: pipelines.repeated(durable(points(s, d).select("id", "v", "label")), pipelines.VARIANTS["one_file"]),
}

_AT = "block_id, observer_id"
SQL = {
    "feature_cast": "SELECT vec_id AS id, unnest(range(0, len(embedding)))::INTEGER AS pos, round(unnest(embedding)::DOUBLE, 6) AS x FROM embeddings",
    "vector_profile": "SELECT CASE WHEN embedding IS NULL THEN 'null' ELSE 'array' END AS kind, count(*) AS n, min(coalesce(len(embedding), -1))::INTEGER AS least, max(coalesce(len(embedding), -1))::INTEGER AS most, avg(coalesce(len(embedding), -1)) AS mean FROM embeddings GROUP BY 1",
    "array_to_columns": "SELECT vec_id AS id, " + ", ".join(f"round(embedding[{i + 1}]::DOUBLE, 6) AS feature_{i}" for i in range(8)) + " FROM embeddings",
    "block_assign": _P + "SELECT id, block_id FROM p",
    "block_sizes": _P + "SELECT block_id, count(*) AS n_rows FROM p GROUP BY 1",
    "first_blocks": _P + "SELECT id, block_id FROM p WHERE block_id < 2",
    "chosen_blocks": _P + f", b AS (SELECT range::INTEGER AS block_id, (row_number() OVER (ORDER BY {HASH.format("'choose:0:' || range")}, range) - 1)::INTEGER AS new FROM range({BLOCKS})) SELECT new AS block_id, count(*) AS n_rows FROM p JOIN b USING (block_id) WHERE new < 2 GROUP BY 1",
    "packed_blocks": _P + "SELECT block_id, id, label FROM p",
    "observer_sample": _P + f"SELECT {_AT}, unnest(range(0, len(ov)))::INTEGER AS pos, round(unnest(ov), 6) AS x FROM o",
    "observer_grid": "WITH b AS (SELECT min(l_quantity) a0, max(l_quantity) b0, min(l_discount) a1, max(l_discount) b1, min(l_tax) a2, max(l_tax) b2 FROM lineitem) SELECT DISTINCT round(a0 + (b0 - a0) * ((k // 9) % 3) / 2, 6) AS x0, round(a1 + (b1 - a1) * ((k // 3) % 3) / 2, 6) AS x1, round(a2 + (b2 - a2) * (k % 3) / 2, 6) AS x2 FROM b, (SELECT range AS k FROM range(20))",
    "distance_profile": _P + f"SELECT {_AT}, id, round(dist, 6) AS dist FROM f",
    "bandwidth_basic": _P + f"SELECT {_AT}, n, round(hb, 6) AS h FROM h",
    "bandwidth_robust": _P + f"SELECT {_AT}, n, round(h, 6) AS h FROM h",
    "bandwidth_legacy": _P + f""", l AS (SELECT {_AT}, count(*) AS n, stddev_samp(dist) AS s, list(dist ORDER BY dist) AS x FROM f GROUP BY 1, 2),
      z AS (SELECT *, 0.25 * (n + 1) AS pa, 0.75 * (n + 1) AS pb FROM l)
      SELECT {_AT}, n, round(greatest(0.9 * least(s, ((x[floor(pb)::INTEGER] + (pb - floor(pb)) * (x[least(floor(pb)::INTEGER + 1, n)] - x[floor(pb)::INTEGER])) - (x[floor(pa)::INTEGER] + (pa - floor(pa)) * (x[least(floor(pa)::INTEGER + 1, n)] - x[floor(pa)::INTEGER]))) / 1.34) * power(n, -0.2), 1e-5), 6) AS h FROM z""",
    "kde_values": _P + f"SELECT {_AT}, id, round(dist, 6) AS dist, round(density, 6) AS density FROM k",
    "kde_peaks": _P + f"SELECT {_AT}, id, round(dist, 6) AS dist, round(density, 6) AS density FROM q WHERE density > da AND density > db",
    "component_count": _P + f"SELECT {_AT}, count(*) FILTER (density > da AND density > db) AS peaks, greatest(1, count(*) FILTER (density > da AND density > db)) AS components FROM q GROUP BY 1, 2",
    "search_windows": _P + f", c AS (SELECT {_AT}, greatest(1, count(*) FILTER (density > da AND density > db)) AS c FROM q GROUP BY 1, 2 UNION ALL SELECT -1, g, g FROM (VALUES (1), (6), (480), (496), (505), (600)) AS t(g)) SELECT {_AT}, CASE WHEN c >= 505 THEN 490 WHEN c > 6 THEN c - 5 ELSE 1 END::INTEGER AS lo, CASE WHEN c >= 495 THEN 500 WHEN c > 6 THEN c + 5 ELSE 11 END::INTEGER AS hi FROM c",
    "gamma_density": _G + f"SELECT {_AT}, id, round(f0, 6) AS f0, round(f1, 6) AS f1, round(f2, 6) AS f2 FROM g",
    "gamma_classify": _G + f"SELECT {_AT}, id, {_LABEL}::INTEGER AS component FROM g",
    "component_sizes": _G + f"SELECT {_AT}, {_LABEL}::INTEGER AS component, count(*) AS n FROM g GROUP BY 1, 2, 3",
    "mixture_loglik": _G + f"SELECT {_AT}, count(*) AS n, round(sum(ln(f0 + f1 + f2 + 1e-10)), 6) AS loglik FROM g GROUP BY 1, 2",
    "mixture_aicc": _G + f"SELECT {_AT}, round(-2.0 * sum(ln(f0 + f1 + f2 + 1e-10)) + 2.0 * 9 * count(*) / (count(*) - 10), 6) AS aicc FROM g GROUP BY 1, 2",
    "gamma_em_step": _G + ", s AS (SELECT dist, greatest(f0 + f1 + f2, 1e-300) AS t, f0, f1, f2 FROM g) " + " UNION ALL ".join(f"SELECT {i} AS component, round(sum(f{i} / t), 6) AS s0, round(sum(f{i} / t * dist), 6) AS s1, round(sum(f{i} / t * ln(dist)), 6) AS s2 FROM s" for i in range(3)),
    "densest_under_gamma": _P + "SELECT block_id, arg_max(id, (1.0 * " + _gamma_sql("(v[1] + 1)", 1.0, 4.0, 0.3) + ")) AS id FROM p GROUP BY 1",
    "knn_density": _P + f"SELECT block_id, id, round(avg(d), 6) AS mean_dist FROM (SELECT a.block_id, a.id, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS r FROM p a JOIN p b ON a.block_id = b.block_id AND a.id <> b.id) WHERE r <= {KNN} GROUP BY 1, 2",
    "density_peak_center": _P + f", x AS (SELECT *, label % 3 AS component, count(*) OVER (PARTITION BY block_id, label % 3) AS n FROM p), m AS (SELECT block_id, component, id, avg(d) AS a FROM (SELECT a.block_id, a.component, a.id, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS r FROM x a JOIN x b ON a.block_id = b.block_id AND a.component = b.component AND a.id <> b.id WHERE a.n > {KNN + 1}) WHERE r <= {KNN} GROUP BY 1, 2, 3) SELECT block_id, component, arg_min(id, a) AS id FROM m GROUP BY 1, 2",
    "center_distances": _C + "SELECT i, j, round(d, 6) AS d FROM d",
    "merge_threshold": _C + ", r AS (SELECT d, row_number() OVER (ORDER BY d, i, j) AS r, count(*) OVER () AS n FROM d) SELECT max(n) AS n_pairs, count(*) AS n_used, round(avg(d), 6) AS threshold FROM r WHERE r <= greatest(1, floor(n * 0.3))",
    "keep_first": _GREEDY + " SELECT c.pos, block_id, id FROM c JOIN kept USING (pos)",
    "merge_average": _OWNED + ", l AS (SELECT owner, max(pos) AS last FROM ow WHERE pos <> owner GROUP BY 1), m AS (SELECT c.pos, unnest(range(0, len(c.center)))::INTEGER AS dim, unnest(c.center) AS x, unnest(coalesce(b.center, c.center)) AS y FROM ow JOIN c ON c.pos = ow.pos LEFT JOIN l ON l.owner = c.pos LEFT JOIN c b ON b.pos = l.last WHERE ow.pos = ow.owner) SELECT pos, dim, round((x + y) / 2, 6) AS x FROM m",
    "merge_centroid": _OWNED + ", m AS (SELECT owner AS pos, unnest(range(0, len(center)))::INTEGER AS dim, unnest(center) AS x FROM ow JOIN c USING (pos)) SELECT pos, dim, round(avg(x), 6) AS x FROM m GROUP BY 1, 2",
    "keep_first_fastest": _greedy("(SELECT t FROM t)", _STEEP) + " SELECT pos FROM kept",
    "center_counts": "WITH c AS (SELECT vec_id % 6 AS b, count(*) AS n FROM embeddings WHERE vec_id < 24 GROUP BY 1) SELECT sum(n)::BIGINT AS total, min(n) AS least, max(n) AS most, avg(n) AS mean FROM c",
    "cumulative_center_stats": _GREEDY + ", b AS (SELECT block_id, count(*) AS local_centers, count(kept.pos) AS k FROM c LEFT JOIN kept USING (pos) GROUP BY 1), r AS (SELECT row_number() OVER (ORDER BY block_id) AS partitions, local_centers, sum(local_centers) OVER (ORDER BY block_id) AS total, sum(k) OVER (ORDER BY block_id) AS merged FROM b) SELECT partitions::INTEGER AS partitions, local_centers, total::BIGINT AS total, round(total / partitions)::BIGINT AS average, merged::BIGINT AS merged, round(merged / total, 6) AS ratio, round((1 - merged / total) * 100, 6) AS reduction FROM r",
    "batched_center_stats": _GREEDY + ", b AS (SELECT block_id, count(*) AS n, count(kept.pos) AS k FROM c LEFT JOIN kept USING (pos) GROUP BY 1), r AS (SELECT row_number() OVER (ORDER BY block_id) AS partitions, sum(n) OVER (ORDER BY block_id) AS total, sum(k) OVER (ORDER BY block_id) AS merged, count(*) OVER () AS m FROM b) SELECT partitions::INTEGER AS partitions, total::BIGINT AS total, merged::BIGINT AS merged FROM r WHERE partitions % 4 = 0 OR partitions = m",
    "fastest_change_threshold": _C + ", a AS (SELECT d FROM d UNION ALL SELECT d FROM d UNION ALL SELECT 0.0 FROM c), r AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS r, count(*) OVER () AS n FROM a), w AS (SELECT r, n, lead(d, 199) OVER (ORDER BY r) - d AS rise, avg(d) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND 199 FOLLOWING) AS m FROM r), b AS (SELECT * FROM w WHERE r < n // 2 - 199 AND rise IS NOT NULL ORDER BY rise DESC, r LIMIT 1) SELECT (SELECT max(n) FROM w) AS n_entries, r::INTEGER AS start, round(m, 6) AS threshold FROM b",
    "density_rho_delta": _D2 + " SELECT pos, rho, round(delta, 6) AS delta, nearest FROM dp",
    "density_labels": _D2.replace("WITH c AS", "WITH RECURSIVE c AS") + ", ce AS (SELECT *, delta >= 0.5 AND rho >= 3 AS is_center FROM dp), w(pos, cur) AS (SELECT pos, pos FROM ce UNION ALL SELECT w.pos, ce.nearest FROM w JOIN ce ON ce.pos = w.cur WHERE NOT is_center AND nearest IS NOT NULL), l AS (SELECT w.pos, max(CASE WHEN ce.is_center THEN w.cur END) AS label FROM w JOIN ce ON ce.pos = w.cur GROUP BY 1) SELECT ce.pos, is_center, coalesce(label, -1)::INTEGER AS label FROM ce JOIN l ON l.pos = ce.pos",
    "label_means": "SELECT label, dim::INTEGER AS dim, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS dim FROM embeddings) GROUP BY 1, 2",
    "kmeans_assign": _A0 + "SELECT id, label, round(d2, 6) AS dist2 FROM a0",
    "kmeans_three_rounds": _A3 + "SELECT id, label, round(d2, 6) AS dist2 FROM a3",
    "kmeans_cost": _A3 + "SELECT round((SELECT sum(d2) FROM a0), 6) AS before, round((SELECT sum(d2) FROM a3), 6) AS after",
    "kmeans_counts": _A0 + "SELECT label, count(*) AS n FROM a0 GROUP BY 1",
    "purity": _PAIRS + ", x AS (SELECT cluster, truth, count(*) AS n FROM t GROUP BY 1, 2), y AS (SELECT cluster, max(n) AS m, sum(n) AS n FROM x GROUP BY 1) SELECT round(sum(m) / sum(n), 6) AS purity FROM y",
    "adjusted_rand": _PAIRS + ", x AS (SELECT cluster, truth, count(*)::DOUBLE AS n FROM t GROUP BY 1, 2), s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM x) AS b, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM x GROUP BY cluster)) AS c, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM x GROUP BY truth)) AS u, (SELECT sum(n) FROM x) AS n) SELECT round((b - c * u / (n * (n - 1) / 2)) / ((c + u) / 2 - c * u / (n * (n - 1) / 2)), 6) AS ari FROM s",
    "run_stats": _A0 + "SELECT label, round(avg(d2), 6) AS mean, round(stddev_pop(d2), 6) AS std FROM a0 GROUP BY 1",
    "cluster_distribution": _A0 + "SELECT label AS cluster_label, count(*) AS cluster_size, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM a0 GROUP BY 1",
    "cluster_extremes": _A0 + ", n AS (SELECT label, count(*) AS n FROM a0 GROUP BY 1) SELECT (SELECT label FROM n ORDER BY n DESC, label LIMIT 1) AS largest, max(n) AS most, (SELECT label FROM n ORDER BY n, label LIMIT 1) AS smallest, min(n) AS least, round(sum(n) / 8, 6) AS mean_size, round(max(n) / min(n), 6) AS ratio, max(n) / min(n) > 5 AS imbalanced FROM n",
    "cluster_means": "WITH n AS (SELECT label, count(*) AS cluster_size FROM embeddings GROUP BY 1) SELECT label, cluster_size, dim::INTEGER AS dim, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS dim FROM embeddings) JOIN n USING (label) GROUP BY 1, 2, 3",
}

#: The centers of the SQL above, and all stored ones in their place.
_FEW = _C[_C.index("c AS (") : _C.index(", d AS (")]
_ALL = "c AS (SELECT (row_number() OVER (ORDER BY partition_id, idx) - 1)::INTEGER AS pos, partition_id AS block_id, idx::INTEGER AS id, center FROM (SELECT partition_id, unnest(l) AS center, unnest(range(0, len(l))) AS idx FROM (SELECT partition_id, max(centers_list) AS l FROM localcentersperpartition GROUP BY 1)) WHERE center IS NOT NULL)"
SQL |= {f"stored_{n}": SQL[n].replace(_FEW, _ALL) for n in CONSOLIDATION}
SQL["stored_center_counts"] = f"WITH {_ALL}, n AS (SELECT block_id, count(*) AS n FROM c GROUP BY 1) SELECT sum(n)::BIGINT AS total, min(n) AS least, max(n) AS most, avg(n) AS mean FROM n"
SQL["stored_fastest_change_threshold"] = SQL["stored_fastest_change_threshold"].replace(" FROM b", " FROM (SELECT 1) LEFT JOIN b ON true")  # few centers have no threshold
SQL["density_cut_off"] = f"WITH RECURSIVE {_ALL}, e AS MATERIALIZED (SELECT 1 - exp(-power(list_distance(a.center, b.center), 2) / 2) AS d FROM c a JOIN c b ON a.pos < b.pos), r(step, a, b, dc) AS (SELECT 0, min(d), max(d), (min(d) + max(d)) / 2 FROM e UNION ALL SELECT step + 1, CASE WHEN share < 0.01 THEN dc ELSE a END, CASE WHEN share < 0.01 THEN b ELSE dc END, ((CASE WHEN share < 0.01 THEN dc ELSE a END) + (CASE WHEN share < 0.01 THEN b ELSE dc END)) / 2 FROM (SELECT r.*, (SELECT count(*) FROM e WHERE e.d < r.dc) * 2.0 / power((SELECT count(*) FROM c), 2) AS share FROM r) WHERE share NOT BETWEEN 0.01 AND 0.02 AND step < 100 AND b - a >= 1e-14) SELECT round(dc, 6) AS dc FROM r ORDER BY step DESC LIMIT 1"
