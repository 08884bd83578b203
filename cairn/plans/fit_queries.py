"""Queries of fits and smaller operators: mixtures, k-means to its end, decomposition, inspection and report files."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import vectors as V
from cairn.functions.special import gaussian_pdf
from cairn.operators import blocks as B
from cairn.operators import consolidate as C
from cairn.operators import evaluate as E
from cairn.operators import kmeans as K
from cairn.operators import mixture as M
from cairn.operators import reduce as R
from cairn.operators import terms as T
from cairn.plans import cluster_queries as Q
from cairn.plans import matrix_queries as X
from cairn.plans.cluster_queries import points, profile, r6, stored_centers
from cairn.runtime import durable, read_table, shared_dir
from cairn.sources import files as S

#: Components and rounds of the mixtures that are compared with SQL.
PARTS, ROUNDS = 3, 3
MIXTURE = "component int, weight double, shape double, scale double, loglik double"


def _mixtures(s, d, rounds: int | None) -> DataFrame:
    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = rows["dist"].to_numpy(float)
        g = M.moments_start(x, PARTS) if rounds is None else M.em(x, PARTS, epsilon=0.0, most=rounds)
        return pd.DataFrame({"component": range(g.m), "weight": g.weight, "shape": g.shape, "scale": g.scale, "loglik": [g.loglik if rounds else 0.0] * g.m})

    return B.local_op(profile(s, d).select("block_id", "observer_id", "dist"), ["block_id", "observer_id"], fit, MIXTURE)


def gamma_moments(s, d):
    """Starting mixtures of every block and observer, by equal-count bins."""
    return _mixtures(s, d, None).select("block_id", "observer_id", "component", *(F.round(c, 4).alias(c) for c in ("weight", "shape")), F.round("scale", 8).alias("scale"))


def gamma_em_rounds(s, d):
    """Three EM rounds of every block and observer from those starts."""
    return _mixtures(s, d, ROUNDS).select("block_id", "observer_id", "component", F.round("weight", 6).alias("weight"), F.round("shape", 3).alias("shape"), F.round("scale", 7).alias("scale"), F.round("loglik", 4).alias("loglik"))


def kmeans_converged(s, d):
    """k-means of eight centers until no label changes."""
    c, _ = K.lloyd(durable(points(s, d).select("id", "v")), Q._start(s, d))
    return K.assign_centers(points(s, d), c).select("id", "label", *r6("dist2"))


def svd_row_norms(s, d):
    """The squared length of every row, from all singular values and both sides of the decomposition."""
    p = points(s, d)
    values, right = R.singular_values(p, 64)
    scaled = F.zip_with("u", F.array(*(F.lit(float(x)) for x in values)), lambda u, x: (u * x) * (u * x))
    return R.project(p, values, right).select("id", F.round(F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x), 6).alias("norm2"))


def svd_components(s, d):
    """The sums of squares of the left coordinates: 1 for each singular value."""
    p = points(s, d)
    values, right = R.singular_values(p, 10)
    return R.project(p, values, right).select(F.posexplode("u").alias("k", "x")).groupBy("k").agg(F.round(F.sum(F.col("x") * F.col("x")), 6).alias("total"))


def sample_rows(s, d):
    return E.sample_rows(points(s, d), ["id"]).select("id", "label", F.round(F.get("v", F.lit(0)), 6).alias("first"))


def size_summary(s, d):
    """Summary of the sizes of a vector column."""
    t = read_table(s, d, "embeddings")
    return t.select(V.vector_size(t, "embedding").alias("size")).agg(*E.describe_column("size"))


def gaussian_density(s, d):
    return profile(s, d).select("block_id", "observer_id", "id", F.round(gaussian_pdf(F.col("dist"), 1.2, 0.1), 6).alias("density"))


def percentile_report(s, d):
    e = X.entries(s, d)
    out = T.percentile_report(durable(T.document_frequency(e)), e.select("doc_id").distinct().count())
    return out.select("total_terms", "low_freq", "high_freq", "kept", "removed", "least", "most", "median", "low", "high", "documents", *r6("reduction"), "recommendation")


def filter_keep_empty_vectors(s, d):
    """The vectors of all documents after the same-size filter, the empty ones included: positions and sum."""
    v = T.with_vectors(X.filter_same_size(s, d), X.documents(s, d), 3020)
    return v.select("doc_id", F.col("features.dim").alias("dim"), F.array_join("features.idx", ",").alias("positions"), F.round(F.aggregate("features.vals", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def synthetic_datasets(s, d):
    """Ten small data sets: a constant input, the sizes per set and cluster."""
    return B.gaussian_datasets(s, 10).groupBy("block_id", "label").agg(F.count(F.lit(1)).alias("n"))


def grid_fill(s, d):
    """Observers of a box that is flat in one dimension: grid points, then drawn ones up to the number asked for."""
    rows = points(s, d).select("id", F.array(F.get("v", F.lit(0)), F.lit(1.0)).alias("v"), F.lit(0).alias("block_id"))
    g = B.grid_observers(rows, 9, 2)
    inside = F.get("observer_v", F.lit(1)) == 1.0
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("observer_v").alias("distinct"), F.count_if(inside).alias("inside"), F.max("observer_id").cast("int").alias("last"))


def _folder(s) -> str:
    return f"{shared_dir(s)}/cairn/{uuid.uuid4().hex}"


def io_distances(s, d):
    """The debugging dump of pair distances, read back."""
    at = _folder(s)
    S.dump_distances(C.center_distances(stored_centers(s, d)), at)
    return S.read_csv(s, at, "i int, j int, d double").select("i", "j", *r6("d"))


def io_statistics(s, d):
    """The three statistics files, written and read back as one table."""
    t = C.cumulative_statistics(stored_centers(s, d), 0.9)
    out = None
    for kind in S.STATISTICS:
        at = _folder(s)
        S.write_csv(S.statistics_file(t, kind, {"run": "a"} if kind == "incremental" else None), at)
        rows = S.read_csv(s, at, header=True)
        text = F.concat_ws("|", *(F.concat_ws("=", F.lit(c), F.col(c)) for c in rows.columns))
        rows = rows.select(F.lit(kind).alias("kind"), text.alias("line"))
        out = rows if out is None else out.unionByName(rows)
    return out


QUERIES = {f.__name__: f for f in (gamma_moments, gamma_em_rounds, kmeans_converged, svd_row_norms, svd_components, sample_rows, size_summary, gaussian_density, percentile_report, filter_keep_empty_vectors, synthetic_datasets, grid_fill, io_distances, io_statistics)}

_BY = "block_id, observer_id"


def _digamma(a: str) -> str:
    f = f"(1 / ({a} * {a}))"
    return f"(ln({a}) - 0.5 / {a} - {f} * (1.0 / 12 - {f} * (1.0 / 120 - {f} * (1.0 / 252 - {f} * (1.0 / 240 - {f} / 132)))))"


def _trigamma(a: str) -> str:
    f = f"(1 / ({a} * {a}))"
    return f"(1 / {a} + {f} / 2 + {f} / {a} * (1.0 / 6 - {f} * (1.0 / 30 - {f} * (1.0 / 42 - {f} / 30))))"


_START = Q._P + f"""
, t AS (SELECT {_BY}, dist, row_number() OVER (PARTITION BY {_BY} ORDER BY dist) - 1 AS r, count(*) OVER (PARTITION BY {_BY}) AS n, var_pop(dist) OVER (PARTITION BY {_BY}) AS v FROM f),
b AS (SELECT *, CASE WHEN r < (n % {PARTS}) * (n // {PARTS} + 1) THEN r // (n // {PARTS} + 1) ELSE n % {PARTS} + (r - (n % {PARTS}) * (n // {PARTS} + 1)) // (n // {PARTS}) END AS k FROM t),
m AS (SELECT {_BY}, k, avg(dist) AS mean, greatest(var_pop(dist), greatest(1e-12, 1e-6 * any_value(v) + 1e-12)) AS var FROM b GROUP BY 1, 2, 3),
g0 AS MATERIALIZED (SELECT {_BY}, k, 1.0 / {PARTS} AS w, mean * mean / var AS a, var / mean AS s FROM m)
"""


def _em_sql() -> str:
    """Rounds of responsibilities, sums, and eight Newton steps for the shape."""
    out = _START
    for i in range(ROUNDS + 1):
        out += f""", z{i} AS MATERIALIZED (SELECT f.block_id, f.observer_id, f.id, f.dist, k, ln(w) + (a - 1) * ln(dist) - dist / s - a * ln(s) - lgamma(a) AS z FROM f JOIN g{i} ON g{i}.block_id = f.block_id AND g{i}.observer_id = f.observer_id),
y{i} AS MATERIALIZED (SELECT *, exp(z - max(z) OVER p) / sum(exp(z)) OVER p * exp(max(z) OVER p) AS r, ln(sum(exp(z)) OVER p) AS l FROM z{i} WINDOW p AS (PARTITION BY block_id, observer_id, id))"""
        if i == ROUNDS:
            break
        out += f""", e{i} AS (SELECT {_BY}, k, sum(r) AS s0, sum(r * dist) AS s1, sum(r * ln(dist)) AS s2, count(*) AS n FROM y{i} GROUP BY 1, 2, 3),
h{i} AS (SELECT *, greatest(ln(s1 / s0) - s2 / s0, 1e-9) AS q FROM e{i}),
n{i}_0 AS MATERIALIZED (SELECT *, (3 - q + sqrt((q - 3) * (q - 3) + 24 * q)) / (12 * q) AS a FROM h{i})"""
        for j in range(8):
            out += f", n{i}_{j + 1} AS MATERIALIZED (SELECT * REPLACE (greatest(a - (ln(a) - {_digamma('a')} - q) / (1 / a - {_trigamma('a')}), 1e-6) AS a) FROM n{i}_{j})"
        out += f", g{i + 1} AS MATERIALIZED (SELECT {_BY}, k, s0 / n AS w, a, s1 / (s0 * a) AS s FROM n{i}_8)"
    return out + f", ll AS (SELECT {_BY}, sum(l) AS loglik FROM y{ROUNDS} WHERE k = 0 GROUP BY 1, 2) SELECT {_BY}, k::INTEGER AS component, round(w, 6) AS weight, round(a, 3) AS shape, round(s, 7) AS scale, round(loglik, 4) AS loglik FROM g{ROUNDS} JOIN ll USING (block_id, observer_id)"


def _kmeans_sql(start: str, rounds: int) -> str:
    """Lloyd's rounds, more than are needed: once nothing moves, the rest change nothing."""
    out = start
    for i in range(rounds):
        out += (Q._assign_sql(f"a{i}", f"c{i}") + Q._move_sql(f"c{i + 1}", f"a{i}", f"c{i}")).replace(f"a{i} AS (", f"a{i} AS MATERIALIZED (").replace(f"c{i + 1} AS (", f"c{i + 1} AS MATERIALIZED (")
    return out + Q._assign_sql("last", f"c{rounds}")


_SEEDED = """WITH p AS (SELECT submission_id AS id, svd_100d_features AS v FROM (SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY loaded_at DESC) AS k FROM data_normalized_svd) WHERE k = 1 AND len(svd_100d_features) = 100),
c0 AS (SELECT (row_number() OVER (ORDER BY center_id) - 1)::INTEGER AS label, center_array AS c FROM mergedcentersfromallblocks WHERE center_array IS NOT NULL)"""
SQL = {
    "gamma_moments": _START + f" SELECT {_BY}, k::INTEGER AS component, round(w, 4) AS weight, round(a, 4) AS shape, round(s, 8) AS scale FROM g0",
    "gamma_em_rounds": _em_sql(),
    "kmeans_converged": _kmeans_sql(Q._K1, 40) + " SELECT id, label, round(d2, 6) AS dist2 FROM last",
    "svd_row_norms": "SELECT vec_id AS id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 6) AS norm2 FROM embeddings",
    "svd_components": "SELECT range::INTEGER AS k, 1.0::DOUBLE AS total FROM range(10)",
    "sample_rows": "SELECT vec_id AS id, label, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings ORDER BY vec_id LIMIT 10",
    "size_summary": "SELECT count(*) AS n, avg(len(embedding)) AS mean, stddev_samp(len(embedding)) AS stddev, min(len(embedding))::INTEGER AS least, max(len(embedding))::INTEGER AS most FROM embeddings",
    "gaussian_density": Q._P + f"SELECT {_BY}, id, round(exp(-0.5 * power((dist - 1.2) / 0.1, 2)) / (0.1 * sqrt(2 * pi())), 6) AS density FROM f",
    "percentile_report": X._E + ", o AS (SELECT list(doc_freq ORDER BY doc_freq) AS x, count(*) AS n FROM df), b AS (SELECT x[floor(n * 0.05)::INTEGER + 1] AS lo, x[floor(n * 0.95)::INTEGER + 1] AS hi, x[n // 2 + 1] AS median FROM o) SELECT count(*) AS total_terms, any_value(lo) AS low_freq, any_value(hi) AS high_freq, count(*) FILTER (doc_freq BETWEEN lo AND hi) AS kept, count(*) FILTER (doc_freq NOT BETWEEN lo AND hi) AS removed, min(doc_freq) AS least, max(doc_freq) AS most, any_value(median) AS median, 0.05::DOUBLE AS low, 0.95::DOUBLE AS high, (SELECT count(DISTINCT doc_id) FROM e) AS documents, round((1 - count(*) FILTER (doc_freq BETWEEN lo AND hi) / count(*)) * 100, 6) AS reduction, 'keep terms in ' || any_value(lo) || ' to ' || any_value(hi) || ' documents' AS recommendation FROM df, b",
    "filter_keep_empty_vectors": X._VALID + ", x AS (SELECT doc_id, string_agg(term_index::VARCHAR, ',' ORDER BY term_index, value) AS p, sum(value) AS t FROM e JOIN v USING (term_index) GROUP BY 1) SELECT doc_id, 3020 AS dim, coalesce(p, '') AS positions, round(coalesce(t, 0), 6) AS total FROM r LEFT JOIN x USING (doc_id)",
    "synthetic_datasets": "SELECT block_id::INTEGER AS block_id, label::INTEGER AS label, 20::BIGINT AS n FROM (SELECT range AS block_id, 2 + ('0x' || substr(md5('42:clusters:' || range), 1, 8))::UBIGINT % 2 AS k FROM range(10)), (VALUES (0), (1), (2)) AS t(label) WHERE label < k",
    "grid_fill": "SELECT 9::BIGINT AS n, 9::BIGINT AS distinct, 9::BIGINT AS inside, 8::INTEGER AS last",
    "io_distances": f"WITH {Q._ALL} SELECT a.pos AS i, b.pos AS j, round(list_distance(a.center, b.center), 6) AS d FROM c a JOIN c b ON a.pos < b.pos",
    "io_statistics": X.SQL["stored_merge_stats"][: X.SQL["stored_merge_stats"].index(" SELECT partitions::INTEGER")] + ", w AS (SELECT partitions, local_centers, total::BIGINT AS total, round(total / partitions)::BIGINT AS average, merged::BIGINT AS merged, printf('%.6f', merged / total) AS ratio, printf('%.6f', (1 - merged / total) * 100) AS reduction FROM r), x AS (SELECT *, 'partition=' || partitions || '|' AS head, 'total_local_centers=' || total || '|avg_local_centers=' || average AS mid, '|merged_centers=' || merged || '|compression_ratio=' || ratio || '|reduction_percentage=' || reduction AS tail FROM w) SELECT 'local' AS kind, head || 'local_centers=' || local_centers || '|' || mid AS line FROM x UNION ALL SELECT 'merged', head || mid || tail FROM x UNION ALL SELECT 'incremental', head || mid || tail || '|run=a' FROM x",
}
SQL["seeded_kmeans_report"] = _kmeans_sql(_SEEDED, 40) + ", n AS (SELECT label, count(*) AS cluster_size FROM last GROUP BY 1) SELECT label, cluster_size, round(cluster_size * 100.0 / sum(cluster_size) OVER (), 6) AS percent, round((SELECT sum(d2) FROM last), 6) AS cost FROM n"
