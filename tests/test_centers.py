"""Profiles, mixtures, density, consolidation and k-means: golden values and properties."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.functions.special import digamma, trigamma
from cairn.operators import blocks as B
from cairn.operators import consolidate as C
from cairn.operators import density as D
from cairn.operators import kmeans as K
from cairn.operators import mixture as M
from cairn.operators import profile as P
from cairn.operators.fit import best_observer, checked_points, local_centers, local_models, two_layer_check
from cairn.plans import pipelines
from cairn.streaming import fold

KDE_TOY = [1.2, 1.5, 1.7, 2.1, 2.3, 3.5, 3.8, 4.0, 4.5, 5.1]


def toy_profile(spark):
    return spark.createDataFrame([(0, 0, i, x) for i, x in enumerate(KDE_TOY)], "block_id int, observer_id int, id bigint, dist double")


@pytest.mark.parametrize("kind,iqr,h,peaks", [("basic", "linear", 0.9197655657666236, [2.1, 3.8]), ("robust", "legacy", 0.7809330275376992, [1.7, 4.0])])
def test_bandwidth_and_peaks(spark, kind, iqr, h, peaks):
    f = toy_profile(spark)
    bands = P.bandwidths(f, kind, iqr)
    assert abs(bands.first()["h"] - h) < 1e-12
    d = P.kernel_density(f, bands)
    assert [r["dist"] for r in P.density_peaks(d).orderBy("dist").collect()] == peaks
    assert tuple(P.component_counts(d).first())[2:] == (2, 2)
    again = P.kernel_density(f.orderBy(F.rand(1)), bands)
    assert P.component_counts(again).first()["peaks"] == 2


def test_profile_checks(spark):
    f = toy_profile(spark)
    assert P.checked_profile(f).count() == 10
    for bad in (f.limit(2), f.withColumn("dist", F.lit(None).cast("double")), f.withColumn("dist", -F.col("dist"))):
        with pytest.raises(Exception, match="distance"):
            P.checked_profile(bad).collect()
    p = spark.createDataFrame([(0, 1, [0.0, 0.0]), (0, 2, [3.0, 4.0])], "block_id int, id bigint, v array<double>")
    o = spark.createDataFrame([(0, 0, [0.0, 0.0])], "block_id int, observer_id int, observer_v array<double>")
    assert sorted(r["dist"] for r in P.distance_profile(p, o).collect()) == [0.1, 5.0]
    assert sorted(r["dist"] for r in P.distance_profile(p, o, None).collect()) == [0.0, 5.0]


def test_special_functions():
    x = np.array([0.1, 0.5, 1.0, 3.3, 7.0, 50.0])
    e = 1e-5
    slope = np.array([(math.lgamma(v + e) - math.lgamma(v - e)) / (2 * e) for v in x])
    assert np.abs(digamma(x) - slope).max() < 1e-6
    assert np.abs(trigamma(x) - (digamma(x + e) - digamma(x - e)) / (2 * e)).max() < 1e-4


@pytest.fixture(scope="module")
def gammas():
    rng = np.random.default_rng(1)
    return np.concatenate([rng.gamma(9, 0.5, 400), rng.gamma(40, 0.4, 300), rng.gamma(30, 1.0, 300)])


def test_em_recovers_and_never_falls(gammas):
    g = M.em(gammas, 3, epsilon=1e-6)
    assert abs(g.weight.sum() - 1) < 1e-9 and min(np.diff(g.path)) > -1e-6
    order = np.argsort(g.shape * g.scale)
    assert np.abs((g.shape * g.scale)[order] - [4.5, 16, 30]).max() < 1.0 and np.abs(g.weight[order] - [0.4, 0.3, 0.3]).max() < 0.05
    best = min((M.em(gammas, m) for m in range(1, 6)), key=lambda g: g.aicc)
    assert M.select_in_window(gammas, 1, 5).m == M.select_in_turn(gammas, most=5).m == best.m >= 3


def test_em_rejects_and_drops():
    for bad in ([], [1.0, 0.0], [1.0, float("nan")]):
        with pytest.raises(ValueError):
            M.em(np.array(bad), 1)
    g = M.em(np.full(30, 2.0), 3)
    assert np.isfinite(g.loglik) and abs(g.weight.sum() - 1) < 1e-9
    with pytest.raises(ValueError):
        M.select_in_window(np.array([1.0, 2.0, 3.0]), 5, 6)


def test_aicc_and_window():
    assert abs(M.aicc(-100.0, 2, 50) - (200 + 12 + 2 * 6 * 7 / 43)) < 1e-9 and M.aicc(-1.0, 3, 10) == math.inf
    assert M.search_window(1, 1000) == (1, 11) and M.search_window(20, 1000) == (15, 25) and M.search_window(1, 9) == (1, 2)


def test_global_em_is_the_block_em(spark, gammas):
    f = spark.createDataFrame([(0, 0, i, float(x)) for i, x in enumerate(gammas)], "block_id int, observer_id int, id bigint, dist double")
    start = M.moments_start(gammas, 2)
    g = M.global_em(f, start, steps=4, epsilon=0)
    b = M.em(gammas, 2, epsilon=0, most=4)
    assert abs(g.loglik - b.loglik) < 1e-3 and np.abs(np.sort(g.shape) - np.sort(b.shape)).max() < 1e-3


def test_neighbour_density():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((700, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert np.abs(D.knn_distances(x, 4) - np.sort(d, 1)[:, :4]).max() < 1e-9
    assert D.knn_distances(x[:3], 10).shape == (3, 2)
    with pytest.raises(ValueError):
        D.knn_distances(x[:1], 1)
    assert D.densest(np.array([5, 3, 9]), np.zeros((3, 2)), 1) == 1


@pytest.fixture(scope="module")
def three(spark):
    g = B.gaussian_clusters(spark, [[2.0, 2.0], [8.0, 3.0], [5.0, 8.0]], 50, 0.8)
    return g.persist()


def test_local_models(spark, three):
    p = B.with_block(three, "id", 1)
    models = local_models(p, B.sample_observers(p, 3), 5)
    rows = models.collect()
    assert all(r["error"] is None for r in rows)
    assert {(r["observer_id"]) for r in rows} == {0, 1, 2}
    c = np.array([r["center"] for r in local_centers(models).collect()])
    truth = np.array([[2, 2], [8, 3], [5, 8]])
    assert np.sqrt(((c[:, None] - truth[None]) ** 2).sum(2)).min(1).max() < 2
    assert best_observer(models).select("observer_id").distinct().count() == 1
    again = local_models(p.repartition(7), B.sample_observers(p.repartition(7), 3), 5).collect()
    assert sorted((r["observer_id"], r["id"] or -1) for r in again) == sorted((r["observer_id"], r["id"] or -1) for r in rows)


def test_a_bad_block_does_not_end_the_job(spark):
    rows = [(0, i, [float(i), 1.0]) for i in range(40)] + [(1, 100 + i, [float("nan"), 1.0]) for i in range(5)] + [(2, 200, [1.0, 1.0])]
    p = spark.createDataFrame(rows, "block_id int, id bigint, v array<double>")
    got = local_models(p, B.sample_observers(p, 1), 2).collect()
    assert {r["block_id"]: r["error"] is None for r in got} == {0: True, 1: False}
    assert B.global_op(local_models(p, B.sample_observers(p, 1), 2), lambda x: x).filter("block_id = 1").count() == 0
    for points, n, k in ((p, 0, 1), (p, 1, 0), (p.limit(0), 1, 1), (p.unionByName(spark.createDataFrame([(0, 9, [1.0])], p.schema)), 1, 1)):
        with pytest.raises(ValueError):
            checked_points(points, n, k)


def test_blocks(spark, three):
    b = B.with_block(three, "id", 5, 3)
    assert B.block_sizes(b).agg(F.sum("n_rows")).first()[0] == 150 and b.filter("block_id not between 0 and 4").count() == 0
    assert B.choose_blocks(b.withColumnRenamed("id", "pid"), 5, 2, 1).select("block_id").distinct().count() == 2
    with pytest.raises(ValueError):
        B.choose_blocks(b, 5, 6)
    assert B.sample_observers(b, 4).groupBy("block_id").count().filter("count <> 4").count() == 0
    g = B.grid_observers(b, 9, 2).filter("block_id = 0")
    assert g.count() == 9 and g.select("observer_v").distinct().count() == 9
    assert two_layer_check(three.select("id", "v", F.lit(1).alias("label")), 5).count() <= 1


CENTERS = st.lists(st.tuples(st.floats(-2, 2), st.floats(-2, 2)), min_size=1, max_size=25)


@settings(max_examples=200, deadline=None)
@given(CENTERS, st.floats(0.05, 2), st.integers(0, 25))
def test_prefix_law(centers, t, cut):
    """Folding block by block keeps what one pass keeps; kept centers are at least t apart."""
    x = np.array(centers)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    owner = C.greedy_kept([(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if d[i, j] < t], list(range(len(x))))
    kept = [i for i in owner if owner[i] == i]
    assert all(d[i, j] >= t for i in kept for j in kept if i < j)
    folded = C.fold_blocks(C.fold_blocks([], x[:cut].tolist(), t), x[cut:].tolist(), t)
    assert folded == x[kept].tolist()
    assert all(owner[j] in kept and d[owner[j], j] < t for j in owner if owner[j] != j)


def centers(spark, rows):
    return spark.createDataFrame([(i, i % 2, [float(v) for v in x]) for i, x in enumerate(rows)], "pos int, block_id int, center array<double>")


def test_merges(spark):
    rows = [[0, 0], [0.1, 0], [0, 0.2], [5, 5], [5, 5.1], [9, 0]]
    c = centers(spark, rows)
    assert [r["pos"] for r in C.keep_first(c, 0.3).orderBy("pos").collect()] == [0, 3, 5]
    last = {r["pos"]: r["center"] for r in C.merge_average(c, 0.3).collect()}
    # the mean of the 4 smallest of 15 distances is 0.156: center 2 stays
    assert set(last) == {0, 2, 3, 5} and last[0] == [0.05, 0.0] and last[3] == [5.0, 5.05] and last[5] == [9.0, 0.0]
    mean = {r["pos"]: r["center"] for r in C.merge_average(c, 0.3, "centroid").collect()}
    assert np.allclose(mean[0], [0.05, 0.0])
    three = centers(spark, [[0, 0], [0, 3], [0, 1], [9, 9]])
    # the mean of the 3 smallest of 6 distances is 2: the first absorbs the third
    assert {r["pos"]: r["center"] for r in C.merge_average(three, 0.5).collect()} == {0: [0.0, 0.5], 1: [0.0, 3.0], 3: [9.0, 9.0]}
    one = centers(spark, rows[:1])
    assert C.merge_average(one, 0.3).count() == C.keep_first(one).count() == 1 and C.merge_threshold(one, 0.3) is None
    assert C.merge_average(c.limit(0), 0.3).count() == 0
    assert C.keep_first_steepest(c).count() == 6 and C.steepest_threshold(c).first()["threshold"] is None
    assert C.spectral_centers(c, small=0.5).count() == 3
    peaks = C.density_peaks_table(c, 0.1)
    labels = {r["pos"]: r["label"] for r in C.density_peak_labels(peaks, 0.5, 1).collect()}
    assert labels[1] == labels[2] == labels[0] == 0 and labels[3] == labels[4] == 3
    for bad in (lambda: C.merge_threshold(c, 2), lambda: C.checked_centers(c.limit(0)), lambda: C.checked_centers(c, 7), lambda: C.merge_average(c, 0.1, "x"), lambda: C.cumulative_statistics(c, batch=0)):
        with pytest.raises(ValueError):
            bad()
    stats = C.cumulative_statistics(c.withColumn("block_id", F.floor(F.col("pos") / 2).cast("int")), 0.3).orderBy("partitions").collect()
    assert [(r["total"], r["merged"]) for r in stats] == [(2, 1), (4, 2), (6, 3)]


def test_streamed_fold(spark, tmp_path):
    rows = [(b, i, [float(b % 2), float(i)]) for b in range(4) for i in range(3)]
    for b in range(4):
        spark.createDataFrame([r for r in rows if r[0] == b], "block_id int, center_index int, center array<double>").coalesce(1).write.parquet(f"{tmp_path}/in/b={b}")
    stream = spark.readStream.schema("block_id int, center_index int, center array<double>").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    fold.fold_stream(stream, f"{tmp_path}/state", f"{tmp_path}/log", 0.5).awaitTermination()
    assert fold.current_centers(spark, f"{tmp_path}/state").count() == 6
    fold.fold_batch(spark.createDataFrame([r for r in rows if r[0] == 0], "block_id int, center_index int, center array<double>"), 0, f"{tmp_path}/state", 0.5)
    assert fold.current_centers(spark, f"{tmp_path}/state").count() == 6 and fold.fold_report(spark, f"{tmp_path}/state").count() == 4


def test_kmeans(spark):
    rows = [(i, [float(x) for x in p]) for i, p in enumerate([(1, 1, 1), (1.2, 1, 1), (0.9, 1.1, 1), (5, 5, 5), (5.1, 5, 5), (4.9, 5, 5.2), (9, 9, 9), (9.1, 9, 8.9)])]
    p = spark.createDataFrame(rows, "id bigint, v array<double>")
    start = np.array([[0.5] * 3, [4.5] * 3, [8.5] * 3, [100.0] * 3])
    c, n = K.lloyd(p, start)
    assert n <= 3 and np.allclose(c[3], 100.0) and np.allclose(c[2], [9.05, 9.0, 8.95])
    assert sorted((r["label"], r["n"]) for r in K.cluster_counts(K.assign_centers(p, c)).collect()) == [(0, 3), (1, 3), (2, 2)]
    assert K.cost(p, c) < K.cost(p, start)
    assert np.allclose(np.sort(K.library_kmeans(p, start[:3]), 0), np.sort(c[:3], 0), atol=1e-6)
    tie = spark.createDataFrame([(1, [0.5])], "id bigint, v array<double>")
    assert K.assign_centers(tie, np.array([[0.0], [1.0]])).first()["label"] == 0
    with pytest.raises(ValueError):
        K.assign_centers(p, np.empty((0, 3)))
    with pytest.raises(ValueError):
        K.center_matrix(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "center array<double>"))


@pytest.mark.parametrize("name", ["window_average", "two_merges_grid", "peaks_only"])
def test_pipelines_find_the_clusters(spark, three, name):
    changes = {} if name == "peaks_only" else {"n_blocks": 1, "use_blocks": 1, "n_observers": 3, "knn": 5}
    out = pipelines.variant(three.select("id", "v"), name, **changes)
    found = np.array([r["center"] for r in out.centers.collect()])
    truth = np.array([[2, 2], [8, 3], [5, 8]])
    assert len(found) >= 1 and out.labels.count() == 150 and out.cost > 0
    assert np.sqrt(((found[:, None] - truth[None]) ** 2).sum(2)).min(1).max() < 4
