"""Registered reports run with the operators' own rounds and search width."""

import inspect

import pytest

from cairn.plans import cluster_queries, matrix_queries, pipelines

AT = "/root/testdata/sf0.001"


class Seen(Exception):
    pass


@pytest.mark.parametrize("module, at, name, arg, want", [
    (matrix_queries, pipelines, "seeded_kmeans_report", "rounds", 100), (cluster_queries, cluster_queries.K, "kmeans_library", "rounds", 100),
    (cluster_queries, cluster_queries, "local_models", "delta", 5), (cluster_queries, cluster_queries, "local_centers", "delta", 5),
])
def test_defaults(spark, monkeypatch, module, at, name, arg, want):
    operator = {"kmeans_library": "library_kmeans", "local_centers": "local_models"}.get(name, name)
    shape = inspect.signature(getattr(at, operator))

    def run(*args, **kw):
        given = shape.bind(*args, **kw)
        given.apply_defaults()
        assert given.arguments[arg] == want
        raise Seen

    monkeypatch.setattr(at, operator, run)
    with pytest.raises(Seen):
        module.QUERIES[name](spark, AT)
