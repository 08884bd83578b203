"""Every named variant is registered, and runs with its own values."""

import pytest

from cairn.plans import pipelines
from cairn.plans.cluster_queries import QUERIES

AT = "/root/testdata/sf0.001"


class Seen(Exception):
    pass


@pytest.mark.parametrize("name", sorted(pipelines.VARIANTS))
def test_variant_keeps_its_values(spark, monkeypatch, name):
    def run(points, plan, dim=None):
        assert plan == pipelines.VARIANTS[name]
        assert len(points.first()["v"]) == (10 if name.startswith("text_") else 64)
        raise Seen

    monkeypatch.setattr(pipelines, "run", run)
    with pytest.raises(Seen):
        QUERIES[f"pipeline_{name}"](spark, AT)
