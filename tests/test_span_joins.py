import pytest

from spanloom.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["anchor_hints_whole", "enclosing_span", "nearest_k"])
def test_points_and_spans_are_not_broadcast(spark, name):
    out = catalog.queries()[name](spark, DATA)
    assert out.collect() and "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
