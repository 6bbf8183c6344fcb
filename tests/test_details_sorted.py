"""No dimension of a listing goes through the driver, however small its file looks."""

import pytest

from homeledger.plans import queries as core


@pytest.mark.parametrize("name", ["detail_star", "detail_sections", "candidate_star_full", "map_points"])
def test_no_broadcast(spark, sf, name):
    plan = core.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan
