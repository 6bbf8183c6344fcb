"""The comparison with all of its attribute rows."""

from homeledger.plans import queries as core


def test_comparison_whole(spark, sf):
    found = {r.row: r for r in core.queries()["comparison_transpose"](spark, sf).collect()}
    assert sorted(found) == list(range(14)) and found[8].label == "Transport score"
    assert found[8].l5 == found[7].l1 == "unknown" and found[7].l2 == "111 m"
