"""Orders without a cap on rows."""

from homeledger.plans import queries as core
from homeledger.sources.bindings import bind


def test_orders_whole(spark, sf):
    pois = core.queries()["poi_order"](spark, sf).collect()
    assert sorted(r.position for r in pois) == list(range(1, bind(spark, sf, "pois").count() + 1)) and len(pois) > 40
    rows = bind(spark, sf, "market")
    n, missing = rows.count(), {r.listing_id for r in rows.where("transport_score IS NULL").collect()}
    found = core.queries()["ranking_null_last_sorts"](spark, sf).collect()
    assert len(found) == 4 * n and missing
    assert {r.listing_id for r in found if r.view == "transport" and r.position > n - len(missing)} == missing
