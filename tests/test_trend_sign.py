"""A fall of less than half a percent is a fall."""

from homeledger.operators import changes, views


def test_sign_of_small_changes(spark):
    rows = spark.sql("SELECT * FROM VALUES (1L, 1, 1000L), (1L, 2, 999L), (2L, 1, 1000L), (2L, 2, 1001L), (3L, 1, 100L), (3L, 2, 80L) AS t(listing_id, checked_at, price_eur)")
    got = views.history_lines(changes.price_trend(rows)).orderBy("listing_id").collect()
    assert [tuple(r) for r in got] == [(1, "-0%", "good"), (2, "+0%", "risk"), (3, "-20%", "good")]
