"""Decimals are rounded on the exact binary value, halves to even, as SQL's printf does."""

from homeledger.functions import text


def test_distances(spark):
    given = [1250.0, 2050.0, 1350.0, 999.5, 0.5, 1.5, 12345.678]
    df = spark.createDataFrame([(v,) for v in given], "v double")
    assert [r[0] for r in df.select(text.distance("v")).collect()] == [f"{v / 1000:.1f} km" if v >= 1000 else f"{v:.0f} m" for v in given]


def test_fixed(spark):
    given = [k / 20 for k in range(2000)] + [-1.25, 1234567.125]
    df = spark.createDataFrame([(v,) for v in given], "v double").coalesce(1)
    assert [tuple(r) for r in df.select(text.fixed("v", 1), text.fixed("v", 2)).collect()] == [(f"{v:.1f}", f"{v:.2f}") for v in given]
