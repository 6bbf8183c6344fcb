"""Every query of the listing engine against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from homeledger.plans import queries as core
from homeledger.sources import catalog
from homeledger.streaming import feed


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return None if math.isnan(v) else round(float(v), 6)
    return v


@pytest.mark.parametrize("name", core.queries())
def test_query(spark, sf, duck, name):
    df = core.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    sql = core.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    found = duck.sql(sql)
    place = {c: i for i, c in enumerate(found.columns)}
    assert sorted(place) == columns
    assert got == sorted(repr([plain(r[place[c]]) for c in columns]) for r in found.fetchall())


def test_flagship(spark, sf):
    rows = core.flagship(spark, sf).collect()
    assert [r.position for r in rows] == list(range(1, 21))


def test_catalog(spark, sf):
    names = catalog.register(spark, sf)
    assert spark.sql("SELECT count(*) AS n FROM scores JOIN profile_weights USING (profile_key) WHERE block_key = 'floor'").first().n > 0
    assert {"market", "scores"} <= set(names)


def test_stream(spark, sf, tmp_path):
    from homeledger.sources.bindings import bind

    rows = bind(spark, sf, "snapshots").withColumn("images", core.F.col("images").cast("long")).drop("event_id", "event_type")
    middle = rows.agg(core.F.percentile_approx("price_eur", 0.5)).first()[0]
    for i, part in enumerate(("price_eur <= {m} OR price_eur IS NULL", "price_eur > {m}")):
        rows.where(part.format(m=middle)).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = feed.run(spark, stream, f"{tmp_path}/out", f"{tmp_path}/check")
    q.awaitTermination(120)
    assert q.exception() is None
    state = spark.read.parquet(f"{tmp_path}/out/state/1")
    assert state.count() == rows.select("listing_id").distinct().count()
    assert spark.read.parquet(f"{tmp_path}/out/events").count() > 0
