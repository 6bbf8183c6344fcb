"""District levels count equal values before keys meet them, and take each level's sample by its own key."""

import random
import statistics

from pyspark.sql import functions as F

from homeledger.operators import market


def _rows(spark, n, values):
    random.seed(7)
    pick = lambda xs: random.choice(xs)
    rows = [(i, pick(values), pick([None, 0.0, 40.0, 45.0, 50.0, 61.0]), pick(["A", "B", "", None]), pick([None, 0, 1, 2, 3, 4]), pick([None, 0, 1, 2]), pick(["x", "y", "", None]), pick(["Low", "Critical", None]), pick(["active", "inactive"])) for i in range(n)]
    return spark.createDataFrame(rows, "listing_id long, price_eur long, area_m2 double, district string, declared_rooms int, private_rooms int, series string, risk string, status string"), rows


def _wanted(rows):
    per = {r[0]: r[1] / r[2] if r[1] is not None and r[2] else None for r in rows}
    normal = [r for r in rows if r[8] == "active" and r[7] != "Critical" and per[r[0]] is not None and 100 <= per[r[0]] <= 10_000]
    out = {}
    for t in rows:
        if not t[3]:
            continue
        near = [c for c in normal if c[3] == t[3] and c[0] != t[0] and (not t[2] or 0.8 <= c[2] / t[2] <= 1.2) and (not t[4] or not c[4] or abs(c[4] - t[4]) <= 1)]
        samples = [[c for c in near if t[6] and c[6] == t[6]], [c for c in near if t[5] is not None and c[5] == t[5]], near]
        out[t[0]] = [(len(s), round(statistics.median([per[c[0]] for c in s]), 6) if s else None) for s in samples]
    return out


def test_levels_against_pairs(spark):
    for values in ([60_000, 60_000, 70_000, None], list(range(40_000, 90_000, 37))):
        df, rows = _rows(spark, 400, values)
        got = {r[0]: [(r[i], None if r[i + 1] is None else round(r[i + 1], 6)) for i in (1, 3, 5)] for r in market.level_medians(df).collect()}
        assert got == _wanted(rows)


def test_few_rows_meet_keys(spark):
    """1,000 copies of a few listings make no more pairs than the listings themselves."""
    df, _ = _rows(spark, 60, [60_000, 70_000])
    many = df.crossJoin(spark.range(1000).select(F.col("id").alias("copy"))).drop("copy").where("district <> ''")
    made = market._samples(market.with_prices(many).withColumn("normal", market.comparable()), None)
    assert made.agg(F.max(F.size("mid"))).first()[0] == 4
    joined = market._values(market.with_prices(many).withColumn("normal", market.comparable()), ["district", "area_m2", "declared_rooms"])
    assert joined.count() <= 60 and joined.agg(F.sum("c")).first()[0] > 10_000


def test_order_statistics_share_passes(spark, monkeypatch):
    """Several values take no more passes over the rows than one, and the ranks asked for are exact."""
    from homeledger.operators import order_stats

    monkeypatch.setattr(order_stats, "MOST", 50)
    random.seed(3)
    rows = [(random.random(), float(random.randrange(40)), random.choice([None, 1.5, 2.5])) for _ in range(400)]
    df, values = spark.createDataFrame(rows, "a double, b double, c double"), {k: sorted(r[i] for r in rows if r[i] is not None) for i, k in enumerate("abc")}
    wanted = {k: (F.col(k), [1, len(v) // 2, len(v)], len(v)) for k, v in values.items()}
    assert order_stats.order_statistics_of(df, wanted) == {k: {r: v[r - 1] for r in wanted[k][1]} for k, v in values.items()}

    def jobs(names):
        group = "passes-" + "".join(names)
        spark.sparkContext.setJobGroup(group, "")
        order_stats.order_statistics_of(df, {k: (F.col("a") + i, [200, 201], 400) for i, k in enumerate(names)})
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs("xyz") == jobs("x")
