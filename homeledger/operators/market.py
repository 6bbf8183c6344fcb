"""Market baselines and price value of listings.

A listing is compared with the other comparable ones (active, not of critical risk, 100 to 10,000 EUR/m2) on
four levels: same district, size band and rooms with the same series; with the same private rooms; district
alone; whole city. The first level with enough listings gives the baseline, else the city at any size.

The district level asks the same of all listings of equal district, area and declared rooms, the two narrower ones of those
that also share the series or the private rooms. So each level takes its samples once for each key of its own, with the listing
itself in them: one equi-join on district, series or private rooms, and a logarithmic area bucket (an area ratio in 0.8..1.2
spans at most one bucket), with the band as residual; equal values are counted before. Of a sorted sample only its size and
the four values in the middle go on: they give the median without any one of its values. So pairs grow with
keys, which are few beside listings, and no listing is paired with another. The city level needs no join at all:
leave-one-out medians from the middle order statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nulls, scores
from .order_stats import loo_median, middle_ranks, order_statistics_of

LEVELS = ("series_building", "ai_adjusted", "district", "riga")
MIN_SAMPLE, LOW, HIGH = 5, 100.0, 10_000.0
BUCKET = 0.25


def with_prices(listings: DataFrame) -> DataFrame:
    """Adds ppm2 (EUR per m2) and ppr (EUR per private room)."""
    return listings.withColumn("ppm2", nulls.ratio("price_eur", "area_m2")).withColumn("ppr", nulls.ratio("price_eur", "private_rooms"))


def comparable() -> Column:
    calm = nulls.keep_unless(F.col("risk") == "Critical")
    return nulls.require((F.col("status") == "active") & calm & (F.col("ppm2") >= LOW) & (F.col("ppm2") <= HIGH))


def candidates(listings: DataFrame) -> DataFrame:
    return with_prices(listings).where(comparable())


def city_medians(listings: DataFrame) -> DataFrame:
    """Adds (city_n, city_median), (room_n, room_median) and (price_n, price_median), each without the row itself."""
    rows = with_prices(listings).withColumn("normal", comparable())
    normal = rows.where("normal")
    kinds = {"city": F.col("ppm2"), "room": F.col("ppr"), "price": F.when(F.col("price_eur") > 0, F.col("price_eur").cast("double"))}
    n = normal.agg(*(F.count(v).alias(k) for k, v in kinds.items())).first()
    stats = order_statistics_of(normal, {k: (v, middle_ranks(n[k]), n[k]) for k, v in kinds.items()})
    for k, v in kinds.items():
        size, median = loo_median(v, F.col("normal") & v.isNotNull(), stats[k], n[k])
        rows = rows.withColumn(f"{k}_n", size).withColumn(f"{k}_median", median)
    return rows


def _bucket(area: Column) -> Column:
    return F.floor(F.log(area) / BUCKET).cast("int")


#: What a listing's district samples depend on: those of the district alone, and what the two narrower ones ask besides.
PLACE = ("district", "area_m2", "declared_rooms")
NARROWER = {"series": "series", "ai": "private_rooms", "district": None}


def _middle(pairs: DataFrame, own: list[str]) -> DataFrame:
    """(own, n, first, mid) of samples given as (own, v, c), c times the value v: size and up to four values in the middle, the first of them by rank from 1."""
    rows = pairs.groupBy(*own).agg(F.sum("c").alias("n"), F.sort_array(F.collect_list(F.struct("v", "c"))).alias("x"))
    rows = rows.withColumn("first", F.greatest(F.lit(1), F.floor((F.col("n") - 1) / 2)).cast("bigint"))
    taken = """aggregate(x, struct(0L AS seen, CAST(array() AS array<double>) AS mid), (a, y) -> struct(a.seen + y.c AS seen,
      CASE WHEN a.seen + y.c < first OR a.seen >= first + 3 THEN a.mid
           ELSE concat(a.mid, array_repeat(y.v, CAST(least(a.seen + y.c, first + 3) - greatest(a.seen, first - 1) AS int))) END AS mid), a -> a.mid)"""
    return rows.select(*own, "n", "first", F.expr(taken).alias("mid"))


def _medians() -> Column:
    """Of a sample given by _middle a struct (n, whole, p1, p2, r1, r2): its size, its median, and the values that the median of all but one v is made
    of: the mean of p1 if p1 < v, else p2, and r1 if r1 < v, else r2. Made once for each key, so that little is left to do for each row."""
    n = F.col("n")
    half = lambda k: F.floor(k / 2).cast("int")
    at = lambda k: F.try_element_at("mid", (k - F.col("first") + 1).cast("int"))
    whole = F.when(n % 2 == 1, at(half(n + 1))).otherwise((at(half(n)) + at(half(n) + 1)) / 2)
    rest = {"p1": half(n), "p2": half(n) + 1, "r1": half(n + 1), "r2": half(n + 1) + 1}
    return F.struct("n", whole.alias("whole"), *(F.when(n > 1, at(k)).alias(c) for c, k in rest.items()))


def _without(m: str, member: Column, own: Column) -> tuple[Column, Column]:
    """(size, median) of a sample given by _medians, without the own value if it is a member."""
    x = lambda c: F.col(f"{m}.{c}")
    left = lambda a, b: F.when(x(a) < own, x(a)).otherwise(x(b))
    return F.coalesce(x("n"), F.lit(0)) - member.cast("int"), F.when(member, (left("p1", "p2") + left("r1", "r2")) / 2).otherwise(x("whole"))


def _values(rows: DataFrame, own: list[str]) -> DataFrame:
    """(o_<own>, v, c): how often comparables that are alike have the same EUR/m2."""
    return rows.where("normal").groupBy(*(F.col(c).alias(f"o_{c}") for c in own), F.col("ppm2").alias("v")).agg(F.count("*").alias("c"))


def _samples(rows: DataFrame, narrower: str | None) -> DataFrame:
    """(own, n, first, mid): the middle of the sample of each (district, area, declared rooms) and, where asked, series or private rooms.

    Equal values of comparables that are alike in these are counted first, so that a value meets a key once.
    A missing or zero area or room count on either side puts no bound on the other; such areas meet every bucket
    through a key of their own.
    """
    own = [*PLACE, *([narrower] if narrower else [])]
    asked = nulls.filled("series").isNotNull() if narrower == "series" else F.col(narrower).isNotNull() if narrower else F.lit(True)
    key = rows.where(asked).select(*own).distinct()
    known = F.coalesce(F.col("area_m2") > 0, F.lit(False))
    # comparables always have a positive area (their EUR/m2 is known); keys may lack one
    key = key.withColumn("b", F.explode(F.when(known, F.array(*(_bucket(F.col("area_m2")) + d for d in (-1, 0, 1)))).otherwise(F.array(F.lit(None).cast("int")))))
    other = _values(rows.where(asked), own)
    same = F.col("district") == F.col("o_district")
    if narrower:
        same = same & (F.col(narrower) == F.col(f"o_{narrower}"))
    declared, o_declared = F.col("declared_rooms"), F.col("o_declared_rooms")
    rooms = (F.coalesce(declared, F.lit(0)) == 0) | (F.coalesce(o_declared, F.lit(0)) == 0) | (F.abs(o_declared - declared) <= 1)
    band = (F.col("o_area_m2") / F.col("area_m2")).between(0.8, 1.2)
    pairs = key.where("b IS NOT NULL").join(other.withColumn("o_b", _bucket(F.col("o_area_m2"))), same & (F.col("b") == F.col("o_b")) & band & rooms).select(*own, "v", "c")
    pairs = pairs.unionByName(key.where("b IS NULL").join(other, same & rooms).select(*own, "v", "c"))
    return _middle(pairs, own)


def with_levels(rows: DataFrame) -> DataFrame:
    """Adds n and median of the series, ai and district level to priced listings marked as normal or not; n is 0 without a sample."""
    local = rows.where(nulls.filled("district").isNotNull()).select(*PLACE, "private_rooms", "series", "ppm2", "normal")
    keys, names = (*PLACE, "private_rooms", "series"), {}
    key = local.select(*keys).distinct()
    for level, narrower in NARROWER.items():
        own = [*PLACE, *([narrower] if narrower else [])]
        taken = _samples(local, narrower)
        taken = taken.select(*(F.col(c).alias(f"k_{c}") for c in own), _medians().alias(names.setdefault(level, f"_{level}")))
        key = key.join(taken, _alike(own), "left").drop(*(f"k_{c}" for c in own))
    key = key.select(*(F.col(c).alias(f"k_{c}") for c in keys), *names.values())
    rows = rows.join(key, _alike(keys), "left").drop(*(f"k_{c}" for c in keys))
    member = F.col("normal") & nulls.filled("district").isNotNull()
    for level, own in (("series", nulls.require(nulls.filled("series").isNotNull())), ("ai", F.col("private_rooms").isNotNull()), ("district", F.lit(True))):
        n, median = _without(names[level], nulls.require(member & own), F.col("ppm2"))
        rows = rows.withColumn(f"{level}_n", n).withColumn(f"{level}_median", median)
    return rows.drop(*names.values())


def _alike(keys) -> Column:
    """Equal keys, nulls being equal; the other side's are named k_<key>."""
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"k_{c}"))
    return on


def level_medians(listings: DataFrame) -> DataFrame:
    """(listing_id, n and median of series, ai and district level) for listings with a district."""
    rows = with_prices(listings).where(nulls.filled("district").isNotNull()).withColumn("normal", comparable())
    return with_levels(rows).select("listing_id", *(f"{level}_{x}" for level in NARROWER for x in ("n", "median")))


def baselines(listings: DataFrame, least: int = MIN_SAMPLE) -> DataFrame:
    """Listings with their baseline: level, sample size and median rounded to cents (nulls without one)."""
    rows = with_levels(city_medians(listings))
    found = F.lit(None).cast("struct<level:string,n:bigint,median:double>")
    pick = lambda level, n, m: F.struct(F.lit(level).alias("level"), F.col(n).cast("bigint").alias("n"), F.round(m, 2).alias("median"))
    found = F.when(F.col("city_n") >= 1, pick(LEVELS[3], "city_n", "city_median")).otherwise(found)
    for level, k in ((LEVELS[2], "district"), (LEVELS[1], "ai"), (LEVELS[0], "series")):
        found = F.when(F.col(f"{k}_n") >= least, pick(level, f"{k}_n", f"{k}_median")).otherwise(found)
    rows = rows.withColumn("baseline", found)
    return rows.select("*", F.col("baseline.level").alias("baseline_level"), F.col("baseline.n").alias("baseline_n"), F.col("baseline.median").alias("baseline_median")).drop("baseline", "series_n", "series_median", "ai_n", "ai_median", "district_n", "district_median")


def price_value(listings: DataFrame, least: int = MIN_SAMPLE) -> DataFrame:
    """Baselines with the scores of price per m2, of private rooms, of the whole price, and their weighted mean."""
    rows = baselines(listings, least)
    usable = F.col("baseline_median").isNotNull() & F.col("ppm2").isNotNull()
    m2 = F.when(usable, scores.market_score("ppm2", "baseline_median"))
    room = F.when(usable & (F.col("room_n") >= 3), scores.market_score("ppr", "room_median"))
    whole = F.when(usable & (F.col("price_n") >= 3), scores.market_score(F.col("price_eur").cast("double"), "price_median"))
    rows = rows.withColumn("ppm2_score", m2).withColumn("room_score", room).withColumn("absolute_score", whole)
    mean = scores.weighted_mean([(F.col("ppm2_score"), 5), (F.col("ppm2_score"), 3), (F.col("room_score"), 2), (F.col("absolute_score"), 1)])
    low = usable & scores.suspiciously_low("ppm2", "baseline_median", "baseline_n")
    return rows.withColumn("price_value_score", F.when(usable, F.round(mean, 2))).withColumn("suspicious", F.coalesce(low, F.lit(False)))


def explanation() -> Column:
    return F.format_string("Baseline uses %d active comparable listings at %s level.", "baseline_n", "baseline_level")
