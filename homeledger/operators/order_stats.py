"""Exact order statistics and leave-one-out medians without a global sort.

One aggregate brackets the wanted ranks by approximate percentiles; a second one counts what lies below the bracket
and inside it; then the values inside it are taken. Several values go through these passes together. A bracket that still holds too many values is
narrowed again; one that percentiles narrow no further is halved by value, a rank at a time, until it holds few
values or a single one. So no task and no driver ever holds more than MOST values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 200_000


def order_statistics(df: DataFrame, value: Column, ranks: list[int], n: int) -> dict[int, float]:
    """Values by rank (from 1) of the n non-null values."""
    return order_statistics_of(df, {"v": (value, ranks, n)})["v"]


def _halved(rows: DataFrame, rank: int, low: float, high: float, below: int, inside: int) -> float:
    """The value of one rank in a bracket, by halving it; below: how many values lie under it."""
    ends = rows.where((F.col("v") >= low) & (F.col("v") <= high)).agg(F.min("v").alias("a"), F.max("v").alias("z")).first()
    low, high = ends.a, ends.z
    while low < high and inside > MOST:
        mid = low / 2 + high / 2
        mid = mid if low <= mid < high else low
        got = rows.where((F.col("v") >= low) & (F.col("v") <= high)).agg(F.count_if(F.col("v") <= mid).alias("n"), F.max(F.when(F.col("v") <= mid, F.col("v"))).alias("z"), F.min(F.when(F.col("v") > mid, F.col("v"))).alias("a")).first()
        if rank <= below + got.n:
            high, inside = got.z, got.n
        else:
            low, below, inside = got.a, below + got.n, inside - got.n
    if low == high:
        return low
    counted = rows.where((F.col("v") >= low) & (F.col("v") <= high)).groupBy("v").count().orderBy("v").collect()  # at most MOST values
    for r in counted:
        below += r["count"]
        if rank <= below:
            return r.v
    raise ValueError("no value has this rank")


def order_statistics_of(df: DataFrame, wanted: dict[str, tuple[Column, list[int], int]]) -> dict[str, dict[int, float]]:
    """The same for several values, by name, each given with its ranks and count; a pass over the rows is for all of them."""
    ranks = {k: sorted({r for r in ranks if 1 <= r <= n}) for k, (_, ranks, n) in wanted.items()}
    out: dict[str, dict[int, float]] = {k: {} for k in wanted}
    small = [k for k, (_, _, n) in wanted.items() if ranks[k] and n <= MOST]
    # brackets: (low, high, how many values lie below, how many inside)
    large = {k: (float("-inf"), float("inf"), 0, n) for k, (_, _, n) in wanted.items() if ranks[k] and n > MOST}
    rows = df.select(*(wanted[k][0].cast("double").alias(k) for k in [*small, *large]))
    if small:
        pick = lambda k: F.transform(F.array(*map(F.lit, ranks[k])), lambda r: F.try_element_at(F.sort_array(F.collect_list(k)), r))
        got = rows.agg(*(pick(k).alias(k) for k in small)).first()
        out |= {k: dict(zip(ranks[k], got[k], strict=True)) for k in small}
    inside = lambda k, low, high: (F.col(k) >= low) & (F.col(k) <= high)
    while wide := [k for k, x in large.items() if x[3] > MOST]:
        asked = []
        for k in wide:
            low, high, below, n = large[k]
            at = [max(0.0, (ranks[k][0] - below) / n - 1e-3), min(1.0, (ranks[k][-1] - below) / n + 1e-3)]
            asked.append(F.percentile_approx(F.when(inside(k, low, high), F.col(k)), at, 5000).alias(k))
        q = rows.agg(*asked).first()
        got = rows.agg(*(x for k in wide for x in (F.count_if(F.col(k) < q[k][0]).alias(f"b_{k}"), F.count_if(inside(k, *q[k])).alias(f"c_{k}")))).first()
        for k in wide:
            low, high, below, n = large[k]
            b, c = got[f"b_{k}"], got[f"c_{k}"]
            if c >= n or not b < ranks[k][0] or not ranks[k][-1] <= b + c:
                one = rows.select(F.col(k).alias("v")).where("v IS NOT NULL")
                out[k] = {r: _halved(one, r, low, high, below, n) for r in ranks[k]}
                del large[k]
            else:
                large[k] = q[k][0], q[k][1], b, c
    if large:
        taken = F.array(*(F.struct(F.lit(k).alias("k"), F.when(inside(k, low, high), F.col(k)).alias("v")) for k, (low, high, _, _) in large.items()))
        counted = rows.select(F.explode(F.filter(taken, lambda x: x.v.isNotNull())).alias("x")).groupBy("x.k", "x.v").count().orderBy("k", "v")
        seen, left = {k: x[2] for k, x in large.items()}, {k: list(ranks[k]) for k in large}
        for r in counted.toLocalIterator():
            seen[r.k] += r["count"]
            while left[r.k] and left[r.k][0] <= seen[r.k]:
                out[r.k][left[r.k].pop(0)] = r.v
    return out


def middle_ranks(n: int) -> list[int]:
    """Ranks (from 1) that medians of n and of n - 1 of the values can need."""
    return [k for k in range((n - 1) // 2, (n - 1) // 2 + 3) if 1 <= k <= n]


def loo_median(value: Column, member: Column, stats: dict[int, float], n: int) -> tuple[Column, Column]:
    """(sample size, median) of the values without the row's own, if the row is a member.

    With a[1..n] sorted and the own value v, the k-th of the others is a[k] if a[k] < v, else a[k + 1]; so the
    few middle values and n are enough for every row.
    """
    a = lambda k: F.lit(stats.get(k)).cast("double")
    other = lambda k: F.when(a(k) < value, a(k)).otherwise(a(k + 1))
    none = F.lit(None).cast("double")
    mean = lambda x, y: (x + y) / 2
    whole = none if n == 0 else a((n + 1) // 2) if n % 2 else mean(a(n // 2), a(n // 2 + 1))
    m = n - 1
    rest = none if m <= 0 else other((m + 1) // 2) if m % 2 else mean(other(m // 2), other(m // 2 + 1))
    return F.when(member, F.lit(m)).otherwise(F.lit(n)), F.when(member, rest).otherwise(whole)
