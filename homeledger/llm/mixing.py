"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed up by cell (source, language, topic). Cell weights start at 1 and are raked in turn so
that weighted tokens meet the target shares of each source, language and topic. A document is kept with
its cell's probability, calibrated so that the expected tokens are `fraction` of all and meet the targets:
from min(1, c * weight), cells below 1 make up in turn for those at 1. A value whose target is more than all
its tokens cannot meet it at that fraction: it is kept whole and its shortage spread over the others by their
targets; a lower fraction has no such shortage. The draw is a hash of the row, so it is the same on every run
and cluster.

Up to MAX_CELLS cells are raked in numpy on the driver and come back as a broadcast table; more are raked
as a table in the shared folder, one step after another, and joined. Both give the same weights.

A topic column is used if there is one. Else a stand-in: the bucket (of TOPICS, by hash) that holds most of
a text's words of LONG bytes or more, -1 if it has none. Tokens are words as in decontamination. Null
source or lang is a value of its own. Texts without words weigh nothing and take their cell's probability.
Targets: {value: share} for a dimension, or an exponent that tempers the shares found (1 keeps them, 0
makes them equal); shares of values that do not occur are spread over the others. Repeated rows keep one
output row each; an empty table gives none. Very long texts are a block of their own. Columns of docs travel; those
named topic (as text), mix_tokens, weight, probability and sampled are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, mixed, prepare, runs, table, text_bytes, word_hashes, written
from .decontamination import _LOWER, _WORD

DIMENSIONS = ("source", "lang", "topic")
TARGETS: dict[str, float | Mapping] = {"source": 0.5, "lang": 0.5, "topic": 0.5}
FRACTION, STEPS, TOLERANCE, MAX_CELLS = 0.7, 100, 1e-9, 200_000
TOPICS, LONG, SEED = 12, 6, 20


def topics(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Topic and number of words of each text."""
    data, offs = text_bytes(column)
    data = _LOWER[data]
    starts, ends = runs(_WORD[data], offs)
    rows = np.searchsorted(offs, starts, "right") - 1
    n = len(column)
    long = np.flatnonzero(ends - starts >= LONG)
    bucket = (mixed(word_hashes(data, starts[long], ends[long])) % np.uint64(TOPICS)).astype(np.int64)
    counts = np.bincount(rows[long] * TOPICS + bucket, minlength=n * TOPICS).reshape(n, TOPICS)
    return np.where(counts.sum(axis=1) > 0, counts.argmax(axis=1), -1), np.bincount(rows, minlength=n)


def _annotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, "text"):
        topic, n = topics(batch.column("text"))
        keep = [c for c in batch.schema.names if c != "topic" and c != "mix_tokens"]
        named = batch.column("topic").cast(pa.string()) if "topic" in batch.schema.names else pa.array(topic.astype(str))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), named, pa.array(n.astype(np.int64))], [*keep, "topic", "mix_tokens"])


def annotated(docs: DataFrame) -> DataFrame:
    """docs with topic (as string), mix_tokens and mix_draw, a number in [0, 1) from the row's hash."""
    prepare(docs.sparkSession)
    docs = docs.drop("mix_tokens", "mix_draw")
    schema = docs.drop("topic").withColumn("topic", F.lit("")).withColumn("mix_tokens", F.lit(0).cast("long")).schema
    for f in schema:
        f.nullable = True
    draw = F.expr(f"shiftrightunsigned(xxhash64({SEED}, doc_id, text), 11) / {float(1 << 53)}")
    return docs.mapInArrow(_annotate, schema).withColumn("mix_draw", draw)


def shares(found: Mapping, target: float | Mapping) -> dict:
    """Target shares of the values found (value: tokens); they add up to 1."""
    raw = {k: (float(v) ** target if v > 0 else 0.0) if isinstance(target, (int, float)) else max(0.0, float(target.get(k, 0.0))) for k, v in found.items()}
    raw = {k: v if found[k] > 0 else 0.0 for k, v in raw.items()}
    total = sum(raw.values())
    return {k: v / total if total else 0.0 for k, v in raw.items()}


def rake(dims: list[np.ndarray], tokens: np.ndarray, wanted: list[np.ndarray], steps: int = STEPS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Weights of cells; dims: each cell's value number by dimension, wanted: shares by value."""
    weight, total = np.ones(len(tokens)), float(tokens.sum())
    for _ in range(steps):
        worst = 0.0
        for own, share in zip(dims, wanted, strict=True):
            got = np.bincount(own, weight * tokens, len(share))
            ratio = np.where(got > 0, share * total / np.where(got > 0, got, 1), 0.0)
            worst = max(worst, float(np.abs(got / max(total, 1e-300) - share).max(initial=0.0)))
            weight = weight * ratio[own]
        if worst < tolerance:
            break
    return weight


def scale(weight: np.ndarray, tokens: np.ndarray, fraction: float) -> float:
    """c such that min(1, c * weight) keeps that fraction of tokens, as far as weights allow."""
    goal, low, high = fraction * float(tokens.sum()), 0.0, 1.0
    reach = lambda c: float((np.minimum(1.0, c * weight) * tokens).sum())
    most = float(tokens[weight > 0].sum())
    goal = min(goal, most * (1 - 1e-12))
    while reach(high) < goal and high < 1e18:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if reach(mid) < goal else (low, mid)
    return high


def reachable(share: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Shares of at most `most` each; what these cannot take is spread over the others in proportion."""
    full = np.zeros(len(share), bool)
    while True:
        free = share[~full].sum()
        out = np.where(full, most, share * max(0.0, 1 - most[full].sum()) / (free or 1.0))
        more = ~full & (out > most)
        if not more.any():
            return out
        full |= more


def calibrate(p: np.ndarray, dims: list[np.ndarray], tokens: np.ndarray, wanted: list[np.ndarray], goal: float, steps: int = STEPS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Probabilities of at most 1 whose tokens are goal in all, with the wanted shares; from p by turns."""
    for _ in range(steps):
        worst = 0.0
        for own, share in zip(dims, wanted, strict=True):
            at_most = p >= 1
            full, free = np.bincount(own, np.where(at_most, tokens, 0.0), len(share)), np.bincount(own, np.where(at_most, 0.0, p * tokens), len(share))
            want, got = share * goal, full + free
            worst = max(worst, float(np.abs(got - want).max(initial=0.0)) / max(goal, 1e-300))
            up = np.where((want > got) & (free > 0), (want - full) / np.where(free > 0, free, 1), 1.0)
            down = np.where((want < got) & (got > 0), want / np.where(got > 0, got, 1), 1.0)
            p = np.minimum(1.0, p * (up * down)[own])
        if worst < tolerance:
            break
    return p


def _reachable_table(wanted: DataFrame, goal: float) -> DataFrame:
    """reachable() of (v, share, t): each value takes at most t of goal."""
    rows, count = wanted.withColumn("most", F.col("t") / F.lit(goal or 1.0)), -1
    out = F.col("share")
    while True:
        full = rows.withColumn("full", out > F.col("most"))
        got = full.agg(F.count_if("full"), F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)), F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("share")))).first()
        if got[0] == count or got[0] is None:
            return rows.select("v", F.least(out, F.col("most")).alias("share"))
        count, out = got[0], F.col("share") * F.lit(max(0.0, 1 - (got[1] or 0.0)) / (got[2] or 1.0))


def _calibrate_table(cells: DataFrame, wanted: Mapping, goal: float, steps: int, tolerance: float) -> DataFrame:
    """calibrate() of cells with probability."""
    p, t = F.col("probability"), F.col("tokens")
    for _ in range(steps):
        worst = 0.0
        for d in DIMENSIONS:
            got = cells.groupBy(d).agg(F.sum(F.when(p >= 1, t).otherwise(0)).alias("full"), F.sum(F.when(p >= 1, 0.0).otherwise(p * t)).alias("free"))
            got = got.join(wanted[d], F.col(d).eqNullSafe(F.col("v"))).select("v", "full", "free", (F.col("share") * goal).alias("want"), (F.col("full") + F.col("free")).alias("got"))
            got = written(got, "margins")
            worst = max(worst, (got.agg(F.max(F.abs(F.col("got") - F.col("want")))).first()[0] or 0.0) / max(goal, 1e-300))
            ratio = F.expr("CASE WHEN want > got AND free > 0 THEN (want - full) / free WHEN want < got THEN want / got ELSE 1.0D END")
            cells = cells.join(got, F.col(d).eqNullSafe(F.col("v"))).withColumn("probability", F.least(F.lit(1.0), p * ratio)).select(*DIMENSIONS, "tokens", "weight", "probability")
        cells = written(cells, "cells")
        if worst < tolerance:
            break
    return cells


def _rake_table(cells: DataFrame, targets: Mapping, fraction: float, steps: int, tolerance: float) -> DataFrame:
    """The same for more cells than the driver takes: every step is a sum by value and a join."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    cells, wanted = cells.withColumn("weight", F.lit(1.0)), {}
    for d in DIMENSIONS:
        found, target = cells.groupBy(d).agg(F.sum("tokens").alias("t")), targets[d]
        if isinstance(target, (int, float)):
            raw = F.when(F.col("t") > 0, F.pow(F.col("t").cast("double"), F.lit(float(target)))).otherwise(0.0)
        else:
            given = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in target.items()], f"k {cells.schema[d].dataType.simpleString()}, s double")
            found = found.join(given, found[d].eqNullSafe(given.k), "left").drop("k")
            raw = F.when(F.col("t") > 0, F.greatest(F.coalesce("s", F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
        found = found.select(F.col(d).alias("v"), "t", raw.alias("raw"))
        whole = found.agg(F.sum("raw")).first()[0] or 0.0
        wanted[d] = written(found.select("v", "t", (F.col("raw") / whole if whole else F.lit(0.0)).alias("share")), "shares")
    for _ in range(steps):
        worst = 0.0
        for d in DIMENSIONS:
            got = cells.groupBy(d).agg(F.sum(F.col("weight") * F.col("tokens")).alias("got"))
            got = written(got.join(wanted[d], F.col(d).eqNullSafe(F.col("v"))).select("v", "share", "got"), "margins")
            worst = max(worst, got.agg(F.max(F.abs(F.col("got") / F.lit(float(total) or 1.0) - F.col("share")))).first()[0] or 0.0)
            ratio = F.when(F.col("got") > 0, F.col("share") * float(total) / F.col("got")).otherwise(0.0)
            cells = cells.join(got, F.col(d).eqNullSafe(F.col("v"))).withColumn("weight", F.col("weight") * ratio).select(*DIMENSIONS, "tokens", "weight")
        cells = written(cells, "cells")
        if worst < tolerance:
            break
    goal = min(fraction * total, float(cells.where("weight > 0").agg(F.sum("tokens")).first()[0] or 0) * (1 - 1e-12))
    cells = cells.withColumn("probability", F.least(F.lit(1.0), F.col("weight") * _scale_table(cells, "weight", goal)))
    wanted = {d: written(_reachable_table(wanted[d], goal), "shares") for d in DIMENSIONS}
    cells = _calibrate_table(cells, wanted, goal, steps, tolerance)
    return cells.withColumn("probability", F.least(F.lit(1.0), F.col("probability") * _scale_table(cells, "probability", goal)))


def _scale_table(cells: DataFrame, column: str, goal: float) -> float:
    """scale() of a column of cells."""
    low, high = 0.0, 1.0
    reach = lambda c: cells.agg(F.sum(F.least(F.lit(1.0), F.col(column) * c) * F.col("tokens"))).first()[0] or 0.0
    while reach(high) < goal and high < 1e18:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if reach(mid) < goal else (low, mid)
    return high


def probabilities(rows: DataFrame, targets: Mapping = TARGETS, fraction: float = FRACTION, steps: int = STEPS, tolerance: float = TOLERANCE, max_cells: int = MAX_CELLS) -> tuple[DataFrame, bool]:
    """(source, lang, topic, tokens, weight, probability) by cell of annotated rows; whether they are few."""
    spark = rows.sparkSession
    cells = written(rows.groupBy(*DIMENSIONS).agg(F.sum("mix_tokens").alias("tokens")), "cells")
    if cells.count() > max_cells:
        return _rake_table(cells, targets, fraction, steps, tolerance), False
    got = sorted(cells.collect(), key=lambda r: tuple((r[d] is None, r[d] or "") for d in DIMENSIONS))
    tokens, dims, wanted = np.array([r.tokens for r in got], np.float64), [], []
    for d in DIMENSIONS:
        sums: dict = {}
        for r in got:
            sums[r[d]] = sums.get(r[d], 0) + r.tokens
        share, number = shares(sums, targets[d]), {k: i for i, k in enumerate(sums)}
        dims.append(np.array([number[r[d]] for r in got], np.int64))
        wanted.append(np.array([share[k] for k in sums]))
    weight = rake(dims, tokens, wanted, steps, tolerance)
    p, goal = np.minimum(1.0, scale(weight, tokens, fraction) * weight), min(fraction * float(tokens.sum()), float(tokens[weight > 0].sum()))
    can = [reachable(share, np.bincount(own, tokens, len(share)) / (goal or 1.0)) for own, share in zip(dims, wanted, strict=True)]
    p = calibrate(p, dims, tokens, can, goal, steps, tolerance)
    p = np.minimum(1.0, scale(p, tokens, fraction) * p)
    rows_out = [(*(r[d] for d in DIMENSIONS), int(r.tokens), float(w), float(x)) for r, w, x in zip(got, weight, p, strict=True)]
    return spark.createDataFrame(rows_out, "source string, lang string, topic string, tokens long, weight double, probability double"), True


def mix(docs: DataFrame, targets: Mapping = TARGETS, fraction: float = FRACTION, max_cells: int = MAX_CELLS) -> DataFrame:
    """docs with topic, mix_tokens, weight, probability and sampled."""
    extra = [c for c in ("weight", "probability", "sampled") if c in docs.columns]
    docs = docs.drop(*extra).withColumn("source", F.col("source").cast("string")).withColumn("lang", F.col("lang").cast("string"))
    narrow = annotated(docs.select("doc_id", "text", *DIMENSIONS[:2], *(["topic"] if "topic" in docs.columns else [])))
    cells, few = probabilities(narrow.select(*DIMENSIONS, "mix_tokens"), targets, fraction, max_cells=max_cells)
    cells = cells.select(*(F.col(d).alias(f"cell_{d}") for d in DIMENSIONS), "weight", "probability")
    on = [F.col(d).eqNullSafe(F.col(f"cell_{d}")) for d in DIMENSIONS]
    found = annotated(docs).join(F.broadcast(cells) if few else cells, on, "left")  # few: at most max_cells rows
    return found.withColumn("sampled", F.col("mix_draw") < F.col("probability")).drop("mix_draw", *(f"cell_{d}" for d in DIMENSIONS))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return found.select("doc_id", "source", "lang", "topic", F.col("mix_tokens").alias("n_tokens"), "weight", "probability", "sampled")
