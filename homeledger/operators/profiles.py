"""Scoring profiles as a table: stored ones, built-in ones, the editor's view and saving from raw importance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import profile_slug
from . import scoring
from .read_models import BLOCK_LABELS

LEVELS = tuple(scoring.IMPORTANCE)


def builtin(spark: SparkSession) -> DataFrame:
    """(profile_key, profile_name, base_profile_key, weights, is_builtin): the built-in profiles; weights as JSON, ignored blocks left out."""
    level = {w: k for k, w in scoring.IMPORTANCE.items()}
    rows = [(p, p.replace("_", " ").capitalize(), None, "{" + ", ".join(f'"{b}": "{level[w]}"' for b, w in sorted(zip(scoring.BLOCKS, ws, strict=True)) if w) + "}", True) for p, ws in scoring.PROFILES.items()]
    return spark.createDataFrame(rows, "profile_key string, profile_name string, base_profile_key string, weights string, is_builtin boolean")


def known(stored: DataFrame) -> DataFrame:
    """Stored profiles, and the built-in ones that are not stored under their key."""
    own = builtin(stored.sparkSession)
    return stored.unionByName(own.join(stored.select("profile_key"), "profile_key", "left_anti").select(*stored.columns))


def profile_order() -> list[Column]:
    """Built-in ones first, then by name."""
    return [F.col("is_builtin").desc(), F.col("profile_name").asc()]


def importance(weights: str = "weights") -> Column:
    """map<block, level> of stored JSON: a block or level that is unknown or missing is ignored."""
    given = F.from_json(weights, "map<string,string>")
    level = lambda b: F.coalesce(F.when(given[b].isin(*LEVELS), given[b]), F.lit("Ignore"))
    return F.map_from_arrays(F.array(*map(F.lit, scoring.BLOCKS)), F.array(*(level(b) for b in scoring.BLOCKS)))


def editor(profiles: DataFrame) -> DataFrame:
    """(profile_key, name, is_builtin, position, block, label, importance): every block of every profile, in order of labels."""
    blocks = tuple(BLOCK_LABELS)
    own = profiles.withColumn("_i", importance())
    cells = F.array(*(F.struct(F.lit(i).alias("position"), F.lit(b).alias("block"), F.lit(BLOCK_LABELS[b]).alias("label"), F.col("_i")[b].alias("importance")) for i, b in enumerate(blocks, 1)))
    return own.select("profile_key", F.col("profile_name").alias("name"), "is_builtin", F.explode(cells).alias("x")).select("profile_key", "name", "is_builtin", "x.*")


def weights_of(profiles: DataFrame) -> DataFrame:
    """(profile_key, block_key, weight) of stored profiles, for scoring.scores_by_weights."""
    weight = F.create_map(*(F.lit(x) for kv in scoring.IMPORTANCE.items() for x in kv))
    rows = profiles.select("profile_key", F.explode(importance()).alias("block_key", "level"))
    return rows.select("profile_key", "block_key", weight[F.col("level")].alias("weight"))


def saved(stored: DataFrame, raw: DataFrame) -> DataFrame:
    """Stored profiles with custom ones from (base_key, name, importance map): keys from names, unknown entries skipped.

    A base that no profile has is not recorded. A custom profile of the same key is overwritten.
    """
    every = known(stored).select(F.col("profile_key").alias("_base"))
    fit = F.map_filter("importance", lambda k, v: k.isin(*scoring.BLOCKS) & v.isin(*LEVELS))
    text = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(fit))))
    rows = raw.join(every, raw.base_key == every._base, "left")
    made = rows.select(profile_slug("name").alias("profile_key"), F.trim("name").alias("profile_name"), F.col("_base").alias("base_profile_key"), text.alias("weights"), F.lit(False).alias("is_builtin"))
    return stored.join(made.select("profile_key"), "profile_key", "left_anti").unionByName(made.select(*stored.columns))
