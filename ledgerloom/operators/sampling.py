"""Deterministic samples by hash order: a walk from a pivot, strata in turn, one a session (SMP-1..11)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import sample_key


def pivot(seed: str) -> str:
    return hashlib.sha256(seed.encode()).hexdigest()[:16]


def keyed(units: DataFrame, unit_id: str) -> DataFrame:
    return units.withColumn("sample_key", sample_key(F.col(unit_id)))


def walk(seed: str, unit_id: str) -> list[Column]:
    """Order of the walk: from the seed's key up, then from the lowest (SMP-2)."""
    return [F.col("sample_key") < pivot(seed), F.col("sample_key"), F.col(unit_id)]


def random_sample(units: DataFrame, unit_id: str, count: int, seed: str) -> DataFrame:
    """The first `count` units of the walk: a bounded top-n, no shuffle of the units."""
    return keyed(units, unit_id).orderBy(*walk(seed, unit_id)).limit(count)


def one_per_session(units: DataFrame, unit_id: str, session: str, seed: str) -> DataFrame:
    """Each session's first unit in the walk (SMP-4)."""
    w = Window.partitionBy(session).orderBy(*walk(seed, unit_id))
    return keyed(units, unit_id).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def fold_small(units: DataFrame, group: str, least: int) -> DataFrame:
    """Strata with fewer than `least` units are 'other' (SMP-6)."""
    sizes = units.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    return units.join(sizes, group).withColumn(group, F.when(F.col("_n") < least, "other").otherwise(F.col(group))).drop("_n")


def stratified_sample(units: DataFrame, unit_id: str, group: str, count: int, seed: str) -> DataFrame:
    """Strata in turn, one unit each, until `count`; with more strata than that, the strata nearest the pivot by hashed key (SMP-3, SMP-11)."""
    ordered = keyed(units, unit_id)
    w = Window.partitionBy(group).orderBy(*walk(seed, unit_id))
    # no stratum can give more than `count`, so the window keeps so many rows before it shuffles
    placed = ordered.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= count)
    group_key = sample_key(F.col(group))
    turn = [F.col("turn"), group_key < pivot(seed), group_key, F.col(group)]
    return placed.orderBy(*turn).limit(count).orderBy(group, "sample_key", unit_id)


def group_sizes(units: DataFrame, dims: list[str]) -> DataFrame:
    """Groups and their sizes (SMP-5, SMP-7)."""
    return units.groupBy(*dims).agg(F.count(F.lit(1)).alias("n"))


def representative(prompts: DataFrame, session: str, unit_id: str, text: str, seed: str) -> DataFrame:
    """Each session's text: that of its first prompt at or after the pivot, wrapping (SMP-10)."""
    return keyed(prompts, unit_id).groupBy(session).agg(F.min_by(text, F.struct(F.col("sample_key") < pivot(seed), "sample_key", F.col(unit_id))).alias(text))
