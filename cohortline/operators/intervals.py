"""Interval cleaning, merging and clipping. Interval ends are integers or doubles, in one unit per frame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.operators.skew import attach, carried, deal


def clamp_starts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Offsets before time zero become zero; NULL stays NULL."""
    return df.withColumns({c: F.when(F.col(c) < 0, F.lit(0).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c in cols})


def clean_intervals(df: DataFrame, start: str, end: str) -> DataFrame:
    """Clamp to time zero, then keep complete intervals that do not run backwards."""
    return clamp_starts(df, [start, end]).filter(F.col(start) <= F.col(end))


def inverted_intervals(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.filter(F.col(start) > F.col(end)).withColumn("overrun", F.col(start) - F.col(end))


def merge_intervals(
    df: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    mode: str = "union",
    pieces: int | None = None,
) -> DataFrame:
    """Merge overlapping and touching intervals per key into ``start``, ``end``.

    ``mode="union"`` covers every minute any interval covers. ``mode="last_end"`` ends a merged
    interval where its last member (by start, then end) ends, so a nested member shortens it.

    A two-level scan over tiles of about equally many starts, however many a key has and however far apart they lie (see
    ``skew``). Intervals with one start act like the longest of them, so they are reduced first. Each tile reports how far
    it reaches; where a key goes on in the next tile, that tile is told how far the tiles before it reached and how many
    merged intervals they opened.
    """
    keys = list(keys)
    tiled, reached = equal_tiles(df.select(*keys, F.col(start).alias("start"), F.col(end).alias("end")), keys, mode, pieces)
    by = [*keys, "_tile"]
    carry = F.max("_r") if mode == "union" else F.last("_r")
    before = carried(reached, keys, _carry=lambda whole, earlier: carry.over(earlier))

    in_tile = Window.partitionBy(*by).orderBy("start", "end")
    if mode == "union":
        here = F.max("end").over(in_tile.rowsBetween(Window.unboundedPreceding, -1))
        upto = F.greatest(here, F.col("_carry"))
    else:
        upto = F.coalesce(F.lag("end").over(in_tile), F.col("_carry"))
    opened = attach(tiled, before, by, "left").withColumn("_before", upto).withColumn(
        "_opens", F.when(F.col("_before").isNull() | (F.col("start") > F.col("_before")), 1).otherwise(0)
    )
    opens = opened.groupBy(*by).agg(F.sum("_opens").alias("_o"))
    offsets = carried(opens, keys, _offset=lambda whole, earlier: F.sum("_o").over(earlier))
    within = F.sum("_opens").over(in_tile.rowsBetween(Window.unboundedPreceding, 0))
    numbered = attach(opened.withColumn("_within", within), offsets, by, "left").withColumn(
        "_island", F.coalesce("_offset", F.lit(0)) + F.col("_within")
    )
    # Both ends are built before renaming, so the second aggregate still sees the member columns.
    merged = numbered.groupBy(*keys, "_island").agg(F.min("start").alias("_s"), _reach(mode).alias("_e"))
    return merged.drop("_island").withColumnsRenamed({"_s": "start", "_e": "end"})


def _reach(mode: str) -> Column:
    """How far the intervals of a group reach, as the mode sees it."""
    return F.max("end") if mode == "union" else F.max_by("end", F.struct("start", "end"))


def equal_tiles(
    df: DataFrame, keys: Sequence[str], mode: str = "union", pieces: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """One interval per key and start in tiles of equal row counts, and per key and tile ``_rows`` and how far it reaches, ``_r``."""
    longest = df.groupBy(*keys, "start").agg(F.max("end").alias("end"))
    tiled = deal(longest, keys, ["start"], pieces)
    return tiled, tiled.groupBy(*keys, "_tile").agg(F.count(F.lit(1)).alias("_rows"), _reach(mode).alias("_r"))


def covered_time(merged: DataFrame, keys: Sequence[str], horizons: Mapping[str, float]) -> DataFrame:
    """Covered time up to each horizon: intervals starting by then, cut at the horizon, summed."""
    cuts = [
        F.coalesce(
            F.sum(F.when(F.col("start") <= t, F.least(F.col("end"), F.lit(t)) - F.col("start"))), F.lit(0)
        ).alias(name)
        for name, t in horizons.items()
    ]
    return merged.groupBy(*keys).agg(*cuts)


def clipped_duration(
    df: DataFrame,
    keys: Sequence[str],
    start: Column,
    end: Column,
    horizons: Mapping[str, float],
    clip_start: bool = False,
) -> DataFrame:
    """Per key and horizon ``T``: summed length of ``[start, end]`` cut at ``T``, and how many are positive.

    Times are relative to the key's origin. A start before the origin counts in full unless
    ``clip_start`` is set. Columns are ``<name>_length`` and ``<name>_count``.
    """
    first = F.greatest(start, F.lit(0)) if clip_start else start
    aggs = []
    for name, t in horizons.items():
        length = F.when(F.lit(t) > start, F.lit(t) - first - F.greatest(F.lit(0), F.lit(t) - end)).otherwise(0)
        aggs += [
            F.sum(length).alias(f"{name}_length"),
            F.sum(F.when(length > 0, 1).otherwise(0)).alias(f"{name}_count"),
        ]
    return df.groupBy(*keys).agg(*aggs)


def sum_duration(df: DataFrame, keys: Sequence[str], hours: str, name: str, per: float = 24.0) -> DataFrame:
    return df.filter(F.col(keys[0]).isNotNull()).groupBy(*keys).agg((F.sum(hours) / per).alias(name))
