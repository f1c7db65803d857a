"""Joins by their logical kind.

Equi joins are left to Catalyst: it broadcasts a side it knows to be small, and adaptive execution splits skewed
partitions where both sides come straight from an exchange. It does not where one side was aggregated on the
join key, the usual case for readings joined to one row per stay, so ``lookup_join`` writes that side first. Joins with
a time condition number the points of a key in time order and join on key and number: a key with a long history is
spread over all tasks and nothing is compared that does not meet.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.functions.exprs import floor_div
from cohortline.session import cut_lineage


def lookup_join(rows: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join many rows per key to a side with at most one row per key (inner, left, left_semi or left_anti).

    The side is written first. Its true size then decides about a broadcast, and where it is too large for one, both
    sides are plain exchanges whose hot keys adaptive execution splits. The rows are read once.
    """
    return rows.join(cut_lineage(side), list(keys), how)


def intersect_keys(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Keys present in every frame."""
    first, *rest = [f.select(key).distinct() for f in frames]
    return reduce(lambda a, b: a.join(b, key, "left_semi"), rest, first)


def enrich(base: DataFrame, arms: Sequence[tuple[DataFrame, str | Sequence[str]]]) -> DataFrame:
    """Star of left joins around a cohort. Every arm must be unique on its key (see ``dedupe``)."""
    for arm, key in arms:
        base = base.join(arm, key, "left")
    return base


def merge(a: DataFrame, b: DataFrame, key: str | Sequence[str], how: str = "left") -> DataFrame:
    return a.join(b, key, how)


def exclude(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not listed; a NULL in the list excludes nothing, a NULL key is kept."""
    return lookup_join(df, keys.select(key).distinct(), [key], "left_anti")


def restrict(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return lookup_join(df, keys.select(key).distinct(), [key], "left_semi")


def left_any_match(base: DataFrame, arms: Sequence[tuple[DataFrame, str]], key: str) -> DataFrame:
    """Left joins, keeping rows that met at least one arm. Each arm is ``(frame, column that is never NULL)``."""
    out = base
    for arm, _ in arms:
        out = out.join(arm, key, "left")
    return out.filter(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for _, c in arms]))


# Numbers of an interval's points are written out in runs of this many, so no row holds an unbounded list.
RUN = 4096


def _points_by_interval(
    points: DataFrame, intervals: DataFrame, key: str, at: str, low: Column, high: Column
) -> tuple[DataFrame, DataFrame]:
    """The points numbered per key in time order, and the intervals under the number of each point in ``[low, high)``.

    Gives ``_key, _number, _point`` and ``_key, _number, _interval``; an interval without points has one row
    without a number. The points of an interval are consecutive, so two counts say which they are and no point is compared
    with an interval that does not contain it: the work is that of the points, the intervals and the result.

    Points and the two ends of every interval stand in one order of (key, time), dealt into tiles of about equally many
    rows by a range partitioning, however they bunch up at one key or time. A tile counts its own points, and a tile that
    continues a key adds the points of the tiles before it; at most one key continues from one tile into the next, so
    these additions are fewer than the tiles. Equal intervals are one row until the end.
    """
    point = F.struct(*[F.col(c) for c in points.columns])
    interval = F.struct(*[F.col(c) for c in intervals.columns])
    none = {name: F.lit(None).cast(df.select(c).schema[0].dataType) for name, df, c in (("p", points, point), ("i", intervals, interval))}
    when = F.col(at).cast("long")
    stands = points.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).select(
        F.col(key).alias("_key"), when.alias("_at"), F.lit(1).alias("_is_point"), point.alias("_point"), none["i"].alias("_interval")
    )
    valid = intervals.filter(F.col(key).isNotNull() & (low < high))
    ends = valid.select(
        F.col(key).alias("_key"),
        F.explode(F.array(low.cast("long"), high.cast("long"))).alias("_at"),
        F.lit(0).alias("_is_point"),
        none["p"].alias("_point"),
        interval.alias("_interval"),
    )
    # Ends come before points of their time. A hash of the row orders what is otherwise equal.
    order = ["_at", "_is_point", "_hash"]
    events = stands.unionByName(ends).withColumn("_hash", F.xxhash64("_point", "_interval"))
    tiled = cut_lineage(events.repartitionByRange("_key", *order).withColumn("_tile", F.spark_partition_id()))

    in_tile = Window.partitionBy("_key", "_tile").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("_key").orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    counts = tiled.groupBy("_key", "_tile").agg(F.sum("_is_point").alias("_n"))
    carried = cut_lineage(counts.select("_key", "_tile", F.sum("_n").over(earlier).alias("_carried")).filter(F.col("_carried") > 0))
    number = F.sum("_is_point").over(in_tile)
    numbered = (
        tiled.withColumn("_number", number)
        .join(carried, ["_key", "_tile"], "left")
        .withColumn("_number", F.col("_number") + F.coalesce(F.col("_carried"), F.lit(0)))
    )
    placed = numbered.filter(F.col("_is_point") == 1).select("_key", "_number", "_point")
    # A point's number counts itself, so the points of an interval are those after its first end's count.
    spans = (
        numbered.filter(F.col("_is_point") == 0)
        .groupBy("_key", "_interval")
        .agg(F.min("_number").alias("_from"), F.max("_number").alias("_to"), (F.count(F.lit(1)) / 2).cast("int").alias("_copies"))
    )
    runs = F.when(F.col("_to") > F.col("_from"), F.sequence(floor_div(F.col("_from"), RUN), floor_div(F.col("_to") - 1, RUN)))
    in_runs = spans.withColumn("_run", F.explode_outer(runs)).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    own = F.sequence(
        F.greatest(F.col("_from"), F.col("_run") * RUN) + 1, F.least(F.col("_to"), (F.col("_run") + 1) * RUN)
    )
    listed = in_runs.select("_key", "_interval", F.explode_outer(F.when(F.col("_run").isNotNull(), own)).alias("_number"))
    return placed, listed


def band_join(
    base: DataFrame,
    events: DataFrame,
    key: str,
    base_time: str,
    event_time: str,
    low: int,
    high: int,
    how: str = "inner",
) -> DataFrame:
    """Events with ``base_time + low <= event_time <= base_time + high`` for the same key (``how`` inner or left).

    Times are integers. A base row stands for the interval of times it reaches, and is joined to its events by key and
    number (see ``_points_by_interval``), so keys and times at which most rows stand are spread like all others. With
    ``left`` a base row without an event, a NULL key or a NULL time stays, with NULLs.
    """
    first, last = F.col(base_time).cast("long") + low, F.col(base_time).cast("long") + high + 1
    placed, listed = _points_by_interval(events, base, key, event_time, first, last)
    pairs = listed.join(placed, ["_key", "_number"], how)
    others = [c for c in events.columns if c != key]
    out = pairs.select("_interval.*", *[F.col("_point")[c].alias(c) for c in others])
    if how == "inner":
        return out
    return out.unionByName(base.filter(F.col(key).isNull() | F.col(base_time).isNull()), allowMissingColumns=True)


def asof_interval(points: DataFrame, intervals: DataFrame, key: str, time: str, start: str, end: str) -> DataFrame:
    """Left join of points to the half-open intervals ``[start, end)`` of their key that contain them.

    Times are integers. Points and intervals are joined by key and number of the point (see ``_points_by_interval``), so an
    interval costs what it contains, however long it is, and intervals may overlap. A point with no interval, no key or no
    time stays with NULLs.
    """
    placed, listed = _points_by_interval(points, intervals, key, time, F.col(start), F.col(end))
    others = [c for c in intervals.columns if c != key]
    met = listed.filter(F.col("_number").isNotNull())
    out = placed.join(met, ["_key", "_number"], "left").select("_point.*", *[F.col("_interval")[c].alias(c) for c in others])
    return out.unionByName(points.filter(F.col(key).isNull() | F.col(time).isNull()), allowMissingColumns=True)


def union_keys(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct keys that occur in either series."""
    return a.select(*cols).unionByName(b.select(*cols)).distinct()


def align_series(series: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """All keys of all series with each series' columns beside each other.

    Each series has at most one row per key, so one grouping of the stacked rows replaces the union
    of keys and a join per series.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), series)
    values = [c for c in stacked.columns if c not in keys]
    return stacked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in values])
