"""Groups of any size, scanned in tiles.

A running sum or maximum over a group, or its order statistics, would send a whole group to one task. Here all rows are put in one order
of (keys, order columns) and dealt into tiles of about equally many rows by a range partitioning, whatever the sizes of
the groups. A tile scans its own part of a group; where a group goes on in the next tile, what the tiles before it amount to is
carried over. Only one group can go on from one tile into the next, so what is carried is a frame with no more rows than twice the
tiles. The plan is the same for groups of one row and for a group that is most of the table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.session import cut_lineage


def attach(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a frame with few rows per key; NULL keys meet. Catalyst broadcasts it if its size allows."""
    side = small.select(*[F.col(c).alias("_b_" + c) if c in keys else F.col(c) for c in small.columns])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col("_b_" + k)) for k in keys])
    return df.join(side, on, how).drop(*["_b_" + k for k in keys])


def deal(df: DataFrame, keys: Sequence[str], order: Sequence[str], pieces: int | None = None) -> DataFrame:
    """The rows with ``_tile``, tiles in the order of keys and order columns and of about equal row counts.

    The borders come from a sample of the values, so they follow where rows are and not how far apart. ``pieces`` is the number of
    tiles; without it the session's partitioning decides. What was dealt is written, so a task that runs again finds its
    tile as it was. Rows equal in all these columns share a tile; reduce them first.
    """
    by = [*keys, *order]
    ranged = df.repartitionByRange(pieces, *by) if pieces else df.repartitionByRange(*by)
    return cut_lineage(ranged.withColumn("_tile", F.spark_partition_id()))


def carried(parts: DataFrame, keys: Sequence[str], **columns: Callable[[Window, Window], Column]) -> DataFrame:
    """What goes into a tile from other tiles, for groups that lie in several: keys, ``_tile`` and the columns asked for.

    ``parts`` has one row per group and tile. A column is given the window over all of a group's tiles and the one over the
    tiles before. At most twice as many rows as tiles; written, so their size decides how they are joined.
    """
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    made = [make(whole, earlier).alias(name) for name, make in columns.items()]
    scanned = parts.select(*keys, "_tile", F.count(F.lit(1)).over(whole).alias("_tiles"), *made)
    return cut_lineage(scanned.filter(F.col("_tiles") > 1).drop("_tiles"))
