"""Picking one row, or the ends of a series, per key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.operators.joins import lookup_join


def select_as(df: DataFrame, names: Mapping[str, str | Column]) -> DataFrame:
    """Project and rename: ``{new: old column or expression}`` in the given order."""
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in names.items()])


def distinct_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()


def pick_ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows per key. ``order`` must be total, else ties are not reproducible.

    Spark keeps only ``n`` rows per key in every map task before the shuffle (window group limit),
    so a key with very many rows does not travel.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def _asc(cols: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in cols]


def first_by(df: DataFrame, keys: Sequence[str], time: str, ties: Sequence[str] = ()) -> DataFrame:
    return pick_ranked(df, keys, [F.col(time).asc_nulls_last(), *_asc(ties)])


def last_by(df: DataFrame, keys: Sequence[str], time: str, ties: Sequence[str] = ()) -> DataFrame:
    return pick_ranked(df, keys, [F.col(time).desc_nulls_last(), *_asc(ties)])


def peak_by(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    time: str,
    low: float | None = None,
    high: float | None = None,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Row with the largest value with ``low <= time <= high``; NULL is never a peak, ties take the earliest."""
    if low is not None:
        df = df.filter(F.col(time) >= low)
    if high is not None:
        df = df.filter(F.col(time) <= high)
    df = df.filter(F.col(value).isNotNull())
    return pick_ranked(df, keys, [F.col(value).desc_nulls_last(), F.col(time).asc_nulls_last(), *_asc(ties)])


def worst_by(df: DataFrame, keys: Sequence[str], severity: Sequence[str], ties: Sequence[str] = ()) -> DataFrame:
    """Row ranked first by several descending columns, NULLs first as the source database ranks them."""
    return pick_ranked(df, keys, [*[F.col(c).desc_nulls_first() for c in severity], *_asc(ties)])


def dedupe(df: DataFrame, keys: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """One row per key, chosen by an explicit order."""
    return pick_ranked(df, keys, _asc(ties))


def first_stay(df: DataFrame, person: Sequence[str], visit: str, ties: Sequence[str] = ()) -> DataFrame:
    return first_by(df, person, visit, ties)


def first_last_min_max(
    df: DataFrame, keys: Sequence[str], time: str, value: str, ties: Sequence[str] = (), keep_null: bool = False
) -> DataFrame:
    """First and last value in time order, smallest and largest, in one map-side-combined aggregation.

    ``keep_null`` lets a NULL on the first or last row be the answer; by default NULLs are left out.
    """
    if not keep_null:
        df = df.filter(F.col(value).isNotNull())
    order = F.struct(time, *ties) if ties else F.col(time)
    return df.groupBy(*keys).agg(
        F.min_by(value, order).alias(f"{value}_first"),
        F.max_by(value, order).alias(f"{value}_last"),
        F.min(value).alias(f"{value}_min"),
        F.max(value).alias(f"{value}_max"),
    )


def value_at_extremes(df: DataFrame, keys: Sequence[str], order: str, attr: str) -> DataFrame:
    """The attribute on the first and the last row, without joining back."""
    return df.groupBy(*keys).agg(
        F.min_by(attr, order).alias(f"first_{attr}"), F.max_by(attr, order).alias(f"last_{attr}")
    )


def span(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """First and last time and the distance between them."""
    return df.groupBy(*keys).agg(
        F.min(time).alias("first_time"),
        F.max(time).alias("last_time"),
        (F.max(time) - F.min(time)).alias("first_last_interval"),
    )


def span_hours(df: DataFrame, keys: Sequence[str], minutes: str, name: str = "duration_hour") -> DataFrame:
    return df.groupBy(*keys).agg(((F.max(minutes) - F.min(minutes)) / 60.0).alias(name))


def reading_span(df: DataFrame, keys: Sequence[str], time: str, values: Sequence[str]) -> DataFrame:
    """Time of the first and last row with any value present, and how many such rows there are."""
    present = F.coalesce(*[F.col(v) for v in values]).isNotNull()
    at = F.when(present, F.col(time))
    return (
        df.groupBy(*keys)
        .agg(F.min(at).alias("min_offset"), F.max(at).alias("max_offset"), F.count(at).alias("n_present"))
        .filter(F.col("n_present") > 0)
    )


def reading_ordinals(
    df: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], ties: Sequence[str] = ()
) -> DataFrame:
    """Ordinal, among all rows in time order, of the first and of the last row with any value present.

    Every row counts, rows of one time too; ``ties`` order them, and without it a row stands behind all rows of its
    time. Counts rows up to the two instead of numbering every row, so nothing is sorted per key.
    """
    place = F.struct(*[F.col(c) for c in (time, *ties)])
    placed = df.filter(F.col(time).isNotNull()).select(
        *keys, place.alias("_place"), F.coalesce(*[F.col(v) for v in values]).isNotNull().alias("_present")
    )
    at = F.when(F.col("_present"), F.col("_place"))
    ends = placed.groupBy(*keys).agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    return (
        lookup_join(placed, ends.filter(F.col("_first").isNotNull()), keys)
        .groupBy(*keys)
        .agg(
            F.count_if(F.col("_place") <= F.col("_first")).alias("min_pos"),
            F.count_if(F.col("_place") <= F.col("_last")).alias("max_pos"),
        )
    )


def top_n(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    return df.orderBy(*order).limit(n)
