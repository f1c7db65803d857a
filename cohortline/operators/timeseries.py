"""Operators on readings: a key, an integer or double time, values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.functions.exprs import floor_div, minutes_between
from cohortline.operators.joins import lookup_join
from cohortline.operators.quantiles import exact_quantiles


def complete_readings(df: DataFrame, names: Mapping[str, str], required: Sequence[str]) -> DataFrame:
    """Project and rename ``{new: old}``, keeping rows with every required value present."""
    return df.select(*[F.col(old).alias(new) for new, old in names.items()]).dropna(subset=list(required))


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def with_offset(
    readings: DataFrame, stays: DataFrame, key: str, time: str, origin: str, name: str = "chartoffset"
) -> DataFrame:
    """Minutes from the stay's start. ``stays`` has one row per key."""
    return (
        lookup_join(readings, stays.select(key, F.col(origin).alias("_origin")), [key])
        .withColumn(name, minutes_between("_origin", time))
        .drop("_origin")
    )


def within_span(readings: DataFrame, spans: DataFrame, key: str, time: str, low: str, high: str) -> DataFrame:
    """Readings inside their key's own time span (one span per key)."""
    bounds = spans.select(key, F.col(low).alias("_low"), F.col(high).alias("_high"))
    return (
        lookup_join(readings, bounds, [key])
        .filter((F.col(time) >= F.col("_low")) & (F.col(time) <= F.col("_high")))
        .drop("_low", "_high")
    )


def pivot_readings(
    df: DataFrame,
    keys: Sequence[str],
    series: Mapping[str, Column],
) -> DataFrame:
    """Entity-attribute-value readings to one row per key and time: the average of each masked series."""
    return df.groupBy(*keys).agg(*[F.avg(c).alias(name) for name, c in series.items()])


def median_in_window(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    values: Sequence[str],
    horizons: Mapping[str, float],
    low: float | None = 0,
    open_low: bool = True,
    open_high: bool = True,
    pieces: int | None = None,
) -> DataFrame:
    """Exact median of each value for each horizon in one pass; columns ``<value>_<horizon>``.

    Keys with no reading in a window get NULL. The window is open at both ends unless told otherwise.
    """
    t = F.col(time)
    measures = {}
    for label, horizon in horizons.items():
        inside = t < horizon if open_high else t <= horizon
        if low is not None:
            inside = inside & (t > low if open_low else t >= low)
        for v in values:
            measures[f"{v}_{label}"] = F.when(inside, F.col(v))
    wide = exact_quantiles(df, keys, measures, [0.5], pieces)
    return wide.select(*keys, *[F.col(m)[0].alias(m) for m in measures])


@dataclass(frozen=True)
class Band:
    """A value range to spend time in, for one column and one horizon; ``name`` prefixes the outputs."""

    name: str
    column: str
    low: float
    high: float
    start: float
    end: float


def range_share(df: DataFrame, keys: Sequence[str], time: str, bands: Sequence[Band]) -> DataFrame:
    """Share of present readings in, below and above each band within its closed time window.

    One grouping for all bands. Columns ``<name>_in``, ``<name>_below``, ``<name>_above``; NULL where
    the key has no present reading in the window.
    """
    aggs = []
    for b in bands:
        v = F.when(F.col(time).between(b.start, b.end), F.col(b.column))
        n = F.nullif(F.count(v), F.lit(0))
        for part, test in (("in", v.between(b.low, b.high)), ("below", v < b.low), ("above", v > b.high)):
            aggs.append((F.count_if(test) / n).alias(f"{b.name}_{part}"))
    return df.groupBy(*keys).agg(*aggs)


def any_in_window(
    df: DataFrame, keys: Sequence[str], time: str, flag: str, windows: Mapping[str, tuple[float, float]]
) -> DataFrame:
    """Largest flag per key within each closed window, all windows in one grouping."""
    t = F.col(time)
    widest = (min(w[0] for w in windows.values()), max(w[1] for w in windows.values()))
    return (
        df.filter(t.between(*widest))
        .groupBy(*keys)
        .agg(*[F.max(F.when(t.between(*w), F.col(flag))).alias(name) for name, w in windows.items()])
    )


def net_balance(inputs: Sequence[DataFrame], outputs: DataFrame, key: str, distinct: bool = False) -> DataFrame:
    """Summed ``amount`` over the input frames minus summed ``amount`` of the outputs, per key with inputs.

    ``distinct`` merges equal per-source totals of one key before adding them, as a UNION would.
    """
    totals = [f.groupBy(key).agg(F.sum("amount").alias("amount")) for f in inputs]
    stacked = reduce(lambda a, b: a.unionByName(b), totals)
    if distinct:
        stacked = stacked.distinct()
    taken = stacked.groupBy(key).agg(F.sum("amount").alias("total_input"))
    given = outputs.groupBy(key).agg(F.sum("amount").alias("total_output"))
    return taken.join(given, key, "left").withColumn("nettotal", F.col("total_input") - F.col("total_output"))


def sum_distinct_rows(df: DataFrame, keys: Sequence[str], time: str, value: str, low: float, high: float) -> DataFrame:
    """Sum per key over distinct (key, time, value) rows inside a closed time window."""
    return (
        df.filter(F.col(time).between(low, high))
        .select(*keys, time, value)
        .distinct()
        .groupBy(*keys)
        .agg(F.sum(value).alias(value))
    )


# --------------------------------------------------------------------------- trailing windows


@dataclass(frozen=True)
class Trailing:
    """``agg`` of the value over ``[t - lookback, t]``, or ``[t - lookback, t)`` without the current time.

    ``agg`` is ``min``, ``sum`` or ``min_time`` (earliest time that has a row in the window).
    """

    name: str
    agg: str
    lookback: int
    current: bool = False


def trailing_agg(df: DataFrame, key: str, time: str, value: str, windows: Sequence[Trailing]) -> DataFrame:
    """Every row with its trailing-window aggregates, NULL where the window is empty or the key or time is NULL.

    ``time`` is a long. A range self-join or a sliding frame does work that grows with the square of the readings in a
    look-back. Here every row is aggregated twice per look-back, however dense the readings are: time is cut
    into cells of one look-back, so a window is the end of the cell before and the beginning of its own, and both are
    running aggregates (``_with_look_back``).

    Rows are dealt once, by key and tile of the longest look-back. Each row also stands in the next tile, as context;
    shorter look-backs use what of it they reach. A task sorts the readings of one key within two look-backs.
    """
    look_backs = sorted({w.lookback for w in windows}, reverse=True)
    width = look_backs[0] + 1
    placed = F.col(key).isNotNull() & F.col(time).isNotNull()
    at = floor_div(F.col(time), width)
    # Rows without a place have no windows; a hash of the row spreads them.
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(1 << 20))
    own = F.struct(F.when(placed, at).otherwise(spread).alias("at"), F.lit(False).alias("context"))
    after = F.struct((at + 1).alias("at"), F.lit(True).alias("context"))
    copies = F.when(placed, F.array(own, after)).otherwise(F.array(own))
    tiled = df.withColumn("_copy", F.explode(copies)).withColumns({"_tile": F.col("_copy.at"), "_context": F.col("_copy.context")})
    out = tiled.drop("_copy").repartition(F.col(key), F.col("_tile"))
    for reach in look_backs:
        out = out.filter(~F.col("_context") | (F.col(time) >= F.col("_tile") * width - reach))
        at_hand = [w for w in windows if w.lookback == reach]
        out = _with_look_back(out, key, time, value, at_hand, width, last=reach == look_backs[-1])
    return out.select(*df.columns, *[F.when(placed, F.col(w.name)).alias(w.name) for w in windows])


def _with_look_back(
    tiled: DataFrame, key: str, time: str, value: str, windows: Sequence[Trailing], width: int, last: bool
) -> DataFrame:
    """The windows of one look-back. After the last one context rows are no longer needed.

    The part of a window in its own cell runs forwards in time. For the part in the cell before, each row sends a
    copy into the next cell at its own time plus the look-back: the copies at or after a row's time are the rows that
    its window still reaches, so that part is a running aggregate backwards in time. Copies come first among equals. Neither
    frame is ever replayed, as both begin at the first row of a cell.
    """
    reach = windows[0].lookback
    t = F.col(time)
    cell = floor_div(t, reach + 1)
    forwards = Window.partitionBy(key, "_tile", "_cell").orderBy(time)
    out = tiled.withColumn("_cell", cell)
    out = out.withColumns(
        {
            f"_in_{i}": _total(w, time, value).over(forwards.rangeBetween(Window.unboundedPreceding, 0 if w.current else -1))
            for i, w in enumerate(windows)
        }
    )
    stays = F.struct(F.col("_cell").alias("cell"), t.alias("at"), F.lit(False).alias("sent"))
    sent = F.struct((F.col("_cell") + 1).alias("cell"), (t + reach).alias("at"), F.lit(True).alias("sent"))
    reaches = F.col("_context") | ((F.col("_cell") + 1) * (reach + 1) < (F.col("_tile") + 1) * width)
    kept = ~F.col("_context") if last else F.lit(True)
    copies = F.array_compact(F.array(F.when(kept, stays), F.when(reaches, sent)))
    out = out.withColumn("_copy", F.explode(copies)).withColumns({"_cell": F.col("_copy.cell"), "_sent": F.col("_copy.sent")})
    backwards = (
        Window.partitionBy(key, "_tile", "_cell")
        .orderBy(F.col("_copy.at").desc(), F.col("_sent").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = out.withColumns({f"_before_{i}": _total(w, time, value, F.col("_sent")).over(backwards) for i, w in enumerate(windows)})
    both = {}
    for i, w in enumerate(windows):
        here, before = F.col(f"_in_{i}"), F.col(f"_before_{i}")
        both[w.name] = F.coalesce(here + before, here, before) if w.agg == "sum" else F.least(here, before)
    made = ["_cell", "_copy", "_sent", *[f"{part}_{i}" for part in ("_in", "_before") for i in range(len(windows))]]
    return out.filter(~F.col("_sent")).withColumns(both).drop(*made)


def _total(w: Trailing, time: str, value: str, only: Column | None = None) -> Column:
    """Sum or minimum as the window wants it, over the rows that count."""
    col = F.col(time if w.agg == "min_time" else value)
    col = col if only is None else F.when(only, col)
    return F.sum(col) if w.agg == "sum" else F.min(col)
