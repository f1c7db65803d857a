"""Exact quantiles per group, linear interpolation between order statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.operators.skew import attach, carried, deal


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    measures: Mapping[str, Column],
    probs: Sequence[float],
    pieces: int | None = None,
) -> DataFrame:
    """One row per group; each measure is an array with one quantile per probability, NULL if it has no value.

    One plan for groups of one row and of most of the table: equal values of a group become one row with their count, combined
    before the shuffle; these rows are dealt in the order of (group, measure, value) into tiles of equal size (see
    ``skew``). Running counts within a tile and what earlier tiles carry over give every value its ranks, and the values at the
    wanted ranks are summed up. No task holds or sorts more than a tile.
    """
    by, names, probs = list(by), list(measures), list(probs)
    cells = F.array(*[F.struct(F.lit(i).alias("m"), c.cast("double").alias("v")) for i, c in enumerate(measures.values())])
    long = df.select(*by, F.explode(cells).alias("_x")).select(*by, F.col("_x.m").alias("_m"), F.col("_x.v").alias("_v"))
    # A group without values keeps a row, with a count of 0.
    key = [*by, "_m"]
    dealt = deal(long.groupBy(*key, "_v").agg(F.count("_v").alias("_c")), key, ["_v"], pieces)

    parts = dealt.groupBy(*key, "_tile").agg(F.sum("_c").alias("_n"))
    others = carried(
        parts,
        key,
        _skip=lambda whole, earlier: F.coalesce(F.sum("_n").over(earlier), F.lit(0)),
        _all=lambda whole, earlier: F.sum("_n").over(whole),
    )
    in_tile = Window.partitionBy("_tile", *key)
    upto = in_tile.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = dealt.withColumn("_upto", F.sum("_c").over(upto)).withColumn("_own", F.sum("_c").over(in_tile))
    ranked = attach(counted, others, [*key, "_tile"], "left").select(
        *key,
        "_v",
        (F.coalesce("_skip", F.lit(0)) + F.col("_upto") - F.col("_c")).alias("_from"),
        (F.coalesce("_skip", F.lit(0)) + F.col("_upto")).alias("_to"),
        F.coalesce("_all", "_own").alias("_total"),
    )

    parts_of = {}
    for j, p in enumerate(probs):
        at = (F.col("_total") - 1) * F.lit(float(p))
        low, share = F.floor(at), at - F.floor(at)
        here = F.when((low >= F.col("_from")) & (low < F.col("_to")), F.col("_v") * (1 - share))
        above = F.when((share > 0) & (low + 1 >= F.col("_from")) & (low + 1 < F.col("_to")), F.col("_v") * share)
        parts_of[j] = F.coalesce(here + above, here, above)
    of_group = []
    for i, m in enumerate(names):
        mine = F.col("_m") == i
        wanted = F.array(*[F.sum(F.when(mine, parts_of[j])) for j in parts_of])
        of_group.append(F.when(F.max(F.when(mine, F.col("_total"))) > 0, wanted).alias(m))
    return ranked.groupBy(*by).agg(*of_group)
