import random

import pytest
from pyspark.sql import functions as F

from cohortline.operators.intervals import (
    clean_intervals,
    clipped_duration,
    covered_time,
    equal_tiles,
    inverted_intervals,
    merge_intervals,
)

EDGE = [
    (1, 10, 20), (1, 12, 14), (1, 20, 25), (1, 30, 30), (1, 26, 27), (1, 10, 20),  # nested, touching, point, same
    (2, 5, 6), (2, 0, 1),
]


def merged_by_hand(data, mode):
    out = []
    for k in sorted({d[0] for d in data}):
        current = None
        for s, e in sorted((s, e) for j, s, e in data if j == k):
            if current is None or s > current[1]:
                if current:
                    out.append((k, *current))
                current = [s, e]
            else:
                current[1] = max(current[1], e) if mode == "union" else e
        out.append((k, *current))
    return sorted(out)


@pytest.mark.parametrize("mode", ["union", "last_end"])
@pytest.mark.parametrize("pieces", [None, 3, 12])
def test_merge_edges(spark, rows, mode, pieces):
    df = spark.createDataFrame(EDGE, "k long, s long, e long")
    assert rows(merge_intervals(df, ["k"], "s", "e", mode, pieces)) == merged_by_hand(EDGE, mode)


@pytest.mark.parametrize("mode", ["union", "last_end"])
@pytest.mark.parametrize("pieces", [None, 4, 50])
def test_merge_random(spark, rows, mode, pieces):
    rng = random.Random(11)
    data = [(k, s, s + rng.randint(0, 40)) for k in (1, 1, 1, 2) for s in [rng.randint(0, 9000) for _ in range(200)]]
    df = spark.createDataFrame(data, "k long, s long, e long")
    assert rows(merge_intervals(df, ["k"], "s", "e", mode, pieces)) == merged_by_hand(data, mode)


def test_union_covers_exactly_the_covered_minutes(spark):
    rng = random.Random(5)
    data = [(1, s, s + rng.randint(1, 30)) for s in [rng.randint(0, 2000) for _ in range(100)]]
    df = spark.createDataFrame(data, "k long, s long, e long")
    total = merge_intervals(df, ["k"], "s", "e").agg(F.sum(F.col("end") - F.col("start"))).first()[0]
    assert total == len({m for _, s, e in data for m in range(s, e)})


def test_clean_and_inverted(spark, rows):
    df = spark.createDataFrame([(1, -5, 10), (2, None, 3), (3, 9, 4), (4, -9, -2), (5, 3, None)], "k long, s long, e long")
    assert rows(clean_intervals(df, "s", "e")) == [(1, 0, 10), (4, 0, 0)]
    assert rows(inverted_intervals(df, "s", "e"), "k", "overrun") == [(3, 5)]


def test_covered_time_horizons(spark, rows):
    df = spark.createDataFrame([(1, 0, 100), (1, 150, 300), (2, 500, 600)], "k long, start long, end long")
    assert rows(covered_time(df, ["k"], {"a": 50, "b": 200, "c": 150})) == [(1, 50, 150, 100), (2, 0, 0, 0)]


def test_clipped_duration(spark, rows):
    df = spark.createDataFrame([(1, -2.0, 3.0), (1, 10.0, 30.0), (1, 50.0, 60.0), (2, 1.0, None)], "k long, s double, e double")
    got = rows(clipped_duration(df, ["k"], F.col("s"), F.col("e"), {"d": 24.0}))
    assert got[0] == (1, 5.0 + 14.0, 2)
    clipped = rows(clipped_duration(df, ["k"], F.col("s"), F.col("e"), {"d": 24.0}, clip_start=True))
    assert clipped[0] == (1, 3.0 + 14.0, 2)
    assert got[1] == (2, 23.0, 1)  # an open end runs to the horizon


@pytest.mark.parametrize("mode", ["union", "last_end"])
def test_tiles_hold_equally_many_rows_whatever_the_span(spark, rows, mode):
    """20,000 intervals of one key, one start far off: no tile has more than twice the mean."""
    data = spark.range(20_000).select(
        (F.col("id") % 1).alias("k"),
        F.when(F.col("id") == 7, F.lit(10**12)).otherwise(F.col("id") * 3).alias("start"),
    ).withColumn("end", F.col("start") + F.when(F.col("start") % 5 == 0, 9).otherwise(1))
    tiled, reached = equal_tiles(data, ["k"], mode, 64)
    counts = [r["_rows"] for r in reached.collect()]
    assert sum(counts) == tiled.count() == 20_000 and len(counts) >= 60
    assert max(counts) <= 2 * sum(counts) / len(counts)
    split = merge_intervals(data, ["k"], "start", "end", mode, 64)
    assert rows(split) == rows(merge_intervals(data, ["k"], "start", "end", mode))


def test_a_start_that_repeats_fills_no_tile(spark, rows):
    data = spark.range(6_000).select((F.col("id") % 1).alias("k"), F.when(F.col("id") < 5_000, 50).otherwise(F.col("id")).alias("s"))
    df = data.withColumn("e", F.col("s") + F.col("s") % 3)
    assert rows(merge_intervals(df, ["k"], "s", "e", pieces=30)) == rows(merge_intervals(df, ["k"], "s", "e"))
