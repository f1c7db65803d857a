import random
import re

import pytest
from pyspark.sql import functions as F

from cohortline.operators.quantiles import exact_quantiles
from cohortline.operators.timeseries import (
    Band,
    Trailing,
    any_in_window,
    median_in_window,
    net_balance,
    range_share,
    sum_distinct_rows,
    trailing_agg,
    within_span,
)


def test_range_share_borders(spark, rows):
    data = [
        (1, 0, 70.0), (1, 10, 80.0), (1, 20, 69.0), (1, 1440, 81.0), (1, 1441, 75.0), (1, -1, 75.0), (1, 5, None),
        (2, 5, None), (3, 2000, 75.0),
    ]
    df = spark.createDataFrame(data, "k long, t long, v double")
    got = rows(range_share(df, ["k"], "t", [Band("m", "v", 70, 80, 0, 1440)]))
    assert got == [(1, 0.5, 0.25, 0.25), (2, None, None, None), (3, None, None, None)]


def test_median_window_is_open(spark, rows):
    data = [(1, 0, 9.0), (1, 1, 1.0), (1, 2, 3.0), (1, 10, 99.0), (2, 3, None), (3, 5, 4.0)]
    df = spark.createDataFrame(data, "k long, t long, v double")
    assert rows(median_in_window(df, ["k"], "t", ["v"], {"a": 10})) == [(1, 2.0), (2, None), (3, 4.0)]
    closed = median_in_window(df, ["k"], "t", ["v"], {"a": 10}, low=None, open_high=False)
    assert rows(closed) == [(1, 6.0), (2, None), (3, 4.0)]


def test_any_in_window_and_within_span(spark, rows):
    df = spark.createDataFrame([(1, 5, 0), (1, 360, 1), (1, 10080, 0), (2, 10081, 1)], "k long, t long, f int")
    assert rows(any_in_window(df, ["k"], "t", "f", {"w": (360, 10080)})) == [(1, 1)]
    spans = spark.createDataFrame([(1, 5, 360), (2, 0, 1)], "k long, lo long, hi long")
    assert rows(within_span(df, spans, "k", "t", "lo", "hi"), "k", "t") == [(1, 5), (1, 360)]


def test_net_balance_equal_totals(spark, rows):
    a = spark.createDataFrame([(1, 5.0)], "k long, amount double")
    b = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 1.0)], "k long, amount double")
    out = spark.createDataFrame([(1, 4.0)], "k long, amount double")
    assert rows(net_balance([a, b], out, "k")) == [(1, 10.0, 4.0, 6.0), (2, 1.0, None, None)]
    assert rows(net_balance([a, b], out, "k", distinct=True)) == [(1, 5.0, 4.0, 1.0), (2, 1.0, None, None)]


def test_sum_distinct_rows(spark, rows):
    df = spark.createDataFrame([(1, 0, 5.0), (1, 0, 5.0), (1, 0, 6.0), (1, -1, 9.0)], "k long, t long, v double")
    assert rows(sum_distinct_rows(df, ["k"], "t", "v", 0, 10)) == [(1, 11.0)]


def brute(data, windows):
    out = []
    for k, t, v in data:
        row = [k, t, v]
        for w in windows:
            near = [
                (u, x)
                for j, u, x in data
                if None not in (j, k, t, u) and j == k and t - w.lookback <= u and (u <= t if w.current else u < t)
            ]
            values = [x for _, x in near if x is not None]
            if w.agg == "min_time":
                row.append(min((u for u, _ in near), default=None))
            else:
                row.append((min if w.agg == "min" else sum)(values) if values else None)
        out.append(tuple(row))
    return sorted(out, key=lambda r: [(x is None, x) for x in r])


def test_trailing_agg_against_brute_force(spark, rows):
    rng = random.Random(7)
    data = [(k, rng.randint(-200, 900), float(rng.randint(0, 40)) if rng.random() > 0.15 else None)
            for k in (1, 1, 1, 2, 3) for _ in range(60)]
    data += [(4, 10, 1.0), (4, 10, 2.0), (4, 60, 5.0), (4, 61, 7.0)]
    data += [(1, None, 5.0), (1, None, 3.0), (None, 10, 4.0), (None, 15, 6.0), (None, None, 1.0)]
    windows = [
        Trailing("m50", "min", 50),
        Trailing("m200", "min", 200),
        Trailing("s50", "sum", 50, True),
        Trailing("s333", "sum", 333, True),
        Trailing("f90", "min_time", 90, True),
        Trailing("f90x", "min_time", 90),
    ]
    df = spark.createDataFrame(data, "k long, t long, v double")
    assert rows(trailing_agg(df, "k", "t", "v", windows)) == brute(data, windows)


def test_trailing_agg_bounds_what_a_task_sorts(spark):
    """20,000 readings of one key a quarter of an hour apart: rows are dealt once, by key and tile of one look-back."""
    df = spark.range(20_000).select((F.col("id") % 1).alias("k"), (F.col("id") * 15).alias("t"), F.lit(1.0).alias("v"))
    out = trailing_agg(df, "k", "t", "v", [Trailing("s", "sum", 24 * 60, True), Trailing("m", "min", 60)])
    assert out.agg(F.max("s")).first()[0] == 97.0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Exchange hashpartitioning\((\w+)#\d+L?, (\w+)#", plan) == [("k", "_tile")]


def test_no_trailing_frame_is_replayed(spark):
    """Every frame begins at the first row of its cell, so each row enters an aggregate once."""
    df = spark.range(10).select((F.col("id") % 1).alias("k"), F.col("id").alias("t"), F.col("id").alias("v"))
    windows = [Trailing("a", "min", 7), Trailing("b", "sum", 7, True), Trailing("c", "min_time", 3, True)]
    plan = trailing_agg(df, "k", "t", "v", windows)._jdf.queryExecution().optimizedPlan().toString()
    frames = re.findall(r"specifiedwindowframe\((\w+), ([^,]+), ([^)]+\(?\)?)\)", plan)
    assert frames and all(begin == "unboundedpreceding$()" for _, begin, _ in frames)


def test_dense_readings_take_linear_time(spark):
    """Four times the readings in a look-back must not take ten times as long (16 if frames were replayed)."""
    import time

    def seconds(n):
        df = spark.range(0, n, 1, 1).select((F.col("id") % 1).alias("k"), F.col("id").alias("t"), (F.col("id") % 101).cast("double").alias("v"))
        out = trailing_agg(df, "k", "t", "v", [Trailing("s", "sum", n, True), Trailing("m", "min", n)])
        begin = time.perf_counter()
        assert out.agg(F.max("s")).first()[0] == df.agg(F.sum("v")).first()[0]
        return time.perf_counter() - begin

    seconds(1_000)
    assert seconds(160_000) < 5 * max(seconds(40_000), 0.4)


@pytest.mark.parametrize("by", [["k"], []])
@pytest.mark.parametrize("pieces", [None, 2, 37])
def test_exact_quantiles_by_selection(spark, rows, by, pieces):
    import numpy as np

    rng = random.Random(3)
    data = [(k, rng.choice([float(rng.randint(0, 9)), rng.gauss(0, 5), 2.5]), rng.random()) for k in (1, 1, 2) for _ in range(151)]
    data += [(3, None, 1.0), (3, None, None), (None, 4.0, 1.0), (None, 8.0, 1.0), (5, 1.5, None)]
    df = spark.createDataFrame(data, "k long, v double, w double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    out = exact_quantiles(df, by, {"v": F.col("v"), "w": F.when(F.col("w") > 0.5, F.col("w"))}, probs, pieces)
    groups = [1, 2, 3, None, 5] if by else ["all"]
    got = {r["k"] if by else "all": r for r in out.collect()}
    assert set(got) == set(groups)
    for g in groups:
        mine = [d for d in data if g == "all" or d[0] == g]
        for name, values in (
            ("v", [d[1] for d in mine if d[1] is not None]),
            ("w", [d[2] for d in mine if d[2] is not None and d[2] > 0.5]),
        ):
            if values:
                assert np.allclose(got[g][name], np.quantile(values, probs))
            else:
                assert got[g][name] is None


def test_quantiles_of_one_plan_for_all_group_sizes(spark):
    """A group with 200,000 distinct values beside 50,000 groups of one."""
    n = F.col("id")
    df = spark.range(250_000).select(
        F.when(n < 200_000, F.lit(-1)).otherwise(n).alias("k"), ((n * 7919) % 200_003).cast("double").alias("v")
    )
    out = exact_quantiles(df, ["k"], {"v": F.col("v")}, [0.5, 1.0])
    assert out.count() == 50_001
    values = sorted(float(i * 7919 % 200_003) for i in range(200_000))
    assert out.filter("k = -1").first()["v"] == [(values[99_999] + values[100_000]) / 2, values[-1]]
    assert out.filter("k = 210000").first()["v"] == [float(210_000 * 7919 % 200_003)] * 2
