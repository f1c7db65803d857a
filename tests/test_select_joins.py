import pytest
from pyspark.sql import functions as F

from cohortline.operators import joins, select


def test_first_and_last_break_ties(spark, rows):
    df = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (1, 9, "c"), (2, None, "d")], "k long, t long, v string")
    assert rows(select.first_by(df, ["k"], "t", ["v"])) == [(1, 5, "a"), (2, None, "d")]
    assert rows(select.last_by(df, ["k"], "t", ["v"])) == [(1, 9, "c"), (2, None, "d")]


def test_peak_ignores_null_and_takes_earliest(spark, rows):
    df = spark.createDataFrame(
        [(1, 0, 3.0), (1, 10, 3.0), (1, 5, None), (1, 11, 9.0), (1, -1, 9.0), (2, 4, None)], "k long, t long, v double"
    )
    assert rows(select.peak_by(df, ["k"], "v", "t", 0, 10)) == [(1, 0, 3.0)]


def test_worst_puts_null_first(spark, rows):
    df = spark.createDataFrame([(1, 2, 5.0, 1), (1, 2, None, 2), (1, 1, 9.0, 3)], "k long, s int, c double, t long")
    assert rows(select.worst_by(df, ["k"], ["s", "c"], ["t"])) == [(1, 2, None, 2)]


def test_first_last_min_max_null_rule(spark, rows):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 4.0), (1, 3, 2.0)], "k long, t long, v double")
    assert rows(select.first_last_min_max(df, ["k"], "t", "v")) == [(1, 4.0, 2.0, 2.0, 4.0)]
    assert rows(select.first_last_min_max(df, ["k"], "t", "v", keep_null=True)) == [(1, None, 2.0, 2.0, 4.0)]


def test_reading_span_and_ordinals(spark, rows):
    data = [(1, -5, None), (1, 0, 1.0), (1, 3, None), (1, 7, 2.0), (1, 9, None), (2, 1, None)]
    df = spark.createDataFrame(data, "k long, t long, v double")
    assert rows(select.reading_span(df, ["k"], "t", ["v"])) == [(1, 0, 7, 2)]
    assert rows(select.reading_ordinals(df, ["k"], "t", ["v"])) == [(1, 2, 4)]


def test_ordinals_count_every_row_of_one_time(spark, rows):
    data = [(1, 0, None, 1), (1, 0, 1.0, 2), (1, 0, None, 3), (1, 5, None, 4), (1, 7, 2.0, 5), (1, 7, None, 6), (1, 8, None, 7), (1, None, 9.0, 8)]
    df = spark.createDataFrame(data, "k long, t long, v double, i long")
    assert rows(select.reading_ordinals(df, ["k"], "t", ["v"], ["i"])) == [(1, 2, 5)]
    assert rows(select.reading_ordinals(df, ["k"], "t", ["v"])) == [(1, 3, 6)]


def test_exclude_with_null_in_list(spark, rows):
    df = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    listed = spark.createDataFrame([(2,), (None,)], "k long")
    assert rows(joins.exclude(df, listed, "k")) == [(1,), (3,)]


def test_asof_interval_borders_and_fan_out(spark, rows):
    points = spark.createDataFrame([(1, 10), (1, 20), (1, 15), (1, 99), (2, 10)], "k long, t long")
    intervals = spark.createDataFrame(
        [(1, 10, 20, 1.0), (1, 14, 16, 2.0), (1, 99, 99, 3.0), (1, None, 5, 4.0)], "k long, s long, e long, w double"
    )
    got = rows(joins.asof_interval(points, intervals, "k", "t", "s", "e").select("k", "t", "w"))
    assert got == [(1, 10, 1.0), (1, 15, 1.0), (1, 15, 2.0), (1, 20, None), (1, 99, None), (2, 10, None)]


def test_band_join_equals_plain_condition(spark, rows):
    a = spark.range(200).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 100 - 50).alias("ta"))
    b = spark.range(150).select((F.col("id") % 4).alias("k"), (F.col("id") * 11 % 130 - 60).alias("tb"))
    want = a.join(b, "k").filter(F.col("tb").between(F.col("ta") - 9, F.col("ta") + 4))
    got = joins.band_join(a, b, "k", "ta", "tb", -9, 4)
    assert rows(got, "k", "ta", "tb") == rows(want, "k", "ta", "tb")


def test_band_join_left_keeps_unmatched(spark, rows):
    a = spark.createDataFrame([(1, 0), (1, 100), (2, 0)], "k long, ta long")
    b = spark.createDataFrame([(1, 3)], "k long, tb long")
    got = joins.band_join(a, b, "k", "ta", "tb", 0, 5, how="left")
    assert rows(got, "k", "ta", "tb") == [(1, 0, 3), (1, 100, None), (2, 0, None)]


def test_align_series(spark, rows):
    a = spark.createDataFrame([(1, 1, 5.0), (1, 2, None)], "k long, t long, a double")
    b = spark.createDataFrame([(1, 2, 7.0), (2, 9, 1.0)], "k long, t long, b double")
    got = rows(joins.align_series([a, b], ["k", "t"]), "k", "t", "a", "b")
    assert got == [(1, 1, 5.0, None), (1, 2, None, 7.0), (2, 9, None, 1.0)]


def test_left_any_match_and_intersection(spark, rows):
    base = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    a = spark.createDataFrame([(1, 5)], "k long, a int")
    b = spark.createDataFrame([(2, 6), (1, 7)], "k long, b int")
    assert rows(joins.left_any_match(base, [(a, "a"), (b, "b")], "k")) == [(1, 5, 7), (2, None, 6)]
    assert rows(joins.intersect_keys([base, a, b], "k")) == [(1,)]


@pytest.mark.parametrize("n", [1, 2])
def test_group_limit_is_planned(spark, n):
    df = spark.range(100).select((F.col("id") % 5).alias("k"), F.col("id").alias("v"))
    plan = select.pick_ranked(df, ["k"], [F.col("v").desc()], n)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_equals_plain_join(spark, rows, how):
    data = spark.range(300).select(
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 7).alias("k"),
        F.col("id").alias("v"),
    )
    side = spark.createDataFrame([(0, "a"), (1, "b"), (2, None), (None, "n"), (99, "z")], "k long, w string")
    got = joins.lookup_join(data, side, ["k"], how)
    want = data.join(side, "k", how)
    assert got.columns == want.columns and rows(got) == rows(want)


def test_asof_with_intervals_of_all_lengths(spark, rows):
    """A far end does not multiply the interval, and a point without an interval stays once."""
    import random

    rng = random.Random(5)
    spans = [(k, s, s + rng.choice([0, 1, 5, 40, 700, 10**15]), i) for i, (k, s) in enumerate((rng.randint(1, 3), rng.randint(-90, 90)) for _ in range(60))]
    points = [(rng.choice([1, 2, 4, None]), rng.choice([None, rng.randint(-100, 200)])) for _ in range(80)]
    got = joins.asof_interval(
        spark.createDataFrame(points, "k long, t long"), spark.createDataFrame(spans, "k long, s long, e long, i long"), "k", "t", "s", "e"
    )
    want = []
    for k, t in points:
        met = [(k, t, s, e, i) for j, s, e, i in spans if j == k and t is not None and s <= t < e]
        want += met or [(k, t, None, None, None)]
    assert got.columns == ["k", "t", "s", "e", "i"]
    assert rows(got) == sorted(want, key=lambda r: [(v is None, v) for v in r])


def hot_cell(spark, n):
    """A third of the rows at one key and time, a third at one key, and the rest spread."""
    i = F.col("id")
    third = F.when(i % 3 == 0, F.struct(F.lit(0).alias("k"), F.lit(500).alias("t")))
    third = third.when(i % 3 == 1, F.struct(F.lit(0).alias("k"), (i * 7 % 10_000).cast("int").alias("t")))
    third = third.otherwise(F.struct((i % 50).cast("int").alias("k"), (i * 13 % 10_000).cast("int").alias("t")))
    return spark.range(n).select(i.alias("i"), third.alias("p")).select("i", "p.k", "p.t")


def test_band_join_of_a_hot_cell(spark, rows, monkeypatch):
    monkeypatch.setattr(joins, "RUN", 16)
    a, b = hot_cell(spark, 600).withColumnsRenamed({"i": "ia", "t": "ta"}), hot_cell(spark, 450).withColumnsRenamed({"i": "ib", "t": "tb"})
    want = a.join(b, "k").filter(F.col("tb").between(F.col("ta") - 20, F.col("ta") + 3)).select("ia", "k", "ta", "ib", "tb")
    got = joins.band_join(a, b, "k", "ta", "tb", -20, 3).select("ia", "k", "ta", "ib", "tb")
    assert rows(got) == rows(want)
    left = joins.band_join(a, b, "k", "ta", "tb", -20, 3, how="left")
    assert rows(left.select("ia").distinct()) == rows(a.select("ia"))
    assert left.filter("ib is null").count() == a.count() - want.select("ia").distinct().count()


def test_a_hot_cell_is_spread_over_the_tasks(spark):
    """All pairs of the cell are one task's under a hash of (key, slice); here no task of the join has twice its share."""
    n = 1_200
    a, b = hot_cell(spark, n), hot_cell(spark, n)
    placed, listed = joins._points_by_interval(b, a, "k", "t", F.col("t") - 5, F.col("t") + 6)
    per_point = listed.groupBy("_key", "_number").count()
    assert per_point.agg(F.max("count")).first()[0] <= n / 3 + 20
    assert placed.groupBy("_key", "_number").count().agg(F.max("count")).first()[0] == 1
    dealt = listed.filter("_number is not null").repartition(8, "_key", "_number").groupBy(F.spark_partition_id()).count()
    sizes = [r["count"] for r in dealt.collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / 8


def test_left_band_join_keeps_rows_without_a_place(spark, rows):
    a = spark.createDataFrame([(1, 10, "x"), (1, 10, "x"), (None, 10, "y"), (1, None, "z"), (2, 5, "w")], "k long, ta long, n string")
    b = spark.createDataFrame([(1, 9, "e"), (1, None, "f"), (None, 10, "g")], "k long, tb long, m string")
    got = joins.band_join(a, b, "k", "ta", "tb", -5, 5, how="left").select("k", "ta", "n", "tb", "m")
    assert rows(got) == rows(spark.createDataFrame(
        [(1, 10, "x", 9, "e"), (1, 10, "x", 9, "e"), (None, 10, "y", None, None), (1, None, "z", None, None), (2, 5, "w", None, None)],
        "k long, ta long, n string, tb long, m string",
    ))
    assert joins.band_join(a.limit(0), b, "k", "ta", "tb", -5, 5).count() == 0
    assert joins.asof_interval(b, a.limit(0).withColumn("e", F.col("ta")), "k", "tb", "ta", "e").count() == 3
