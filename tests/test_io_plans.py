"""Sources and sinks, and properties every physical plan must have."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cohortline.operators.skew import carried, deal
from cohortline.session import LOCAL_FOLDER, cut_lineage, scratch_scope, shared_folder
from cohortline.sources import io

FOLDER = "/root/testdata/sf0.001"


def test_csv_with_index_and_bad_rows(spark, rows, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.5), (2, None, None)], "i long, s string, v double")
    io.write_csv(df.withColumn("row", F.col("i") * 10), str(tmp_path / "x"), index=["row"])
    assert rows(io.read_csv(spark, str(tmp_path / "x"), "i long, s string, v double", index=True)) == rows(df)
    with pytest.raises(Exception):
        io.read_csv(spark, str(tmp_path / "x"), "i long, s double, v double", index=True).collect()


def test_materialize_replaces(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    io.materialize(spark.range(5), path)
    again = io.materialize(spark.range(3), path, ["id"])
    assert rows(again) == [(0,), (1,), (2,)]
    assert rows(io.materialize(again.withColumn("id", F.col("id") + 5), path)) == [(5,), (6,), (7,)]
    with pytest.raises(Exception):
        io.materialize(spark.range(9).select(F.raise_error(F.lit("no")).cast("long").alias("id")), path)
    assert rows(spark.read.parquet(path)) == [(5,), (6,), (7,)]


def test_scratch_goes_with_its_scope(spark):
    import os

    kept = cut_lineage(spark.range(3))
    with pytest.raises(KeyError), scratch_scope(spark):
        inside = cut_lineage(spark.range(4))
        paths = [f.removeprefix("file:").removeprefix("//") for f in inside.inputFiles()]
        assert all(map(os.path.exists, paths))
        raise KeyError
    assert not any(map(os.path.exists, paths)) and kept.count() == 3


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    for name in ("left_side", "right_side"):
        io.save_table(spark.range(100).withColumn("v", F.rand(1)), name, 4, "id", str(tmp_path / name))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("left_side").join(spark.table("right_side"), "id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE left_side")
        spark.sql("DROP TABLE right_side")


def test_views(spark):
    io.register_views({"three": spark.range(3)}, prefix="v_")
    assert spark.sql("SELECT sum(id) FROM v_three").first()[0] == 3


def test_lineage_ends_in_the_folder_the_session_names(spark):
    folder = shared_folder(spark)
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert folder == (named or spark.sparkContext.getCheckpointDir())
    cut = cut_lineage(spark.range(10).withColumn("x", F.col("id") * 2))
    assert cut.agg(F.sum("x")).first()[0] == 90
    assert folder.removeprefix("file:") in cut.inputFiles()[0]


class _Session:
    """A session without a named folder, on a master of choice."""

    def __init__(self, spark, master):
        self.conf = self
        self.sparkContext = self
        self.master = master
        self._set = None

    def get(self, name, default):
        return default

    def getCheckpointDir(self):
        return self._set

    def setCheckpointDir(self, folder):
        self._set = folder


def test_no_machine_local_folder_on_a_cluster(spark):
    with pytest.raises(ValueError):
        shared_folder(_Session(spark, "spark://host:7077"))
    assert shared_folder(_Session(spark, "local[2]")) == LOCAL_FOLDER


def test_only_groups_in_several_tiles_are_carried(spark, rows):
    df = spark.range(1000).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id")).alias("k"), "id")
    dealt = deal(df, ["k"], ["id"], 10)
    sizes = [r["count"] for r in dealt.groupBy("_tile").count().collect()]
    assert len(sizes) == 10 and max(sizes) <= 2 * sum(sizes) / 10
    parts = dealt.groupBy("k", "_tile").agg(F.count(F.lit(1)).alias("n"))
    got = carried(parts, ["k"], skip=lambda whole, earlier: F.sum("n").over(earlier), all=lambda whole, earlier: F.sum("n").over(whole)).collect()
    assert {(r["k"], r["all"]) for r in got} == {(0, 400)} and len(got) >= 4
    assert sorted(r["skip"] or 0 for r in got)[0] == 0 and len({r["skip"] for r in got}) == len(got)


def plan_of(spark, name):
    return entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


LAZY = sorted(set(entry.oracle_sql()) - {"read_write_roundtrip"})


@pytest.mark.parametrize("name", LAZY)
def test_no_pairs_of_everything_and_no_python_rows(spark, name):
    plan = plan_of(spark, name)
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ArrowEvalPython", plan)


def test_scan_reads_only_what_is_used(spark):
    plan = plan_of(spark, "range_share_multi")
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in plan
    filtered = plan_of(spark, "any_flag_rows")
    assert "PushedFilters: [Or(" in filtered


def test_top_one_is_limited_before_the_shuffle(spark):
    plan = plan_of(spark, "last_by")
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")
