"""Every registered query against its SQL, on the small tables."""

import os

import pytest
from compare import compare, connect

import __spark_entry__ as entry

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_agrees_with_sql(spark, con, name):
    assert compare(con, entry.queries()[name](spark, FOLDER), entry.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs_without_sql(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() > 0


SPLITTING = [
    "median_in_window",
    "median_by_key",
    "iqr_fence",
    "describe",
    "table_one",
    "merge_intervals",
    "merge_intervals_last_end",
    "covered_time",
    "cleaning_pipeline",
]


@pytest.mark.parametrize("name", SPLITTING)
def test_agrees_with_sql_when_groups_are_split(spark, con, name, monkeypatch):
    """The same answers when the rows are dealt into so many tiles that most groups lie in several."""
    from cohortline.operators import intervals, quantiles, skew

    def fine(df, keys, order, pieces=None):
        return skew.deal(df, keys, order, 40)

    monkeypatch.setattr(intervals, "deal", fine)
    monkeypatch.setattr(quantiles, "deal", fine)
    assert compare(con, entry.queries()[name](spark, FOLDER), entry.oracle_sql()[name]) == []


LEAN = ["trailing_min", "median_in_window", "rate_per_weight", "stage_from_trailing_rate", "worst_stage_window", "offset_table", "score_total"]


@pytest.mark.parametrize("name", LEAN)
def test_plans_read_each_table_a_few_times(spark, name):
    """Each supplied table stands at most three times in a plan, whatever the size."""
    leaves = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().collectLeaves()
    scans = [str(leaves.apply(i).toString()) for i in range(leaves.size())]
    columns = {t: spark.read.parquet(f"{FOLDER}/{t}.parquet").columns[0] for t in ("events", "orders", "lineitem", "customer")}
    for table, first in columns.items():
        count = sum(f"Relation [{first}#" in s for s in scans)
        assert count <= (6 if name in ("offset_table", "score_total") else 3), (table, count)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "prop_map_7d" in df.columns
