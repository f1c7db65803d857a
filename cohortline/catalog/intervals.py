"""Queries on intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortline.catalog.frames import READINGS, rounded, readings, spans, stays, with_items
from cohortline.catalog.frames import SPANS, STAYS
from cohortline.catalog.registry import query
from cohortline.operators import intervals
from cohortline.operators.intervals import merge_intervals
from cohortline.plans.meds import vasopressor_hours, vasopressor_hours_timed
from cohortline.sources.io import load


def _merged(source: str, key: str = "l_partkey") -> str:
    return f"""m AS (SELECT {key}, min(s) AS "start", max(e) AS "end" FROM (
  SELECT *, sum(opens) OVER (PARTITION BY {key} ORDER BY s, e, l_orderkey ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY {key} ORDER BY s, e, l_orderkey
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS opens FROM {source}))
  GROUP BY {key}, island)"""


@query("merge_intervals", with_items(SPANS, _merged("spans")) + "SELECT * FROM m")
def merged(spark, folder):
    return merge_intervals(spans(spark, folder), ["l_partkey"], "s", "e")


@query("merge_intervals_dense", with_items(SPANS, _merged("spans", "l_suppkey")) + "SELECT * FROM m")
def merged_dense(spark, folder):
    return merge_intervals(spans(spark, folder), ["l_suppkey"], "s", "e")


@query(
    "merge_intervals_last_end",
    with_items(SPANS)
    + """SELECT l_partkey, min(s) AS "start", arg_max(e, n) AS "end" FROM (
  SELECT *, sum(opens) OVER (PARTITION BY l_partkey ORDER BY n) AS island FROM (
    SELECT *, CASE WHEN s > lag(e) OVER (PARTITION BY l_partkey ORDER BY n) THEN 1 ELSE 0 END AS opens FROM (
      SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY s, e, l_orderkey) AS n FROM spans)))
GROUP BY l_partkey, island""",
)
def merged_last_end(spark, folder):
    return merge_intervals(spans(spark, folder), ["l_partkey"], "s", "e", mode="last_end")


HORIZONS = (200, 1200, 2500)


@query(
    "covered_time",
    with_items(SPANS, _merged("(SELECT l_partkey, l_orderkey, greatest(s, 0) AS s, greatest(e, 0) AS e FROM spans)"))
    + "SELECT l_partkey, "
    + ", ".join(
        f'CAST(COALESCE(sum(CASE WHEN "start" <= {t} THEN least("end", {t}) - "start" END), 0) AS BIGINT) AS day_{t}'
        for t in HORIZONS
    )
    + " FROM m GROUP BY l_partkey",
)
def covered(spark, folder):
    cleaned = intervals.clean_intervals(spans(spark, folder), "s", "e")
    merged = merge_intervals(cleaned, ["l_partkey"], "s", "e")
    return intervals.covered_time(merged, ["l_partkey"], {f"day_{t}": t for t in HORIZONS})


@query(
    "vasopressor_hours",
    with_items(SPANS, _merged("(SELECT l_partkey, l_orderkey, greatest(s, 0) AS s, greatest(e, 0) AS e FROM spans)"))
    + "SELECT l_partkey AS patientunitstayid, "
    + ", ".join(
        f'round_even(COALESCE(sum(CASE WHEN "start" <= {t} THEN least("end", {t}) - "start" END), 0) / 60.0, 2) AS "{n}_hr"'
        for n, t in (("24hrs", 1440), ("48hrs", 2880), ("72hrs", 4320))
    )
    + " FROM m GROUP BY l_partkey",
)
def pressor_hours(spark, folder):
    orders = spans(spark, folder).select(
        F.col("l_partkey").alias("patientunitstayid"), F.col("s").alias("chartoffset"), F.col("e").alias("drugstopoffset")
    )
    return vasopressor_hours(orders)


@query(
    "inverted_intervals",
    """SELECT l_orderkey, l_linenumber, s, e, s - e AS overrun FROM (SELECT l_orderkey, l_linenumber,
  CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS BIGINT) AS e,
  CAST(l_quantity AS BIGINT) AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey) WHERE s > e""",
)
def inverted(spark, folder):
    orders = load(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    lines = load(spark, folder, "lineitem").join(orders, "l_orderkey")
    e = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")).cast("long")
    rows = lines.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("s"), e.alias("e"))
    return intervals.inverted_intervals(rows, "s", "e")


@query(
    "clipped_duration",
    with_items(STAYS)
    + """, t AS (SELECT l_orderkey, CAST(date_diff('hour', o_orderdate, l_shipdate) AS DOUBLE) AS s,
  CAST(date_diff('hour', o_orderdate, l_shipdate) AS DOUBLE) + l_quantity * 24 AS e
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT l_orderkey AS icustay_id, """
    + ", ".join(
        f"""round(sum(CASE WHEN {h} > s THEN {h} - s - greatest(0, {h} - e) ELSE 0 END), 4) + 0.0 AS first_{h}_vasso_hours,
  count(*) FILTER (CASE WHEN {h} > s THEN {h} - s - greatest(0, {h} - e) ELSE 0 END > 0) AS first_{h}_vasso_counts"""
        for h in (24, 48, 72)
    )
    + " FROM t GROUP BY l_orderkey",
)
def clipped(spark, folder):
    admitted = stays(spark, folder).select(F.col("stay").alias("icustay_id"), "intime")
    periods = load(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("icustay_id"),
        F.col("l_shipdate").alias("starttime"),
        (F.col("l_shipdate") + F.make_dt_interval(F.col("l_quantity").cast("int"))).alias("endtime"),
    )
    out = vasopressor_hours_timed(admitted, periods)
    return rounded(out, 4, *[f"first_{h}_vasso_hours" for h in (24, 48, 72)])


@query(
    "sum_duration",
    "SELECT l_suppkey, round(sum(l_quantity) / 24.0, 4) AS vent_duration_days FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY 1",
)
def durations(spark, folder):
    out = intervals.sum_duration(load(spark, folder, "lineitem"), ["l_suppkey"], "l_quantity", "vent_duration_days")
    return rounded(out, 4, "vent_duration_days")


@query(
    "merge_reading_sessions",
    with_items(READINGS)
    + """SELECT user_id, min(off) AS "start", max(off + 720) AS "end" FROM (
  SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY off, event_id) AS island FROM (
    SELECT *, CASE WHEN off > lag(off + 720) OVER (PARTITION BY user_id ORDER BY off, event_id) THEN 1 ELSE 0 END AS opens
    FROM r)) GROUP BY user_id, island""",
)
def sessions(spark, folder):
    """Half-day intervals opened by every reading, merged into sessions."""
    r = readings(spark, folder).withColumn("until", F.col("off") + 720)
    return merge_intervals(r, ["user_id"], "off", "until")
