"""The supplied tables seen as the inputs the pipelines expect, in Spark and as SQL common tables.

``events`` are readings: the key is ``user_id``, the item ``event_type``, admission is one day after
the first event of a user, and a value counts as plausible strictly between 1 and 150.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.functions.exprs import epoch_micros, floor_div, mask_range
from cohortline.operators.joins import lookup_join
from cohortline.sources.io import load

MINUTE = 60_000_000
DAY = 1440
WEEKS = {"7d": 7 * DAY, "14d": 14 * DAY, "21d": 21 * DAY}

ITEMS = ("click", "error", "purchase", "signup", "view")

READINGS = f"""r AS (
  SELECT e.user_id, e.event_id, e.event_type, e.ts, e.value, epoch_us(e.ts) AS t_us,
         CASE WHEN e.value > 1 AND e.value < 150 THEN e.value END AS v,
         CAST((epoch_us(e.ts) - s.us0) // {MINUTE} AS BIGINT) - {DAY} AS off
  FROM events e
  JOIN (SELECT user_id, min(epoch_us(ts)) AS us0 FROM events GROUP BY user_id) s ON e.user_id = s.user_id)"""


def readings(spark: SparkSession, folder: str) -> DataFrame:
    events = load(spark, folder, "events").select(
        "user_id", "event_id", "event_type", "ts", "value", epoch_micros("ts").alias("t_us")
    )
    first = events.groupBy("user_id").agg(F.min("t_us").alias("_us0"))
    return (
        lookup_join(events, first, ["user_id"])
        .withColumn("v", mask_range("value", 1, 150))
        .withColumn("off", floor_div(F.col("t_us") - F.col("_us0"), MINUTE) - DAY)
        .drop("_us0")
    )


def item(name: str, value: str = "v") -> Column:
    return F.when(F.col("event_type") == name, F.col(value))


# Three "pressures" of one reading row: each event type is one series.
PRESSURES = """p AS (
  SELECT user_id, event_id, off, t_us,
         CASE WHEN event_type = 'click' THEN v END AS ibp_systolic,
         CASE WHEN event_type IN ('purchase', 'click') THEN v / 2 END AS ibp_diastolic,
         CASE WHEN event_type IN ('view', 'click') THEN v END AS ibp_mean
  FROM r)"""


def pressures(spark: SparkSession, folder: str) -> DataFrame:
    return readings(spark, folder).select(
        "user_id",
        "event_id",
        "off",
        "t_us",
        item("click").alias("ibp_systolic"),
        F.when(F.col("event_type").isin("purchase", "click"), F.col("v") / 2).alias("ibp_diastolic"),
        F.when(F.col("event_type").isin("view", "click"), F.col("v")).alias("ibp_mean"),
    )


# Orders as stays: the customer is the person.
STAYS = """stays AS (
  SELECT o_orderkey AS stay, o_custkey AS person, o_orderdate AS intime,
         CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS in_day,
         o_orderstatus, o_orderpriority, o_totalprice
  FROM orders)"""


def day_number(ts: str) -> Column:
    return F.datediff(F.col(ts).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")


def stays(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "orders").select(
        F.col("o_orderkey").alias("stay"),
        F.col("o_custkey").alias("person"),
        F.col("o_orderdate").alias("intime"),
        day_number("o_orderdate").alias("in_day"),
        "o_orderstatus",
        "o_orderpriority",
        "o_totalprice",
    )


# Line items as intervals of whole days: dense per supplier, with gaps per part.
SPANS = """spans AS (
  SELECT l_suppkey, l_partkey, l_orderkey,
         CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS s,
         CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) + CAST(l_quantity AS BIGINT) AS e
  FROM lineitem)"""


def spans(spark: SparkSession, folder: str) -> DataFrame:
    start = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long")
    return load(spark, folder, "lineitem").select(
        "l_suppkey", "l_partkey", "l_orderkey", start.alias("s"), (start + F.col("l_quantity").cast("long")).alias("e")
    )


def in_turn(values, number: str) -> Column:
    """Each of the values in turn, by a whole number."""
    listed = F.array(*[F.lit(v) for v in values])
    return listed[F.pmod(F.col(number), F.lit(len(values))).cast("int")]


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def with_items(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def chained_sql(source: str, a: str, b: str, x: str, rounds: int, ridge: float = 0.0) -> str:
    """WITH items up to ``chained``: ``source`` with ``<a>_impute`` and ``<b>_impute``, each filled in turn from the other and from ``x``.

    Least squares by the normal equations of two regressors. The ridge stands on the standardised regressors, so
    here on their variances.
    """
    items = [
        f"""cv AS (SELECT var_pop({x}) AS v_x, var_pop({a}) AS v_{a}, var_pop({b}) AS v_{b} FROM {source}),
cf0 AS (SELECT s.*, COALESCE({a}, avg({a}) OVER ()) AS {a}_impute, COALESCE({b}, avg({b}) OVER ()) AS {b}_impute FROM {source} s)"""
    ]
    for i in range(2 * rounds):
        y, z = (a, b) if i % 2 == 0 else (b, a)
        items.append(
            f"""cm{i} AS (SELECT avg({y}) AS my, avg({x}) AS mx, avg({z}_impute) AS mz, var_pop({x}) + {ridge} * any_value(v_x) AS sxx,
  var_pop({z}_impute) + {ridge} * any_value(v_{z}) AS szz, covar_pop({x}, {z}_impute) AS sxz, covar_pop({y}, {x}) AS syx,
  covar_pop({y}, {z}_impute) AS syz FROM cf{i}, cv WHERE {y} IS NOT NULL),
cf{i + 1} AS (SELECT cf{i}.* REPLACE (COALESCE({y}, my + ((syx * szz - syz * sxz) * ({x} - mx) + (syz * sxx - syx * sxz) * ({z}_impute - mz))
  / (sxx * szz - sxz * sxz)) AS {y}_impute) FROM cf{i}, cm{i})"""
        )
    return ",\n".join([*items, f"chained AS (SELECT * FROM cf{2 * rounds})"])
