"""One query over every scalar function family."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortline.catalog.registry import query
from cohortline.functions.exprs import body_mass_index, hours_between, ladder, nullif_zero
from cohortline.sources.io import load


@query(
    "scalar_functions",
    """SELECT o_orderkey, COALESCE(nullif(o_custkey, 0), -1) AS key_or_minus,
  GREATEST(o_custkey, CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS larger,
  LEAST(o_totalprice, 250000.0::DOUBLE) AS clipped, lower(o_orderpriority) AS low_text, substr(o_orderpriority, 1, 3) AS head,
  starts_with(o_orderpriority, '1-') AS urgent, regexp_matches(o_orderpriority, '(?i)^[12]-[uh]') AS pressing,
  rpad(substr(o_orderpriority, 1, 1), 5, ' ') AS padded, TRY_CAST(substr(o_orderpriority, 1, 1) AS SMALLINT) AS level,
  round(o_totalprice / 7, 2) AS seventh, round_even(o_custkey / 8.0, 2) AS even,
  o_orderdate + INTERVAL 24 HOUR AS in24, o_orderdate - INTERVAL 7 DAY AS week_before, o_orderdate + INTERVAL 1 YEAR AS year_after,
  (epoch_us(o_orderdate + INTERVAL 30 HOUR) - epoch_us(o_orderdate))::DOUBLE / 3600000000 AS hours,
  GREATEST(0, 30 - CAST(o_custkey % 50 AS INTEGER)) AS left_over, round((50 + o_custkey % 40) / power((150 + o_custkey % 50) / 100.0, 2), 6) AS bmi,
  CASE WHEN o_totalprice >= 400000 THEN 4 WHEN o_totalprice > 200000 THEN 2 ELSE 0 END AS rung FROM orders""",
)
def scalar_functions(spark, folder):
    key, person, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    text, day = F.col("o_orderpriority"), F.col("o_orderdate")
    return load(spark, folder, "orders").select(
        "o_orderkey",
        F.coalesce(nullif_zero("o_custkey"), F.lit(-1)).alias("key_or_minus"),
        F.greatest(person, F.when(F.col("o_orderstatus") == "F", key)).alias("larger"),
        F.least(price, F.lit(250000.0)).alias("clipped"),
        F.lower(text).alias("low_text"),
        F.substring(text, 1, 3).alias("head"),
        text.startswith("1-").alias("urgent"),
        text.rlike("(?i)^[12]-[uh]").alias("pressing"),
        F.rpad(F.substring(text, 1, 1), 5, " ").alias("padded"),
        F.substring(text, 1, 1).try_cast("short").alias("level"),
        F.round(price / 7, 2).alias("seventh"),
        F.bround(person / 8.0, 2).alias("even"),
        (day + F.expr("INTERVAL '24' HOUR")).alias("in24"),
        (day - F.expr("INTERVAL '7' DAY")).alias("week_before"),
        (day + F.expr("INTERVAL '1' YEAR")).alias("year_after"),
        hours_between(day, day + F.expr("INTERVAL '30' HOUR")).alias("hours"),
        F.greatest(F.lit(0), F.lit(30) - F.pmod(person, F.lit(50)).cast("int")).alias("left_over"),
        F.round(
            body_mass_index((F.lit(50) + F.pmod(person, F.lit(40))).cast("double"), (F.lit(150) + F.pmod(person, F.lit(50))).cast("double")), 6
        ).alias("bmi"),
        ladder([(price >= 400000, 4), (price > 200000, 2)], 0).alias("rung"),
    )
