"""Queries that pick rows, spans and stays."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortline.catalog.frames import DAY, PRESSURES, READINGS, STAYS, pressures, readings, rounded, stays, with_items
from cohortline.catalog.registry import query
from cohortline.operators import select
from cohortline.operators.joins import enrich, intersect_keys
from cohortline.operators.timeseries import with_offset
from cohortline.plans.cohort import charted_pressure_cohort, first_stay_cohort, pressure_cohort
from cohortline.sources.io import load


@query(
    "first_by_label",
    with_items(READINGS)
    + """SELECT user_id, event_type, value AS first_value, off AS first_off FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY off, event_id) AS n FROM r
  WHERE off BETWEEN -720 AND 10080) WHERE n = 1""",
)
def first_by_label(spark, folder):
    near = readings(spark, folder).filter(F.col("off").between(-720, 10080))
    firsts = select.first_by(near, ["user_id", "event_type"], "off", ["event_id"])
    return select.select_as(
        firsts, {"user_id": "user_id", "event_type": "event_type", "first_value": "value", "first_off": "off"}
    )


@query(
    "last_by",
    """SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders)
WHERE n = 1""",
)
def last_order(spark, folder):
    orders = load(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return select.last_by(orders, ["o_custkey"], "o_orderdate", ["o_orderkey"])


@query(
    "peak_by",
    with_items(READINGS)
    + """SELECT s.user_id, q.v AS peak, q.off AS peak_off, s.last_off - q.off AS gap FROM
  (SELECT user_id, max(off) AS last_off FROM r GROUP BY user_id) s LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v DESC NULLS LAST, off, event_id) AS n FROM r
  WHERE off BETWEEN 0 AND 10080 AND v IS NOT NULL) q ON q.user_id = s.user_id AND q.n = 1""",
)
def peak(spark, folder):
    r = readings(spark, folder)
    ends = r.groupBy("user_id").agg(F.max("off").alias("last_off"))
    top = select.peak_by(r, ["user_id"], "v", "off", 0, 10080, ["event_id"])
    top = select.select_as(top, {"user_id": "user_id", "peak": "v", "peak_off": "off"})
    return ends.join(top, "user_id", "left").withColumn("gap", F.col("last_off") - F.col("peak_off")).drop("last_off")


@query(
    "worst_by",
    with_items(READINGS)
    + """SELECT user_id, event_id, stage, v FROM (SELECT *, row_number() OVER (PARTITION BY user_id
  ORDER BY stage DESC NULLS FIRST, v DESC NULLS FIRST, event_id) AS n FROM (
  SELECT user_id, event_id, v, CASE WHEN v > 100 THEN 3 WHEN v > 50 THEN 2 WHEN v > 20 THEN 1 ELSE 0 END AS stage
  FROM r WHERE event_type <> 'error')) WHERE n = 1""",
)
def worst(spark, folder):
    v = F.col("v")
    stage = F.when(v > 100, 3).when(v > 50, 2).when(v > 20, 1).otherwise(0)
    r = readings(spark, folder).filter(F.col("event_type") != "error").withColumn("stage", stage)
    return select.worst_by(r, ["user_id"], ["stage", "v"], ["event_id"]).select("user_id", "event_id", "stage", "v")


@query(
    "first_last_min_max",
    """SELECT o_custkey,
  min(CASE WHEN up = 1 THEN price END) AS price_first, min(CASE WHEN down = 1 THEN price END) AS price_last,
  min(price) AS price_min, max(price) AS price_max FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS up,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS down
  FROM (SELECT o_custkey, o_orderdate, o_orderkey,
               CASE WHEN o_totalprice < 400000 THEN o_totalprice END AS price FROM orders))
GROUP BY o_custkey""",
)
def first_last(spark, folder):
    """A NULL on the first or last row is kept, as the row decides and not the value."""
    orders = load(spark, folder, "orders").select(
        "o_custkey",
        "o_orderdate",
        "o_orderkey",
        F.when(F.col("o_totalprice") < 400000, F.col("o_totalprice")).alias("price"),
    )
    return select.first_last_min_max(orders, ["o_custkey"], "o_orderdate", "price", ["o_orderkey"], keep_null=True)


@query(
    "dedupe_keyed",
    """SELECT o_custkey, o_orderstatus, o_orderkey, o_orderpriority FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderpriority, o_orderkey) AS n
  FROM orders) WHERE n = 1""",
)
def dedupe_keyed(spark, folder):
    orders = load(spark, folder, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", "o_orderpriority")
    return select.dedupe(orders, ["o_custkey", "o_orderstatus"], ["o_orderpriority", "o_orderkey"])


@query("distinct_rows", "SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(spark, folder):
    return select.distinct_rows(load(spark, folder, "orders"), ["o_custkey", "o_orderstatus", "o_orderpriority"])


@query(
    "span_hours",
    with_items(READINGS)
    + "SELECT user_id, round((max(off) - min(off)) / 60.0, 4) AS duration_hour FROM r GROUP BY user_id",
)
def span_hours(spark, folder):
    return rounded(select.span_hours(readings(spark, folder), ["user_id"], "off"), 4, "duration_hour")


@query(
    "span_over",
    with_items(READINGS)
    + """SELECT DISTINCT user_id, event_type, first_value(off) OVER a AS first_time,
  first_value(off) OVER d AS last_time, first_value(off) OVER d - first_value(off) OVER a AS first_last_interval
FROM r WINDOW a AS (PARTITION BY user_id, event_type ORDER BY off), d AS (PARTITION BY user_id, event_type ORDER BY off DESC)""",
)
def span_over(spark, folder):
    return select.span(readings(spark, folder), ["user_id", "event_type"], "off")


@query("first_event_no", "SELECT user_id, min(event_id) AS first_event FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def first_event_no(spark, folder):
    events = load(spark, folder, "events").filter(F.col("event_type") == "purchase")
    return events.groupBy("user_id").agg(F.min("event_id").alias("first_event"))


@query(
    "value_at_extremes",
    """SELECT user_id, max(CASE WHEN up = 1 THEN event_type END) AS first_event_type,
  max(CASE WHEN down = 1 THEN event_type END) AS last_event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS up,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS down FROM events) GROUP BY user_id""",
)
def extremes(spark, folder):
    return select.value_at_extremes(load(spark, folder, "events"), ["user_id"], "event_id", "event_type")


@query(
    "top_n",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""",
)
def top_n(spark, folder):
    orders = load(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return select.top_n(orders, 100, [F.col("o_totalprice").desc(), F.col("o_orderkey")])


SPAN_SQL = """SELECT user_id, max(CASE WHEN n = hi THEN off END) AS max_offset, max(CASE WHEN n = lo THEN off END) AS min_offset
FROM (SELECT *, max(CASE WHEN has THEN n END) OVER (PARTITION BY user_id) AS hi,
             min(CASE WHEN has THEN n END) OVER (PARTITION BY user_id) AS lo FROM (
  SELECT user_id, off, (ibp_systolic IS NOT NULL OR ibp_diastolic IS NOT NULL OR ibp_mean IS NOT NULL) AS has,
         row_number() OVER (PARTITION BY user_id ORDER BY off, event_id) AS n FROM p)) GROUP BY user_id"""


@query(
    "reading_span_cohort",
    with_items(READINGS, PRESSURES, f"s AS ({SPAN_SQL})")
    + f"""SELECT s.user_id, s.min_offset, s.max_offset FROM s
JOIN (SELECT user_id FROM p WHERE off BETWEEN 0 AND {10 * DAY} AND (ibp_systolic IS NOT NULL OR ibp_mean IS NOT NULL)
      GROUP BY user_id HAVING count(*) >= 8) c2 ON c2.user_id = s.user_id
JOIN (SELECT DISTINCT user_id FROM p WHERE off <= {10 * DAY}
      AND (ibp_mean IS NOT NULL OR (ibp_systolic IS NOT NULL AND ibp_diastolic IS NOT NULL))) c3 ON c3.user_id = s.user_id
WHERE s.min_offset <= {10 * DAY} AND s.max_offset - s.min_offset >= {10 * DAY}""",
)
def reading_span_cohort(spark, folder):
    return pressure_cohort(pressures(spark, folder), "user_id", "off", window=10 * DAY, min_readings=8)


@query(
    "reading_position_cohort",
    with_items(READINGS, PRESSURES, f"s AS ({SPAN_SQL})")
    + f"""SELECT s.user_id, s.min_offset, s.max_offset FROM s
JOIN (SELECT user_id FROM (SELECT user_id, ibp_systolic, ibp_mean,
        row_number() OVER (PARTITION BY user_id ORDER BY off, event_id) AS n FROM p WHERE off <= {10 * DAY})
      WHERE ibp_systolic IS NOT NULL OR ibp_mean IS NOT NULL GROUP BY user_id HAVING max(n) >= 22) c2
  ON c2.user_id = s.user_id
JOIN (SELECT DISTINCT user_id FROM p WHERE off <= {10 * DAY}
      AND (ibp_mean IS NOT NULL OR (ibp_systolic IS NOT NULL AND ibp_diastolic IS NOT NULL))) c3 ON c3.user_id = s.user_id
WHERE s.min_offset <= {10 * DAY} AND s.max_offset - s.min_offset >= {10 * DAY}""",
)
def reading_position_cohort(spark, folder):
    return pressure_cohort(
        pressures(spark, folder), "user_id", "off", window=10 * DAY, min_readings=22, by_position=True, ties=["event_id"]
    )


@query(
    "reading_span_only",
    with_items(READINGS, PRESSURES, f"s AS ({SPAN_SQL})")
    + f"SELECT user_id, min_offset, max_offset FROM s WHERE min_offset <= {DAY} AND max_offset - min_offset >= {27 * DAY}",
)
def reading_span_only(spark, folder):
    wide = pressure_cohort(pressures(spark, folder), "user_id", "off", window=DAY, span_only=True)
    return wide.filter(F.col("max_offset") - F.col("min_offset") >= 27 * DAY)


@query(
    "eav_cohort",
    """WITH b AS (SELECT user_id, ts, CASE WHEN event_type = 'click' AND value > 0 AND value < 100 THEN 'SBP'
    WHEN event_type IN ('view', 'signup') AND value > 0 AND value < 100 THEN 'DBP'
    WHEN event_type = 'error' AND value > 0 AND value < 60 THEN 'MBP' END AS kind FROM events),
t AS (SELECT b.*, epoch_us(first_value(b.ts) OVER a) - epoch_us(s.ts) AS f,
        epoch_us(first_value(b.ts) OVER d) - epoch_us(first_value(b.ts) OVER a) AS l
  FROM b JOIN (SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id) s ON s.user_id = b.user_id WHERE kind IS NOT NULL
  WINDOW a AS (PARTITION BY b.user_id ORDER BY b.ts), d AS (PARTITION BY b.user_id ORDER BY b.ts DESC))
SELECT user_id AS icustay_id, count(*) FILTER (kind = 'SBP') AS sbpcounts, count(*) FILTER (kind = 'DBP') AS dbpcounts,
  count(*) FILTER (kind = 'MBP') AS mbpcounts
FROM t WHERE f <= 86400000000 AND l >= 86400000000 GROUP BY user_id
HAVING mbpcounts >= 12 OR (sbpcounts >= 12 AND dbpcounts >= 12)""",
)
def eav_cohort(spark, folder):
    events = load(spark, folder, "events")
    codes = {"click": 51, "view": 8368, "signup": 8555, "error": 52}
    code = None
    for name, c in codes.items():
        code = F.when(F.col("event_type") == name, c) if code is None else code.when(F.col("event_type") == name, c)
    charts = events.select(
        F.col("user_id").alias("icustay_id"), F.col("ts").alias("charttime"), code.alias("itemid"), F.col("value").alias("valuenum")
    )
    admitted = events.groupBy(F.col("user_id").alias("icustay_id")).agg(F.min("ts").alias("intime"))
    admitted = admitted.withColumns({"first_hosp_stay": F.lit("Y"), "first_icu_stay": F.lit("Y")})
    items = {"sbp": ((51,), 0, 100), "dbp": ((8368, 8555), 0, 100), "mbp": ((52,), 0, 60)}
    return charted_pressure_cohort(charts, admitted, items)


@query(
    "first_stay_cohort",
    with_items(STAYS)
    + """SELECT person, stay, in_day FROM (SELECT *, row_number() OVER (PARTITION BY person, o_orderstatus
  ORDER BY in_day, stay) AS n FROM stays) WHERE n = 1
  AND stay IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) >= 100)""",
)
def first_stays(spark, folder):
    lines = load(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("stay")).agg(F.sum("l_quantity").alias("q"))
    return first_stay_cohort(
        stays(spark, folder), lines.filter(F.col("q") >= 100), ("person", "o_orderstatus"), "in_day", "stay"
    ).select("person", "stay", "in_day")


@query(
    "intersect_keys",
    """SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders
WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0""",
)
def intersection(spark, folder):
    orders, people = load(spark, folder, "orders"), load(spark, folder, "customer")
    return intersect_keys(
        [
            orders.filter(F.col("o_orderstatus") == "F"),
            orders.filter(F.col("o_orderpriority") == "1-URGENT"),
            people.filter(F.col("c_acctbal") > 0).withColumnRenamed("c_custkey", "o_custkey"),
        ],
        "o_custkey",
    )


@query(
    "with_offset",
    """SELECT e.event_id, e.user_id, CAST(epoch_us(e.ts) - epoch_us(s.ts) AS DOUBLE) / 60000000 AS chartoffset
FROM events e JOIN (SELECT user_id, min(ts) AS ts FROM events WHERE event_type = 'purchase' GROUP BY user_id) s
  ON s.user_id = e.user_id""",
)
def offsets(spark, folder):
    """Minutes from a person's first purchase, negative before it."""
    events = load(spark, folder, "events").select("event_id", "user_id", "event_type", "ts")
    starts = events.filter(F.col("event_type") == "purchase").groupBy("user_id").agg(F.min("ts").alias("intime"))
    return with_offset(events.select("event_id", "user_id", "ts"), starts, "user_id", "ts", "intime").drop("ts")


@query(
    "person_profile",
    """SELECT c.c_custkey, f.first_total, n.n_orders FROM customer c
LEFT JOIN (SELECT o_custkey, o_totalprice AS first_total FROM (SELECT *, row_number() OVER (
  PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1) f ON f.o_custkey = c.c_custkey
LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey) n ON n.o_custkey = c.c_custkey""",
)
def person_profile(spark, folder):
    """Rank-filtered rows joined on: first order and order count beside every customer."""
    orders = load(spark, folder, "orders").withColumnRenamed("o_custkey", "c_custkey")
    first = select.first_by(orders, ["c_custkey"], "o_orderdate", ["o_orderkey"])
    first = first.select("c_custkey", F.col("o_totalprice").alias("first_total"))
    count = orders.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    return enrich(load(spark, folder, "customer").select("c_custkey"), [(first, "c_custkey"), (count, "c_custkey")])
