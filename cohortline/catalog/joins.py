"""Queries by kind of join."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortline.catalog.frames import READINGS, STAYS, readings, rounded, stays, with_items
from cohortline.catalog.registry import query
from cohortline.operators import joins
from cohortline.sources.io import load


@query(
    "exclude_keys",
    """SELECT c_custkey, c_mktsegment FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IS NOT NULL)""",
)
def exclude_keys(spark, folder):
    urgent = load(spark, folder, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    people = load(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    return joins.exclude(people, urgent.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query(
    "restrict_keys",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
)
def restrict_keys(spark, folder):
    debtors = load(spark, folder, "customer").filter(F.col("c_acctbal") < 0).withColumnRenamed("c_custkey", "o_custkey")
    return joins.restrict(load(spark, folder, "orders").select("o_orderkey", "o_custkey"), debtors, "o_custkey")


@query(
    "enrich_star",
    """SELECT c.c_custkey, c.c_name, n.n_name, g.r_name, o.n_orders, round(o.spent, 2) AS spent, e.n_events,
  round(e.mean_value, 6) AS mean_value
FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN region g ON g.r_regionkey = n.n_regionkey
LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS spent FROM orders GROUP BY o_custkey) o
  ON o.o_custkey = c.c_custkey
LEFT JOIN (SELECT user_id, count(*) AS n_events, avg(value) AS mean_value FROM events GROUP BY user_id) e
  ON e.user_id = c.c_custkey""",
)
def enrich_star(spark, folder):
    people = load(spark, folder, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey"))
    nation = load(spark, folder, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    orders = load(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey"))
    events = load(spark, folder, "events").groupBy(F.col("user_id").alias("c_custkey"))
    out = joins.enrich(
        people,
        [
            (nation, "n_nationkey"),
            (load(spark, folder, "region"), "r_regionkey"),
            (orders.agg(F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("spent")), "c_custkey"),
            (events.agg(F.count(F.lit(1)).alias("n_events"), F.avg("value").alias("mean_value")), "c_custkey"),
        ],
    )
    return rounded(rounded(out, 2, "spent"), 6, "mean_value").drop("n_nationkey", "r_regionkey")


@query(
    "outer_to_inner",
    """SELECT c.c_custkey, count(*) AS n, max(o.o_totalprice) AS top FROM customer c
LEFT JOIN orders o ON o.o_custkey = c.c_custkey WHERE o.o_totalprice BETWEEN 100000 AND 200000 GROUP BY c.c_custkey""",
)
def outer_to_inner(spark, folder):
    """A left join whose filter rejects missing right sides is written as the inner join it is."""
    orders = load(spark, folder, "orders").filter(F.col("o_totalprice").between(100000, 200000))
    people = load(spark, folder, "customer").select(F.col("c_custkey"))
    joined = joins.merge(people, orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "inner")
    return joined.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))


@query(
    "left_any_match",
    """SELECT c.c_custkey, a.n_urgent, b.n_events FROM customer c
LEFT JOIN (SELECT o_custkey, count(*) AS n_urgent FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey) a
  ON a.o_custkey = c.c_custkey
LEFT JOIN (SELECT user_id, count(*) AS n_events FROM events WHERE event_type = 'error' GROUP BY user_id) b
  ON b.user_id = c.c_custkey
WHERE a.o_custkey IS NOT NULL OR b.user_id IS NOT NULL""",
)
def any_match(spark, folder):
    urgent = load(spark, folder, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    errors = load(spark, folder, "events").filter(F.col("event_type") == "error")
    arms = [
        (urgent.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_urgent")), "n_urgent"),
        (errors.groupBy(F.col("user_id").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_events")), "n_events"),
    ]
    return joins.left_any_match(load(spark, folder, "customer").select("c_custkey"), arms, "c_custkey")


@query(
    "band_join",
    with_items(STAYS)
    + """SELECT a.stay, a.person, b.stay AS other, b.in_day - a.in_day AS gap FROM stays a
JOIN stays b ON b.person = a.person AND b.in_day BETWEEN a.in_day - 7 AND a.in_day + 30 AND b.o_orderstatus = 'F'""",
)
def band_join(spark, folder):
    """Orders of the same customer from 7 days before to 30 days after."""
    base = stays(spark, folder).select("stay", "person", "in_day")
    other = stays(spark, folder).filter(F.col("o_orderstatus") == "F")
    other = other.select("person", F.col("stay").alias("other"), F.col("in_day").alias("other_day"))
    pairs = joins.band_join(base, other, "person", "in_day", "other_day", -7, 30)
    return pairs.select("stay", "person", "other", (F.col("other_day") - F.col("in_day")).alias("gap"))


@query(
    "theta_join",
    """SELECT n.user_id, count(*) AS notes, round(avg(n.value) * 2.54, 6) AS height FROM events n
JOIN (SELECT o_custkey, max(o_orderdate) AS last_in FROM orders GROUP BY o_custkey) s ON s.o_custkey = n.user_id
WHERE n.ts < s.last_in + INTERVAL 24 YEAR AND n.value * 2.54 > 100 GROUP BY n.user_id""",
)
def theta_join(spark, folder):
    """An inequality against any stay of a person holds if it holds for the last one, so no pairs are formed."""
    last = load(spark, folder, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.max("o_orderdate").alias("last_in"))
    notes = load(spark, folder, "events").select("user_id", "ts", "value")
    kept = joins.lookup_join(notes, last, ["user_id"]).filter(
        (F.col("ts") < F.col("last_in") + F.expr("INTERVAL '24' YEAR")) & (F.col("value") * 2.54 > 100)
    )
    out = kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("notes"), (F.avg("value") * 2.54).alias("height"))
    return rounded(out, 6, "height")


@query(
    "asof_interval",
    with_items(READINGS)
    + """, w AS (SELECT event_id AS weight_id, user_id, off AS s, off + 1440 + event_id % 3000 AS e, value AS weight
  FROM r WHERE event_type = 'signup')
SELECT r.event_id, r.user_id, w.weight_id, w.weight FROM r
LEFT JOIN w ON w.user_id = r.user_id AND r.off >= w.s AND r.off < w.e""",
)
def asof(spark, folder):
    """Every reading with each validity interval it falls in; readings in none stay."""
    r = readings(spark, folder)
    start = F.col("off").alias("s")
    end = (F.col("off") + 1440 + F.pmod(F.col("event_id"), F.lit(3000))).alias("e")
    weights = r.filter(F.col("event_type") == "signup").select(
        F.col("event_id").alias("weight_id"), "user_id", start, end, F.col("value").alias("weight")
    )
    points = r.select("event_id", "user_id", "off")
    return joins.asof_interval(points, weights, "user_id", "off", "s", "e").select(
        "event_id", "user_id", "weight_id", "weight"
    )


@query(
    "union_keys",
    """SELECT user_id AS person FROM events WHERE event_type = 'error' UNION
SELECT o_custkey FROM orders WHERE o_totalprice > 480000""",
)
def union_keys(spark, folder):
    a = load(spark, folder, "events").filter(F.col("event_type") == "error").withColumnRenamed("user_id", "person")
    b = load(spark, folder, "orders").filter(F.col("o_totalprice") > 480000).withColumnRenamed("o_custkey", "person")
    return joins.union_keys(a, b, ["person"])


@query(
    "net_balance",
    """WITH i AS (SELECT l_orderkey, sum(l_extendedprice) AS amount FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1
  UNION ALL SELECT l_orderkey, sum(l_extendedprice) FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
t AS (SELECT l_orderkey, sum(amount) AS total_input FROM i GROUP BY 1),
o AS (SELECT l_orderkey, sum(l_quantity * 1000) AS total_output FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT t.l_orderkey, round(total_input, 2) AS total_input, round(total_output, 2) AS total_output,
  round(total_input - total_output, 2) + 0.0 AS nettotal FROM t LEFT JOIN o ON o.l_orderkey = t.l_orderkey""",
)
def balance(spark, folder):
    from cohortline.operators.timeseries import net_balance

    lines = load(spark, folder, "lineitem")
    given = lambda flag: lines.filter(F.col("l_returnflag") == flag).select(
        "l_orderkey", F.col("l_extendedprice").alias("amount")
    )
    lost = lines.filter(F.col("l_linestatus") == "F").select("l_orderkey", (F.col("l_quantity") * 1000).alias("amount"))
    out = net_balance([given("A"), given("R")], lost, "l_orderkey")
    return rounded(out, 2, "total_input", "total_output", "nettotal")


@query(
    "net_balance_distinct",
    """WITH i AS (SELECT l_orderkey, sum(l_quantity) AS amount FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1
  UNION SELECT l_orderkey, sum(l_quantity) FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
t AS (SELECT l_orderkey, sum(amount) AS total_input FROM i GROUP BY 1),
o AS (SELECT l_orderkey, sum(l_quantity) AS total_output FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1)
SELECT t.l_orderkey, total_input, total_output, total_input - total_output AS nettotal
FROM t LEFT JOIN o ON o.l_orderkey = t.l_orderkey""",
)
def balance_distinct(spark, folder):
    """Equal totals of two sources count once, as a UNION of the totals has it."""
    from cohortline.operators.timeseries import net_balance

    lines = load(spark, folder, "lineitem").select("l_orderkey", "l_returnflag", F.col("l_quantity").alias("amount"))
    part = lambda flag: lines.filter(F.col("l_returnflag") == flag).drop("l_returnflag")
    return net_balance([part("A"), part("R")], part("N"), "l_orderkey", distinct=True)
