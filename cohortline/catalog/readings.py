"""Queries on reading series."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortline.catalog.frames import DAY, PRESSURES, READINGS, WEEKS, item, pressures, readings, rounded, with_items
from cohortline.catalog.registry import query
from cohortline.functions.exprs import convert, not_error
from cohortline.operators.joins import align_series, restrict
from cohortline.operators.timeseries import (
    Trailing,
    any_in_window,
    complete_readings,
    median_in_window,
    pivot_readings,
    sum_distinct_rows,
    trailing_agg,
    within_span,
)
from cohortline.operators.select import reading_span
from cohortline.plans.exposure import time_in_range
from cohortline.session import scratch_path
from cohortline.sources.io import load, materialize, read_csv, register_views, write_csv

BANDS = {"map": ("ibp_mean", 20, 40), "asp": ("ibp_systolic", 30, 60), "adp": ("ibp_diastolic", 10, 30)}


def _range_columns() -> str:
    out = []
    for label, end in WEEKS.items():
        for band, (col, lo, hi) in BANDS.items():
            n = f"NULLIF(count({col}) FILTER (off BETWEEN 0 AND {end}), 0)"

            def share(test: str) -> str:
                return f"CAST(count(*) FILTER (off BETWEEN 0 AND {end} AND {col} {test}) AS DOUBLE) / {n}"

            out += [
                f"round({share(f'< {lo}')}, 6) AS \"propBelow_{band}_{label}\"",
                f"round({share(f'> {hi}')}, 6) AS \"propAbove_{band}_{label}\"",
                f"round({share(f'BETWEEN {lo} AND {hi}')}, 6) AS \"prop_{band}_{label}\"",
                f"round(1 - {share(f'< {lo}')}, 6) AS \"prop_{band}_{label}_AKI\"",
            ]
    return ",\n  ".join(out)


@query(
    "range_share_multi",
    with_items(READINGS, PRESSURES, f"q AS (SELECT user_id,\n  {_range_columns()}\nFROM p GROUP BY user_id)")
    + "SELECT c.c_custkey AS user_id, q.* EXCLUDE (user_id) FROM customer c LEFT JOIN q ON q.user_id = c.c_custkey",
)
def range_share_multi(spark, folder):
    shares = time_in_range(pressures(spark, folder), "user_id", "off", BANDS, WEEKS)
    shares = rounded(shares, 6, *[c for c in shares.columns if c != "user_id"])
    people = load(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"))
    return people.join(shares, "user_id", "left")


@query(
    "complete_readings",
    with_items(READINGS, PRESSURES)
    + """SELECT event_id, user_id AS qid, off AS ooff, ibp_systolic AS ars, ibp_diastolic AS ard, ibp_mean AS arm
FROM p WHERE ibp_systolic IS NOT NULL AND ibp_diastolic IS NOT NULL AND ibp_mean IS NOT NULL""",
)
def complete(spark, folder):
    names = {"event_id": "event_id", "qid": "user_id", "ooff": "off"}
    names.update({"ars": "ibp_systolic", "ard": "ibp_diastolic", "arm": "ibp_mean"})
    return complete_readings(pressures(spark, folder), names, ["ars", "ard", "arm"])


@query("read_write_roundtrip", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def roundtrip(spark, folder):
    """Orders written as parquet, read back, written as indexed CSV, read back by schema."""
    root = scratch_path(spark)
    orders = load(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    table = materialize(orders, f"{root}/orders")
    register_views({"stored_orders": table}, prefix="cohortline_")
    stored = spark.table("cohortline_stored_orders").withColumn("row", F.col("o_orderkey"))
    write_csv(stored, f"{root}/csv", index=["row"])
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double"
    return read_csv(spark, f"{root}/csv", schema, index=True)


def _median_columns(cols, horizons, low: str) -> str:
    return ", ".join(
        f"round(median({c}) FILTER ({low} off < {t}), 4) AS {c}_{n}" for n, t in horizons.items() for c in cols
    )


PRESSURE_COLUMNS = ("ibp_systolic", "ibp_diastolic", "ibp_mean")


@query(
    "median_in_window",
    with_items(READINGS, PRESSURES)
    + f"SELECT user_id, {_median_columns(PRESSURE_COLUMNS, WEEKS, 'off > 0 AND')} FROM p GROUP BY user_id",
)
def medians(spark, folder):
    out = median_in_window(pressures(spark, folder), ["user_id"], "off", PRESSURE_COLUMNS, WEEKS)
    return rounded(out, 4, *[c for c in out.columns if c != "user_id"])


@query(
    "median_by_key",
    with_items(READINGS, PRESSURES)
    + """SELECT user_id, max(ms) AS ibp_systolic_14d, max(md) AS ibp_diastolic_14d, max(mm) AS ibp_mean_14d FROM (
  SELECT user_id, round(quantile_cont(ibp_systolic, 0.5) OVER w, 4) AS ms,
         round(quantile_cont(ibp_diastolic, 0.5) OVER w, 4) AS md, round(quantile_cont(ibp_mean, 0.5) OVER w, 4) AS mm
  FROM p WHERE off <= 20160 WINDOW w AS (PARTITION BY user_id)) GROUP BY user_id""",
)
def median_by_key(spark, folder):
    """Median up to a horizon without a lower bound, the horizon included."""
    early = pressures(spark, folder).filter(F.col("off") <= WEEKS["14d"])
    out = median_in_window(
        early, ["user_id"], "off", PRESSURE_COLUMNS, {"14d": WEEKS["14d"]}, low=None, open_high=False
    )
    return rounded(out, 4, *[c for c in out.columns if c != "user_id"])


HOUR = 3_600_000_000


@query(
    "trailing_min",
    with_items(READINGS)
    + f"""SELECT a.event_id, a.user_id, a.v,
  min(CASE WHEN b.t_us >= a.t_us - {24 * HOUR} THEN b.v END) AS low_24h,
  min(CASE WHEN b.t_us >= a.t_us - {48 * HOUR} THEN b.v END) AS low_48h,
  min(CASE WHEN b.t_us >= a.t_us - {72 * HOUR} THEN b.v END) AS low_72h,
  min(b.v) AS low_7d
FROM r a LEFT JOIN r b ON a.user_id = b.user_id AND b.t_us < a.t_us AND b.t_us >= a.t_us - {168 * HOUR}
GROUP BY a.event_id, a.user_id, a.v""",
)
def trailing_min(spark, folder):
    windows = [Trailing(f"low_{n}", "min", h * HOUR) for n, h in (("24h", 24), ("48h", 48), ("72h", 72), ("7d", 168))]
    rows = readings(spark, folder).select("event_id", "user_id", "t_us", "v")
    return trailing_agg(rows, "user_id", "t_us", "v", windows).drop("t_us")


@query(
    "trailing_sum_coverage",
    with_items(READINGS)
    + f"""SELECT a.event_id, a.user_id,
  round(sum(CASE WHEN b.t_us >= a.t_us - {24 * HOUR} THEN b.v END), 4) AS sum_1d,
  round(sum(CASE WHEN b.t_us >= a.t_us - {72 * HOUR} THEN b.v END), 4) AS sum_3d,
  round(sum(b.v), 4) AS sum_7d,
  round((a.t_us - min(CASE WHEN b.t_us >= a.t_us - {24 * HOUR} THEN b.t_us END)) / {HOUR}.0, 4) AS hours_1d,
  round((a.t_us - min(CASE WHEN b.t_us >= a.t_us - {72 * HOUR} THEN b.t_us END)) / {HOUR}.0, 4) AS hours_3d,
  round((a.t_us - min(b.t_us)) / {HOUR}.0, 4) AS hours_7d
FROM r a JOIN r b ON a.user_id = b.user_id AND b.t_us <= a.t_us AND b.t_us >= a.t_us - {168 * HOUR}
GROUP BY a.event_id, a.user_id, a.t_us""",
)
def trailing_sum_coverage(spark, folder):
    spans = (("1d", 24), ("3d", 72), ("7d", 168))
    windows = [Trailing(f"sum_{n}", "sum", h * HOUR, True) for n, h in spans]
    windows += [Trailing(f"from_{n}", "min_time", h * HOUR, True) for n, h in spans]
    rows = readings(spark, folder).select("event_id", "user_id", "t_us", "v")
    out = trailing_agg(rows, "user_id", "t_us", "v", windows)
    sums = [F.round(f"sum_{n}", 4).alias(f"sum_{n}") for n, _ in spans]
    hours = [F.round((F.col("t_us") - F.col(f"from_{n}")) / HOUR, 4).alias(f"hours_{n}") for n, _ in spans]
    return out.select("event_id", "user_id", *sums, *hours)


@query(
    "any_in_window_union",
    with_items(READINGS)
    + f"""SELECT c.c_custkey AS user_id, COALESCE(a.flag_7d, 0) AS flag_7d, COALESCE(a.flag_21d, 0) AS flag_21d,
  COALESCE(b.seen, 0) AS seen, GREATEST(COALESCE(a.flag_21d, 0), COALESCE(b.seen, 0)) AS either
FROM customer c
LEFT JOIN (SELECT user_id, max(CASE WHEN off BETWEEN 360 AND {7 * DAY} AND value > 60 THEN 1
                                    WHEN off BETWEEN 360 AND {7 * DAY} THEN 0 END) AS flag_7d,
                  max(CASE WHEN value > 60 THEN 1 ELSE 0 END) AS flag_21d
           FROM r WHERE off BETWEEN 360 AND {21 * DAY}
             AND user_id IN (SELECT user_id FROM r WHERE event_type = 'signup') GROUP BY user_id) a
  ON a.user_id = c.c_custkey
LEFT JOIN (SELECT DISTINCT o_custkey, 1 AS seen FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 450000) b
  ON b.o_custkey = c.c_custkey""",
)
def any_in_window_union(spark, folder):
    r = readings(spark, folder).withColumn("flag", F.when(F.col("value") > 60, 1).otherwise(0))
    kept = restrict(r, r.filter(F.col("event_type") == "signup"), "user_id")
    flags = any_in_window(kept, ["user_id"], "off", "flag", {"flag_7d": (360, 7 * DAY), "flag_21d": (360, 21 * DAY)})
    orders = load(spark, folder, "orders").filter(
        (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 450000)
    )
    seen = orders.select(F.col("o_custkey").alias("user_id")).distinct().withColumn("seen", F.lit(1))
    people = load(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"))
    out = people.join(flags, "user_id", "left").join(seen, "user_id", "left").fillna(0)
    return out.withColumn("either", F.greatest("flag_21d", "seen"))


@query(
    "pivot_readings",
    with_items(READINGS)
    + """SELECT user_id, off // 720 AS half_day,
  round(avg(CASE WHEN event_type = 'click' AND value > 0 AND value < 200 THEN value END), 4) AS heartrate,
  round(avg(CASE WHEN event_type IN ('view', 'error') AND value > 5 AND value <= 100 THEN value END), 4) AS spo2,
  round(avg(CASE WHEN event_type = 'purchase' AND value > 70 AND value < 120 THEN (value - 32) / 1.8
                 WHEN event_type = 'signup' AND value > 10 AND value < 50 THEN value END), 4) AS tempc
FROM (SELECT *, CASE WHEN value > 300 THEN 1 WHEN event_type = 'view' THEN NULL ELSE 0 END AS error FROM r)
WHERE off >= 0 AND COALESCE(error, 0) = 0 GROUP BY ALL""",
)
def pivoted(spark, folder):
    r = readings(spark, folder).withColumn(
        "error", F.when(F.col("value") > 300, 1).when(F.col("event_type") == "view", None).otherwise(0)
    )
    kept = r.filter((F.col("off") >= 0) & not_error("error")).withColumn("half_day", F.floor(F.col("off") / 720))
    value, kind = F.col("value"), F.col("event_type")
    temp = convert("value", [(kind == "purchase", (value - 32) / 1.8)])
    plausible = ((kind == "purchase") & (value > 70) & (value < 120)) | ((kind == "signup") & (value > 10) & (value < 50))
    out = pivot_readings(
        kept,
        ["user_id", "half_day"],
        {
            "heartrate": F.when((kind == "click") & (value > 0) & (value < 200), value),
            "spo2": F.when(kind.isin("view", "error") & (value > 5) & (value <= 100), value),
            "tempc": F.when(plausible, temp),
        },
    )
    return rounded(out, 4, "heartrate", "spo2", "tempc")


@query(
    "reading_table",
    with_items(READINGS, PRESSURES)
    + """SELECT p.user_id, p.event_id, p.off, p.ibp_systolic, p.ibp_diastolic, p.ibp_mean
FROM p JOIN (SELECT user_id, min(off) AS lo, max(off) AS hi FROM p
             WHERE ibp_systolic IS NOT NULL OR ibp_diastolic IS NOT NULL GROUP BY user_id) s ON s.user_id = p.user_id
WHERE p.off >= s.lo AND p.off <= s.hi ORDER BY p.user_id, p.off, p.event_id""",
)
def reading_table(spark, folder):
    p = pressures(spark, folder)
    spans = reading_span(p, ["user_id"], "off", ["ibp_systolic", "ibp_diastolic"])
    return within_span(p, spans, "user_id", "off", "min_offset", "max_offset").drop("t_us").orderBy(
        "user_id", "off", "event_id"
    )


@query(
    "align_series",
    with_items(READINGS)
    + """, a AS (SELECT user_id, off // 60 AS hour, max(v) AS creat FROM r WHERE event_type = 'click' GROUP BY ALL),
b AS (SELECT user_id, off // 60 AS hour, max(v) AS urine FROM r WHERE event_type = 'view' GROUP BY ALL),
t AS (SELECT user_id, hour FROM a UNION SELECT user_id, hour FROM b)
SELECT t.user_id, CAST(t.hour AS BIGINT) AS hour, a.creat, b.urine, GREATEST(a.creat, b.urine) AS larger
FROM t LEFT JOIN a USING (user_id, hour) LEFT JOIN b USING (user_id, hour)""".replace(
        "off // 60", "CAST(floor(off / 60.0) AS BIGINT)"
    ),
)
def aligned(spark, folder):
    r = readings(spark, folder).withColumn("hour", F.floor(F.col("off") / 60))
    keys = ["user_id", "hour"]
    a = r.groupBy(*keys).agg(F.max(item("click")).alias("creat"), F.count(item("click", "event_id")).alias("n"))
    b = r.groupBy(*keys).agg(F.max(item("view")).alias("urine"), F.count(item("view", "event_id")).alias("n"))
    series = [x.filter(F.col("n") > 0).drop("n") for x in (a, b)]
    return align_series(series, keys).withColumn("larger", F.greatest("creat", "urine"))


@query(
    "sum_distinct_rows",
    with_items(READINGS)
    + """SELECT user_id, sum(w) AS w FROM (SELECT DISTINCT user_id, day, w FROM (
  SELECT user_id, CAST(floor(off / 1440.0) AS BIGINT) AS day, CAST(floor(value) AS BIGINT) AS w FROM r)
  WHERE day BETWEEN 0 AND 14) GROUP BY user_id""".replace("sum(w) AS w", "CAST(sum(w) AS BIGINT) AS w"),
)
def distinct_sum(spark, folder):
    r = readings(spark, folder).select(
        "user_id", F.floor(F.col("off") / DAY).alias("day"), F.floor("value").alias("w")
    )
    return sum_distinct_rows(r, ["user_id"], "day", "w", 0, 14)
