"""Queries that assemble and clean the wide analysis tables. Customers are the stays."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortline.catalog import drugs, kidney
from cohortline.catalog.drugs import KEY, recode
from cohortline.catalog.frames import DAY, PRESSURES, READINGS, chained_sql, in_turn, pressures, rounded, with_items
from cohortline.catalog.registry import query
from cohortline.functions import vocab
from cohortline.operators.select import first_by, select_as
from cohortline.plans import aki, cleaning, exposure, tables
from cohortline.plans.cohort import first_stay_cohort, pressure_cohort
from cohortline.sources.io import load


def _people(spark, folder):
    return load(spark, folder, "customer").select(
        F.col("c_custkey").alias(KEY),
        F.floor(F.col("c_acctbal") / 100).cast("long").alias("age"),
        F.when(F.col("c_nationkey") % 2 == 0, "Female").otherwise("Male").alias("gender"),
        F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("ethnicity"),
        F.col("c_mktsegment").alias("unittype"),
        (F.lit(150.0) + F.col("c_nationkey")).alias("admissionheight"),
        (F.lit(50.0) + F.abs("c_acctbal") / 200).alias("admissionweight"),
        (F.lit(50.0) + F.abs("c_acctbal") / 250).alias("dischargeweight"),
        F.when(F.col("c_name").endswith("7"), F.concat(F.lit("Sepsis, "), F.col("c_mktsegment")))
        .otherwise(F.col("c_mktsegment"))
        .alias("apacheadmissiondx"),
    )


PEOPLE = """people AS (SELECT c_custkey AS patientunitstayid, CAST(floor(c_acctbal / 100) AS BIGINT) AS age,
  CASE WHEN c_nationkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender, nullif(c_mktsegment, 'MACHINERY') AS ethnicity,
  c_mktsegment AS unittype, 150.0::DOUBLE + c_nationkey AS admissionheight, 50.0::DOUBLE + abs(c_acctbal) / 200 AS admissionweight,
  50.0::DOUBLE + abs(c_acctbal) / 250 AS dischargeweight, CASE WHEN c_name LIKE '%7' THEN 1 ELSE 0 END AS sepsis_binary FROM customer)"""


def _results(spark, folder):
    return load(spark, folder, "orders").select(
        F.col("o_custkey").alias(KEY),
        F.col("o_orderkey").alias("apacheversion"),
        F.when(F.col("o_orderstatus") == "F", "EXPIRED").otherwise("ALIVE").alias("actualicumortality"),
        (F.col("o_totalprice") / 30000).alias("actualiculos"),
        F.when(F.col("o_orderstatus") != "O", "EXPIRED").otherwise("ALIVE").alias("actualhospitalmortality"),
        (F.col("o_totalprice") / 20000).alias("actualhospitallos"),
        (F.col("o_totalprice") / 60000).alias("unabridgedactualventdays"),
    )


RESULTS = """results AS (SELECT o_custkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'EXPIRED' ELSE 'ALIVE' END AS icu_mort,
  o_totalprice / 30000 AS icu_los, CASE WHEN o_orderstatus <> 'O' THEN 'EXPIRED' ELSE 'ALIVE' END AS hosp_mort,
  o_totalprice / 20000 AS hosp_los, o_totalprice / 60000 AS ventilation_duration_days
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1)"""

COHORT = f"""cohort AS (SELECT user_id AS id FROM (SELECT user_id,
    min(off) FILTER (ibp_systolic IS NOT NULL OR ibp_diastolic IS NOT NULL OR ibp_mean IS NOT NULL) AS lo,
    max(off) FILTER (ibp_systolic IS NOT NULL OR ibp_diastolic IS NOT NULL OR ibp_mean IS NOT NULL) AS hi,
    count(*) FILTER (off BETWEEN 0 AND {5 * DAY} AND (ibp_systolic IS NOT NULL OR ibp_mean IS NOT NULL)) AS n,
    max(CASE WHEN off <= {5 * DAY} AND (ibp_mean IS NOT NULL OR (ibp_systolic IS NOT NULL AND ibp_diastolic IS NOT NULL)) THEN 1 END) AS u
    FROM p GROUP BY user_id) WHERE lo <= {5 * DAY} AND hi - lo >= {5 * DAY} AND n >= 3 AND u = 1)"""


def _cohort(spark, folder):
    spans = pressure_cohort(pressures(spark, folder), "user_id", "off", window=5 * DAY, min_readings=3)
    return spans.withColumnRenamed("user_id", KEY)


@query(
    "offset_table",
    with_items(
        READINGS,
        PRESSURES,
        PEOPLE,
        RESULTS,
        COHORT,
        kidney.LAB,
        kidney.BASELINE,
        """k AS (SELECT b.patientunitstayid AS id, max(CASE WHEN labresult / creat1 > 1.5
      OR labresultoffset <= 2880 AND labresult - creat1 > 0.3 THEN 1 ELSE 0 END) AS aki
  FROM base b JOIN lab l ON l.patientunitstayid = b.patientunitstayid AND l.labname = 'creatinine'
  AND l.labresult IS NOT NULL AND l.labresultoffset BETWEEN 0 AND 10080
  WHERE b.patientunitstayid NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW') GROUP BY 1)""",
        """fl AS (SELECT id, nettotal FROM (SELECT l_suppkey AS id, l_extendedprice AS nettotal, row_number() OVER (
    PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_extendedprice) AS n FROM lineitem) WHERE n = 1)""",
        """hs AS (SELECT o_custkey AS id, max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS hypertension,
  max(CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 0 END) AS atrial_fibrillation,
  max(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS chf,
  max(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 1 ELSE 0 END) AS diabetes FROM orders GROUP BY 1)""",
        """vp AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45)""",
        """dr AS (SELECT user_id AS id, CAST(max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS SMALLINT) AS dopamine,
  CAST(max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS SMALLINT) AS dobutamine,
  CAST(max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS SMALLINT) AS norepinephrine,
  CAST(max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS SMALLINT) AS heparin FROM events WHERE event_type <> 'error' GROUP BY 1)""",
    )
    + """SELECT c.id AS patientunitstayid, s.icu_mort, s.icu_los, s.hosp_mort, s.hosp_los, s.ventilation_duration_days, p.age, p.gender,
  p.ethnicity, p.unittype, p.admissionheight, p.admissionweight, p.dischargeweight, fl.nettotal, hs.hypertension,
  hs.atrial_fibrillation, CASE WHEN hs.id IS NOT NULL THEN 0 END AS cancer, hs.chf, CASE WHEN hs.id IS NOT NULL THEN 0 END AS ckd,
  CASE WHEN hs.id IS NOT NULL THEN 0 END AS cld, CASE WHEN hs.id IS NOT NULL THEN 0 END AS copd, hs.diabetes,
  CASE WHEN hs.id IS NOT NULL THEN 0 END AS ihd, CASE WHEN hs.id IS NOT NULL THEN 0 END AS cebrovascular_accident, p.sepsis_binary,
  CASE WHEN vp.id IS NOT NULL THEN 1::SMALLINT END AS vasopressor, dr.dopamine, dr.dobutamine, dr.norepinephrine,
  CASE WHEN dr.id IS NOT NULL THEN 0::SMALLINT END AS phenylephrine, CASE WHEN dr.id IS NOT NULL THEN 0::SMALLINT END AS epinephrine,
  CASE WHEN dr.id IS NOT NULL THEN 0::SMALLINT END AS vaso_infusion, CASE WHEN dr.id IS NOT NULL THEN 0::SMALLINT END AS milrinone,
  dr.heparin, k.aki AS aki_creat, CAST(p.age AS INTEGER) - 1 AS apache_iv
FROM cohort c LEFT JOIN results s ON s.id = c.id LEFT JOIN people p ON p.patientunitstayid = c.id LEFT JOIN fl ON fl.id = c.id
LEFT JOIN hs ON hs.id = c.id LEFT JOIN vp ON vp.id = c.id LEFT JOIN dr ON dr.id = c.id LEFT JOIN k ON k.id = c.id""",
)
def offset_table(spark, folder):
    codes = load(spark, folder, "orders").select(
        F.col("o_custkey").alias(KEY), recode("o_orderpriority", drugs.FRAGMENTS).alias("icd9code")
    )
    fluid = load(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias(KEY), F.col("l_shipdate").alias("intakeoutputoffset"), F.col("l_extendedprice").alias("nettotal")
    )
    given = (F.col("l_returnflag") == "A") & (F.col("l_quantity") > 45)
    treated = load(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias(KEY), F.when(given, in_turn(vocab.VASOPRESSOR_TREATMENTS, "l_partkey")).alias("treatmentstring")
    )
    people = _people(spark, folder)
    return tables.offset_table(
        _cohort(spark, folder),
        people,
        _results(spark, folder),
        fluid,
        codes,
        treated,
        drugs.infusions(spark, folder),
        aki.creatinine_aki(kidney.lab(spark, folder), kidney.treatment(spark, folder)),
        people.select(KEY, (F.col("age") - 1).cast("int").alias("apache_iv")),
    )


@query(
    "timed_table",
    """WITH d AS (SELECT o_orderkey AS icustay_id, o_custkey AS subject_id, o_custkey AS hadm_id, o_orderdate AS intime,
  o_orderdate + INTERVAL 30 DAY AS outtime FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n
  FROM orders) WHERE n = 1),
ln AS (SELECT l_orderkey AS id, sum(l_quantity) / 24.0 AS vent, min(l_quantity) AS weight_min, sum(CASE WHEN l_returnflag = 'A'
  THEN l_extendedprice END) - sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) AS net, max(l_tax) AS sofa,
  min(l_linenumber) AS vaspor, min(CASE WHEN l_linestatus = 'F' THEN l_linenumber END) AS vaspin,
  max(CASE WHEN l_discount > 0.08 THEN 1 ELSE 0 END) AS aki FROM lineitem GROUP BY 1),
od AS (SELECT o_custkey AS id, max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS afib,
  max(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS ckd, max(CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 0 END) AS ihd,
  max(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 1 ELSE 0 END) AS copd,
  max(CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END) AS cancer FROM orders GROUP BY 1)
SELECT d.icustay_id, d.subject_id, d.hadm_id, d.intime, d.outtime, c.c_mktsegment AS first_careunit, ln.sofa,
  ln.weight_min AS weight_first, ln.weight_min AS weight_last, 170.0::DOUBLE + c.c_nationkey AS height_first,
  170.0::DOUBLE - c.c_nationkey AS height_last, round(ln.vent, 6) AS vent_duration_days, round(ln.net, 2) + 0.0 AS nettotal,
  CASE WHEN c.c_nationkey > 5 THEN 1 ELSE 0 END AS hypertension, CASE WHEN c.c_nationkey > 20 THEN 1 ELSE 0 END AS congestive_heart_failure,
  CASE WHEN c.c_nationkey < 3 OR c.c_nationkey > 22 THEN 1 ELSE 0 END AS diabetes, od.afib, 0 AS cld, 0 AS cereb, od.ihd, od.ckd, od.copd,
  od.cancer, CASE WHEN c.c_acctbal < 0 THEN 1 ELSE 0 END AS sepsis, ln.aki AS aki_48hr, ln.vaspor, ln.vaspin,
  CAST(floor(c.c_acctbal / 100) AS BIGINT) AS apsiii, round(c.c_acctbal / 10000, 6) + 0.0 AS apsiii_prob,
  CASE WHEN c.c_acctbal < 2000 THEN 1 ELSE 0 END AS icu_mortality
FROM d LEFT JOIN customer c ON c.c_custkey = d.subject_id LEFT JOIN ln ON ln.id = d.icustay_id LEFT JOIN od ON od.id = d.subject_id""",
)
def timed_table(spark, folder):
    orders, lines = load(spark, folder, "orders"), load(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "icustay_id")
    customer = load(spark, folder, "customer")
    firsts = first_by(orders, ["o_custkey"], "o_orderdate", ["o_orderkey"])
    yes = F.lit("Y")
    detail = firsts.select(
        F.col("o_orderkey").alias("icustay_id"),
        F.col("o_custkey").alias("subject_id"),
        F.col("o_custkey").alias("hadm_id"),
        F.col("o_orderdate").alias("intime"),
        (F.col("o_orderdate") + F.expr("INTERVAL '30' DAY")).alias("outtime"),
        yes.alias("first_hosp_stay"),
        yes.alias("first_icu_stay"),
    )
    person = detail.select("icustay_id", "subject_id", "outtime").join(
        customer.withColumnRenamed("c_custkey", "subject_id"), "subject_id"
    )
    nation, money = F.col("c_nationkey"), F.col("c_acctbal")
    per_line = lines.groupBy("icustay_id")
    last_day = orders.groupBy(F.col("o_custkey").alias("subject_id")).agg(F.min("o_orderdate").alias("first_day"))
    dod = customer.withColumnRenamed("c_custkey", "subject_id").join(last_day, "subject_id")
    size = person.select("icustay_id", (170.0 + nation).alias("height_first"), (170.0 - nation).alias("height_last")).join(
        per_line.agg(F.min("l_quantity").alias("weight_first"), F.min("l_quantity").alias("weight_last")), "icustay_id", "left"
    )
    codes = orders.select(F.col("o_custkey").alias("hadm_id"), recode("o_orderpriority", drugs.CODES).alias("icd9_code"))
    paid = lambda f: F.sum(F.when(F.col("l_returnflag") == f, F.col("l_extendedprice")))
    out = tables.timed_table(
        detail,
        person.select("icustay_id", F.col("c_mktsegment").alias("first_careunit")),
        dod.select("subject_id", F.when(money < 2000, F.col("first_day")).alias("dod")),
        size,
        lines.select("icustay_id", F.col("l_quantity").alias("duration_hours")),
        per_line.agg((paid("A") - paid("R")).alias("nettotal")),
        customer.select(
            F.col("c_custkey").alias("hadm_id"),
            F.when(nation > 5, 1).otherwise(0).alias("hypertension"),
            F.when(nation > 20, 1).otherwise(0).alias("congestive_heart_failure"),
            F.when(nation < 3, 1).otherwise(0).alias("diabetes_uncomplicated"),
            F.when(nation > 22, 1).otherwise(0).alias("diabetes_complicated"),
        ),
        codes,
        customer.select(F.col("c_custkey").alias("hadm_id"), F.when(money < 0, 1).otherwise(0).alias("angus")),
        per_line.agg(F.max(F.when(F.col("l_discount") > 0.08, 1).otherwise(0)).alias("aki_48hr")),
        lines.select("icustay_id", F.col("l_linenumber").alias("vasonum")),
        lines.filter(F.col("l_linestatus") == "F").select("icustay_id", F.col("l_linenumber").alias("vasonum")),
        person.select("icustay_id", F.floor(money / 100).alias("apsiii"), (money / 10000).alias("apsiii_prob")),
        per_line.agg(F.max("l_tax").alias("sofa")),
    )
    out = out.drop("first_hosp_stay", "first_icu_stay")
    return rounded(rounded(out, 6, "vent_duration_days", "apsiii_prob"), 2, "nettotal")


@query(
    "archive_table",
    """WITH o AS (SELECT * FROM (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey
    ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1),
h AS (SELECT l_suppkey AS id, round((max(l_partkey) - min(l_partkey)) / 60.0, 6) AS duration_hour FROM lineitem GROUP BY 1)
SELECT c.c_custkey AS patientunitstayid, o.o_orderkey, o.o_orderstatus, h.duration_hour,
  CASE WHEN c.c_acctbal > 9000 THEN '> 89' ELSE CAST(CAST(floor(c.c_acctbal / 100) AS BIGINT) AS VARCHAR) END AS age,
  c.c_mktsegment AS apachedxgroup, CASE WHEN c.c_mktsegment = 'Sepsis' THEN 1 ELSE 0 END AS sepsis_binary
FROM (SELECT DISTINCT o_custkey FROM orders) k JOIN (SELECT * REPLACE (CASE WHEN c_mktsegment = 'FURNITURE' THEN 'Sepsis'
  ELSE c_mktsegment END AS c_mktsegment) FROM customer) c ON c.c_custkey = k.o_custkey
LEFT JOIN o ON o.o_custkey = k.o_custkey LEFT JOIN h ON h.id = k.o_custkey
WHERE c.c_acctbal <= 9000 AND floor(c.c_acctbal / 100) > 17 AND floor(c.c_acctbal / 100) < 89""",
)
def archive_table(spark, folder):
    money = F.col("c_acctbal")
    age = F.when(money > 9000, "> 89").otherwise(F.floor(money / 100).cast("string"))
    group = F.when(F.col("c_mktsegment") == "FURNITURE", "Sepsis").otherwise(F.col("c_mktsegment"))
    demo = load(spark, folder, "customer").select(F.col("c_custkey").alias(KEY), age.alias("age"), group.alias("apachedxgroup"))
    orders = load(spark, folder, "orders").select(F.col("o_custkey").alias(KEY), "o_orderkey", "o_orderstatus")
    drips = load(spark, folder, "lineitem").select(F.col("l_suppkey").alias(KEY), F.col("l_partkey").alias("infusionoffset"))
    hours = rounded(tables.cohort_infusion_hours(drips), 6, "duration_hour")
    return tables.archive_table(orders, [demo, orders, hours])


# --------------------------------------------------------------------------- cleaning


def _raw(spark, folder):
    """People with outcomes and medians of three pressures; heights and weights present for everybody."""
    p = pressures(spark, folder).withColumnRenamed("user_id", KEY)
    medians = exposure.pressure_medians(p, KEY, "off", horizons={"24h": 21 * DAY})
    outcome = select_as(first_by(_results(spark, folder), [KEY], "apacheversion"), {KEY: KEY, **tables.OUTCOMES})
    return _people(spark, folder).join(medians, KEY, "left").join(outcome, KEY, "left").withColumns(
        {"height_impute": F.col("admissionheight"), "weight_impute": F.col("admissionweight")}
    )


RAW = f"""md AS (SELECT user_id AS id, {", ".join(f"median({c}) FILTER (off > 0 AND off < {21 * DAY}) AS {c}_24h"
    for c in ("ibp_systolic", "ibp_diastolic", "ibp_mean"))} FROM p GROUP BY 1),
raw AS (SELECT pe.*, md.* EXCLUDE (id), rs.* EXCLUDE (id), admissionheight AS height_impute, admissionweight AS weight_impute
  FROM people pe LEFT JOIN md ON md.id = pe.patientunitstayid LEFT JOIN results rs ON rs.id = pe.patientunitstayid),
kept AS (SELECT * REPLACE (COALESCE(ethnicity, 'Others') AS ethnicity) FROM raw
  WHERE NOT (age < 16 OR age > 89) AND NOT (unittype = 'BUILDING' AND gender = 'Male')
  AND ibp_systolic_24h IS NOT NULL AND ibp_diastolic_24h IS NOT NULL AND ibp_mean_24h IS NOT NULL),
q AS (SELECT quantile_cont(height_impute, 0.25) AS h1, quantile_cont(height_impute, 0.75) AS h3,
  quantile_cont(weight_impute, 0.25) AS w1, quantile_cont(weight_impute, 0.75) AS w3 FROM kept),
cl AS (SELECT k.*, weight_impute / power(height_impute / 100.0, 2) AS bmi FROM kept k, q
  WHERE height_impute BETWEEN h1 - 1.5 * (h3 - h1) AND h3 + 1.5 * (h3 - h1)
  AND weight_impute BETWEEN w1 - 1.5 * (w3 - w1) AND w3 + 1.5 * (w3 - w1)),
uo AS (SELECT o_custkey AS id, max(CASE WHEN o_totalprice > 400000 THEN 1 ELSE 0 END) AS "AKI_uo7day" FROM orders
  WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
fin AS (SELECT cl.*, COALESCE(uo."AKI_uo7day", 0) AS "AKI_uo7day", COALESCE(uo."AKI_uo7day", 0) AS "AKI_7d",
  CASE WHEN icu_los > 7 THEN 'ALIVE' WHEN icu_los <= 7 THEN icu_mort END AS mortality_7d
  FROM cl LEFT JOIN uo ON uo.id = cl.patientunitstayid)"""

PRESSURE_24H = ("ibp_systolic_24h", "ibp_diastolic_24h", "ibp_mean_24h")


def _clean(spark, folder, impute=None, frame=None):
    exclusions = {
        "age": (F.col("age") < 16) | (F.col("age") > 89),
        "gender": (F.col("unittype") == "BUILDING") & (F.col("gender") == "Male"),
    }
    raw = _raw(spark, folder) if frame is None else frame
    return cleaning.clean(raw, KEY, exclusions, PRESSURE_24H, {"ethnicity": "Others"}, impute=impute)


def _finished(spark, folder):
    urgent = load(spark, folder, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    uo = urgent.groupBy(F.col("o_custkey").alias(KEY)).agg(
        F.max(F.when(F.col("o_totalprice") > 400000, 1).otherwise(0)).alias("AKI_uo7day")
    )
    return cleaning.add_outcomes(_clean(spark, folder), KEY, uo, "icu_los", "icu_mort", "ALIVE", ["AKI_uo7day"])


_SHOWN = ["age", "gender", "ethnicity", "unittype", "icu_mort", "hosp_mort", "AKI_uo7day", "AKI_7d", "mortality_7d"]


@query(
    "cleaning_pipeline",
    with_items(READINGS, PRESSURES, PEOPLE, RESULTS, RAW)
    + "SELECT patientunitstayid, "
    + ", ".join(f'"{c}"' for c in _SHOWN)
    + ", round(bmi, 6) AS bmi, "
    + ", ".join(f"round({c}, 4) AS {c}" for c in PRESSURE_24H)
    + " FROM fin",
)
def cleaning_pipeline(spark, folder):
    out = _finished(spark, folder).select(KEY, *_SHOWN, "bmi", *PRESSURE_24H)
    return rounded(rounded(out, 6, "bmi"), 4, *PRESSURE_24H)


@query(
    "cleaning_with_imputation",
)
def cleaning_with_imputation(spark, folder):
    """The same with heights and weights missing for some people and filled by chained regressions."""
    raw = _raw(spark, folder).drop("height_impute", "weight_impute")
    holes = raw.withColumns(
        {
            "admissionheight": F.when(F.col("unittype") != "HOUSEHOLD", F.col("admissionheight")),
            "admissionweight": F.when(F.col("age") % 10 != 3, F.col("admissionweight")),
        }
    )
    impute = (
        ["admissionheight", "admissionweight"],
        ["age", "ibp_mean_24h", "ibp_systolic_24h"],
        ["gender", "ethnicity"],
    )
    out = _clean(spark, folder, impute, holes)
    return out.select(KEY, "age", "gender", "ethnicity", "height_impute", "weight_impute", "bmi", *PRESSURE_24H)


# RAW with holes in heights and weights, filled before the fences are set.
HOLES = RAW.replace("q AS (SELECT quantile_cont", """holes AS (SELECT * EXCLUDE (height_impute, weight_impute) REPLACE (
    CASE WHEN unittype <> 'HOUSEHOLD' THEN admissionheight END AS admissionheight,
    CASE WHEN age % 10 <> 3 THEN admissionweight END AS admissionweight) FROM kept),
""" + chained_sql("holes", "admissionheight", "admissionweight", "age", 10, 1e-6) + """,
filled AS (SELECT * EXCLUDE (admissionheight_impute, admissionweight_impute),
  admissionheight_impute AS height_impute, admissionweight_impute AS weight_impute FROM chained),
q AS (SELECT quantile_cont""").replace("AS w3 FROM kept", "AS w3 FROM filled").replace("FROM kept k, q", "FROM filled k, q")


@query(
    "cleaning_with_chained_targets",
    with_items(READINGS, PRESSURES, PEOPLE, RESULTS, HOLES)
    + """SELECT patientunitstayid, age, gender, ethnicity, round(height_impute, 6) AS height_impute, round(weight_impute, 6) AS weight_impute,
  round(bmi, 6) AS bmi FROM fin""",
)
def cleaning_with_chained_targets(spark, folder):
    """The cleaning pipeline with ten rounds of imputation for two targets, before fences and body mass index."""
    holes = _raw(spark, folder).drop("height_impute", "weight_impute").withColumns(
        {
            "admissionheight": F.when(F.col("unittype") != "HOUSEHOLD", F.col("admissionheight")),
            "admissionweight": F.when(F.col("age") % 10 != 3, F.col("admissionweight")),
        }
    )
    out = _clean(spark, folder, (["admissionheight", "admissionweight"], ["age"], []), holes)
    out = rounded(out, 6, "height_impute", "weight_impute", "bmi")
    return out.select(KEY, "age", "gender", "ethnicity", "height_impute", "weight_impute", "bmi")


@query(
    "week_outcome",
    """SELECT o_orderkey, CASE WHEN o_totalprice / 30000 > 7 THEN 'ALIVE' WHEN o_totalprice / 30000 <= 7
  THEN CASE WHEN o_orderstatus = 'F' THEN 'EXPIRED' ELSE 'ALIVE' END END AS mortality_7d FROM orders""",
)
def week(spark, folder):
    stays = _results(spark, folder).withColumnRenamed("apacheversion", "o_orderkey")
    return stays.select(
        "o_orderkey", cleaning.week_outcome("actualiculos", F.col("actualicumortality"), "ALIVE").alias("mortality_7d")
    )


_SHARES = [f"prop{x}_map_24" for x in ("Below", "Above", "")]


@query(
    "model_frame",
    with_items(READINGS, PRESSURES, PEOPLE, RESULTS, RAW)
    + f""", tr AS (SELECT user_id AS id, count(ibp_mean) FILTER (off BETWEEN 0 AND {14 * DAY}) AS n,
  count(*) FILTER (off BETWEEN 0 AND {14 * DAY} AND ibp_mean < 20) AS lo,
  count(*) FILTER (off BETWEEN 0 AND {14 * DAY} AND ibp_mean > 40) AS hi,
  count(*) FILTER (off BETWEEN 0 AND {14 * DAY} AND ibp_mean BETWEEN 20 AND 40) AS mid FROM p GROUP BY 1)
SELECT patientunitstayid, age, CASE WHEN gender = 'Female' THEN 1 ELSE 0 END AS gender, round(bmi, 6) AS bmi, "AKI_7d",
  CASE WHEN icu_mort <> 'ALIVE' THEN 1 ELSE 0 END AS icu_mortality, CASE WHEN hosp_mort <> 'ALIVE' THEN 1 ELSE 0 END AS hospital_expire_flag,
  round(ventilation_duration_days, 6) AS mechanical_ventilation,
  CASE WHEN ventilation_duration_days > 3 THEN 1 ELSE 0 END AS use_vasopressor,
  round(lo::DOUBLE / nullif(n, 0), 6) AS "propBelow_map_24", round(hi::DOUBLE / nullif(n, 0), 6) AS "propAbove_map_24",
  round(mid::DOUBLE / nullif(n, 0), 6) AS "prop_map_24"
FROM fin LEFT JOIN tr ON tr.id = patientunitstayid WHERE mortality_7d = 'ALIVE'""",
)
def model_frame(spark, folder):
    bands = {"map": ("ibp_mean", 20, 40)}
    in_range = exposure.time_in_range(
        pressures(spark, folder).withColumnRenamed("user_id", KEY), KEY, "off", bands, {"24": 14 * DAY}
    )
    died = {
        "hosp_mort": F.col("hosp_mort") != "ALIVE",
        "icu_mort": F.col("icu_mort") != "ALIVE",
        "gender": F.col("gender") == "Female",
    }
    names = {
        "hosp_mort": "hospital_expire_flag",
        "icu_mort": "icu_mortality",
        "ventilation_duration_days": "mechanical_ventilation",
    }
    finished = _finished(spark, folder).withColumn("hours", F.col("ventilation_duration_days") - 3)
    out = cleaning.model_frame(
        finished, KEY, names, died, "hours", in_range.select(KEY, *_SHARES), F.col("mortality_7d") == "ALIVE"
    )
    out = out.select(
        KEY,
        "age",
        "gender",
        "bmi",
        "AKI_7d",
        "icu_mortality",
        "hospital_expire_flag",
        "mechanical_ventilation",
        "use_vasopressor",
        *_SHARES,
    )
    return rounded(out, 6, "bmi", "mechanical_ventilation", *_SHARES)


# --------------------------------------------------------------------------- charted readings


@query(
    "charted_readings",
    """SELECT e.user_id AS icustay_id, e.ts AS charttime,
  round(CASE WHEN event_type = 'click' AND value > 0 AND value < 300 THEN value END, 6) AS heartrate,
  CAST(NULL AS DOUBLE) AS sysbp, CAST(NULL AS DOUBLE) AS diasbp,
  CASE WHEN event_type = 'view' AND value > 0 AND value < 300 THEN value END AS meanbp, CAST(NULL AS DOUBLE) AS resprate,
  CAST(NULL AS DOUBLE) AS glucose, round(CASE WHEN event_type = 'purchase' AND value > 70 AND value < 120 THEN (value - 32) / 1.8 END, 6) AS tempc,
  CASE WHEN event_type = 'signup' AND value > 0 AND value <= 100 THEN value END AS spo2,
  round((epoch_us(e.ts) - epoch_us(s.ts))::DOUBLE / 60000000, 4) AS chartoffset
FROM events e JOIN (SELECT user_id, min(ts) AS ts FROM events GROUP BY 1) s ON s.user_id = e.user_id WHERE event_type <> 'error'""",
)
def charted(spark, folder):
    events = load(spark, folder, "events")
    item = recode("event_type", {"click": 211, "view": 52, "purchase": 678, "signup": 646, "error": 211})
    charts = events.select(
        F.col("user_id").alias("icustay_id"),
        F.col("ts").alias("charttime"),
        item.alias("itemid"),
        F.col("value").alias("valuenum"),
        F.when(F.col("event_type") == "error", 1).alias("error"),
    )
    admitted = events.groupBy(F.col("user_id").alias("icustay_id")).agg(F.min("ts").alias("intime"))
    admitted = admitted.withColumns({"first_hosp_stay": F.lit("Y"), "first_icu_stay": F.lit("Y")})
    out = exposure.charted_readings(charts, admitted)
    return rounded(rounded(out, 6, "heartrate", "tempc"), 4, "chartoffset")


@query(
    "cohort_readings",
    with_items(READINGS, PRESSURES)
    + f""", c AS (SELECT user_id AS id, min(off) AS lo, max(off) AS hi FROM p
  WHERE ibp_systolic IS NOT NULL OR ibp_diastolic IS NOT NULL OR ibp_mean IS NOT NULL GROUP BY 1),
n AS (SELECT user_id AS id FROM p WHERE off BETWEEN 0 AND {5 * DAY} AND (ibp_systolic IS NOT NULL OR ibp_mean IS NOT NULL)
  GROUP BY 1 HAVING count(*) >= 3),
f AS (SELECT stay FROM (SELECT c_custkey AS stay, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS k
  FROM customer) WHERE k = 1)
SELECT p.user_id AS patientunitstayid, p.event_id, p.off, p.ibp_systolic, p.ibp_diastolic, p.ibp_mean FROM p
JOIN c ON c.id = p.user_id JOIN n ON n.id = p.user_id JOIN f ON f.stay = p.user_id
WHERE c.lo <= {5 * DAY} AND c.hi - c.lo >= {5 * DAY} AND p.off BETWEEN c.lo AND c.hi""",
)
def cohort_readings(spark, folder):
    spans = _cohort(spark, folder)
    visits = load(spark, folder, "customer").select(
        F.col("c_custkey").alias(KEY), "c_nationkey", "c_mktsegment", F.col("c_custkey").alias("visit")
    )
    firsts = first_stay_cohort(visits, spans, ("c_nationkey", "c_mktsegment"), "visit", KEY)
    p = pressures(spark, folder).withColumnRenamed("user_id", KEY).drop("t_us")
    return exposure.cohort_readings(p, firsts, spans, KEY, "off")
