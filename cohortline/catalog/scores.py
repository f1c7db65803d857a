"""Queries for the organ failure scores. Customers are the stays; events supply the charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortline.catalog.drugs import EVIDENCE, KEY, recode, respcare, respiratory_treatment
from cohortline.catalog.frames import READINGS, readings, rounded, with_items
from cohortline.catalog.registry import query
from cohortline.plans import severity
from cohortline.sources.io import load


def patient(spark, folder):
    return load(spark, folder, "customer").select(F.col("c_custkey").alias(KEY))


def _stay():
    return F.col("user_id").alias(KEY)


def cuff(spark, folder):
    r = readings(spark, folder).filter(F.col("event_type") == "view")
    return r.select(_stay(), F.col("off").alias("observationoffset"), F.col("v").alias("noninvasivemean"))


def line(spark, folder):
    r = readings(spark, folder).filter(F.col("event_type").isin("click", "signup"))
    return r.select(
        _stay(),
        F.col("off").alias("observationoffset"),
        F.when(F.col("event_type") == "click", F.col("v")).alias("systemicmean"),
        F.when(F.col("event_type") == "signup", F.col("v")).alias("sao2"),
    )


def drips(spark, folder):
    names = {
        "purchase": "Dopamine (ml/hr)",
        "error": "Norepinephrine (mcg/min)",
        "signup": "Dobutamine (mcg/kg/min)",
        "view": "DOPamine STD (mcg/kg/min)",
    }
    return readings(spark, folder).select(
        _stay(),
        F.col("off").alias("infusionoffset"),
        recode("event_type", names, "Saline (ml/hr)").alias("drugname"),
        F.coalesce(F.col("v").cast("string"), F.lit("OFF")).alias("drugrate"),
    )


def charting(spark, folder):
    text = F.when(F.col("event_type") == "click", F.col("value").cast("string"))
    text = text.when(F.col("event_type") == "view", "ventilator standby").otherwise("room air")
    return readings(spark, folder).select(_stay(), F.col("off").alias("respchartoffset"), text.alias("respchartvalue"))


def nursing(spark, folder):
    whole = F.floor("value")
    label = recode("event_type", {"view": "FiO2 (%)", "signup": "Glasgow"}, "Other")
    name = recode("event_type", {"signup": "GCS Total"}, "Value")
    number = F.when(F.col("event_type") == "signup", (whole % 13 + 3).cast("string"))
    number = number.when(F.col("event_type") == "view", (whole % 60).cast("string")).otherwise("n/a")
    return readings(spark, folder).select(
        _stay(),
        F.col("off").alias("nursingchartoffset"),
        F.col("off").alias("nursingchartentryoffset"),
        label.alias("nursingchartcelltypevallabel"),
        name.alias("nursingchartcelltypevalname"),
        number.alias("nursingchartvalue"),
    )


def labs(spark, folder):
    v = F.col("v")
    names = {"click": "platelets x 1000", "view": "total bilirubin", "error": "paO2", "purchase": "creatinine"}
    return readings(spark, folder).select(
        _stay(),
        F.col("off").alias("labresultoffset"),
        recode("event_type", names, "glucose").alias("labname"),
        recode("event_type", {"view": v / 5, "purchase": v / 20, "click": v, "error": v}).alias("labresult"),
    )


def intake(spark, folder):
    return load(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias(KEY),
        F.col("l_partkey").alias("intakeoutputoffset"),
        F.col("l_quantity").alias("outputtotal"),
    )


def _window(cte: str, select: str, low: int, where: str = "TRUE") -> str:
    return f"{cte} AS (SELECT user_id AS id, {select} FROM r WHERE off BETWEEN {low} AND 1440 AND {where} GROUP BY user_id)"


CARDIO = [
    _window("cuff", "min(v) AS m", -1440, "event_type = 'view'"),
    _window("line", "min(v) FILTER (event_type = 'click') AS m, min(v) FILTER (event_type = 'signup') AS sao2", -1440),
    _window(
        "drip",
        """GREATEST(max(CASE WHEN event_type = 'purchase' THEN round(v / 3, 3) END), max(CASE WHEN event_type = 'view' THEN v END)) AS dopa,
  max(CASE WHEN event_type = 'error' THEN round(v / 80 + 1e-12, 3) END) AS norepi,
  max(CASE WHEN event_type = 'signup' THEN 1 END) AS dobu""",
        -120,
        "v IS NOT NULL",
    ),
    """cv AS (SELECT c_custkey AS id, COALESCE(cuff.m, line.m) AS map, dopa, norepi, dobu,
  CASE WHEN dopa >= 15 OR norepi > 0.1 THEN 4 WHEN dopa > 5 OR (norepi > 0 AND norepi <= 0.1) THEN 3
       WHEN dopa <= 5 OR dobu > 0 THEN 2 WHEN COALESCE(cuff.m, line.m) < 70 THEN 1 ELSE 0 END AS sofa_cv
  FROM customer LEFT JOIN cuff ON cuff.id = c_custkey LEFT JOIN line ON line.id = c_custkey LEFT JOIN drip ON drip.id = c_custkey)""",
]

RATIO = [
    _window("rc1", "max(value) AS rcfio2", -120, "event_type = 'click'"),
    _window("nc1", "max(CAST(floor(value) AS BIGINT) % 60) AS ncfio2", -120, "event_type = 'view'"),
    _window("gc1", "min(CAST(floor(value) AS BIGINT) % 13 + 3) AS gcs", -1440, "event_type = 'signup'"),
    _window(
        "lb",
        """min(v) FILTER (event_type = 'error') AS pao2, max(v / 20) FILTER (event_type = 'purchase') AS creat,
  max(v / 5) FILTER (event_type = 'view') AS bili, min(v) FILTER (event_type = 'click') AS plt""",
        -1440,
    ),
    """fi AS (SELECT c_custkey AS id, CASE WHEN rcfio2 > 20 THEN rcfio2 WHEN ncfio2 > 20 THEN ncfio2::DOUBLE
    WHEN ncfio2 = 1 THEN 100.0::DOUBLE END AS fio2, pao2, sao2
  FROM customer LEFT JOIN rc1 ON rc1.id = c_custkey LEFT JOIN nc1 ON nc1.id = c_custkey
  LEFT JOIN lb ON lb.id = c_custkey LEFT JOIN line ON line.id = c_custkey)""",
    """rs AS (SELECT *, COALESCE(pao2, 100) / COALESCE(nullif(fio2, 0), 21) AS pf,
  COALESCE(sao2, 100) / COALESCE(nullif(fio2, 0), 21) AS sf FROM fi)""",
    """rsp AS (SELECT *, CASE WHEN pf < 1 OR sf < 0.67 THEN 4 WHEN pf BETWEEN 1 AND 2 OR sf BETWEEN 0.67 AND 1.41 THEN 3
  WHEN pf BETWEEN 2 AND 3 OR sf BETWEEN 1.42 AND 2.2 THEN 2 WHEN pf BETWEEN 3 AND 4 OR sf BETWEEN 2.21 AND 3.01 THEN 1
  ELSE 0 END AS sofa_respi FROM rs)""",
]

RENAL = [
    """uo AS (SELECT id, sum(q) AS uo FROM (SELECT DISTINCT l_orderkey AS id, l_partkey, l_quantity AS q FROM lineitem
  WHERE l_partkey BETWEEN 0 AND 1440) GROUP BY id)""",
    """rn AS (SELECT c_custkey AS id, creat, uo, CASE WHEN uo < 200 OR creat > 5 THEN 4 WHEN uo < 500 OR creat > 3.5 THEN 3
  WHEN creat BETWEEN 2 AND 3.5 THEN 2 WHEN creat BETWEEN 1.2 AND 2 THEN 1 ELSE 0 END AS sofarenal
  FROM customer LEFT JOIN lb ON lb.id = c_custkey LEFT JOIN uo ON uo.id = c_custkey)""",
]

OTHERS = [
    """ot AS (SELECT c_custkey AS id, CAST(gcs AS DOUBLE) AS gcs, bili, plt,
  CASE WHEN plt < 20 THEN 4 WHEN plt < 50 THEN 3 WHEN plt < 100 THEN 2 WHEN plt < 150 THEN 1 ELSE 0 END AS sofacoag,
  CASE WHEN bili > 12 THEN 4 WHEN bili > 6 THEN 3 WHEN bili > 2 THEN 2 WHEN bili > 1.2 THEN 1 ELSE 0 END AS sofaliver,
  CASE WHEN gcs = 15 THEN 0 WHEN gcs >= 13 THEN 1 WHEN gcs >= 10 THEN 2 WHEN gcs >= 6 THEN 3 WHEN gcs >= 3 THEN 4 ELSE 0 END AS sofacns
  FROM customer LEFT JOIN gc1 ON gc1.id = c_custkey LEFT JOIN lb ON lb.id = c_custkey)""",
]


@query(
    "score_cardio",
    with_items(READINGS, *CARDIO)
    + "SELECT id AS patientunitstayid, map, round(dopa, 3) AS dopa, round(norepi, 3) AS norepi, dobu, sofa_cv FROM cv",
)
def score_cardio(spark, folder):
    out = severity.cardio_score(
        patient(spark, folder), cuff(spark, folder), line(spark, folder), drips(spark, folder)
    )
    return rounded(out, 3, "dopa", "norepi")


@query(
    "score_ratio",
    with_items(READINGS, EVIDENCE, *CARDIO[:2], *RATIO)
    + """, mv AS (SELECT DISTINCT id FROM (SELECT id FROM rc WHERE off BETWEEN -1440 AND 1440
  UNION ALL SELECT user_id FROM r WHERE event_type = 'view' AND off BETWEEN -1440 AND 1440
  UNION ALL SELECT user_id FROM r WHERE event_type = 'click' AND CAST(value AS VARCHAR) LIKE '%840%' AND off BETWEEN -1440 AND 1440
  UNION ALL SELECT id FROM rx WHERE off BETWEEN -1440 AND 1440))
SELECT rsp.id AS patientunitstayid, fio2, pao2, sao2, CASE WHEN mv.id IS NOT NULL THEN 1 END AS mechvent,
  round(pf, 6) AS pf, round(sf, 6) AS sf, sofa_respi FROM rsp LEFT JOIN mv ON mv.id = rsp.id""",
)
def score_ratio(spark, folder):
    out = severity.respiratory_score(
        patient(spark, folder),
        charting(spark, folder),
        nursing(spark, folder),
        line(spark, folder),
        labs(spark, folder),
        respcare(spark, folder),
        respiratory_treatment(spark, folder),
    )
    return rounded(out, 6, "pf", "sf")


@query(
    "score_volume",
    with_items(READINGS, RATIO[3], *RENAL) + "SELECT id AS patientunitstayid, round(creat, 6) AS creat, uo, sofarenal FROM rn",
)
def score_volume(spark, folder):
    return rounded(severity.renal_score(patient(spark, folder), labs(spark, folder), intake(spark, folder)), 6, "creat")


@query(
    "score_extremes",
    with_items(READINGS, RATIO[2], RATIO[3], *OTHERS)
    + "SELECT id AS patientunitstayid, gcs, round(bili, 6) AS bili, plt, sofacoag, sofaliver, sofacns FROM ot",
)
def score_extremes(spark, folder):
    return rounded(severity.other_scores(patient(spark, folder), nursing(spark, folder), labs(spark, folder)), 6, "bili")


@query(
    "score_coma_parts",
    with_items(READINGS)
    + """, g AS (SELECT user_id AS id, sum(CAST(floor(value) AS BIGINT) % 5)::DOUBLE AS gcs FROM r
  WHERE event_type IN ('click', 'view', 'signup') AND off BETWEEN -1440 AND 1440 GROUP BY 1)
SELECT c_custkey AS patientunitstayid, gcs, CASE WHEN gcs = 15 THEN 0 WHEN gcs >= 13 THEN 1 WHEN gcs >= 10 THEN 2
  WHEN gcs >= 6 THEN 3 WHEN gcs >= 3 THEN 4 ELSE 0 END AS sofacns FROM customer LEFT JOIN g ON g.id = c_custkey""",
)
def score_coma_parts(spark, folder):
    paths = {"click": "notes/GCS/Eyes Score/4", "view": "notes/GCS/Verbal Score/5", "signup": "notes/GCS/Motor Score/6"}
    exam = readings(spark, folder).select(
        _stay(),
        F.col("off").alias("physicalexamoffset"),
        recode("event_type", paths, "notes/other").alias("physicalexampath"),
        (F.floor("value") % 5).cast("string").alias("physicalexamvalue"),
    )
    out = severity.other_scores(patient(spark, folder), nursing(spark, folder), labs(spark, folder), exam)
    return out.select(KEY, "gcs", "sofacns")


@query(
    "score_total",
    with_items(READINGS, *CARDIO, *RATIO, *RENAL, *OTHERS)
    + """SELECT cv.id AS patientunitstayid, sofa_cv, sofa_respi, sofarenal, sofacoag, sofaliver, sofacns,
  sofa_cv + sofa_respi + sofarenal + sofacoag + sofaliver + sofacns AS sofatotal
FROM cv JOIN rsp ON rsp.id = cv.id JOIN rn ON rn.id = cv.id JOIN ot ON ot.id = cv.id""",
)
def score_total(spark, folder):
    return severity.total_score(
        patient(spark, folder),
        cuff(spark, folder),
        line(spark, folder),
        drips(spark, folder),
        charting(spark, folder),
        nursing(spark, folder),
        labs(spark, folder),
        intake(spark, folder),
    )
