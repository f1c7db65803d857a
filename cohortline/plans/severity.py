"""Organ failure sub-scores 0-4 and their total (offset layout).

Each source table is reduced to one row per stay in one pass that serves every sub-score reading it;
the scores are then plain column ladders over the joined row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions.exprs import ladder, to_number
from cohortline.operators.joins import enrich
from cohortline.operators.timeseries import sum_distinct_rows
from cohortline.plans.meds import ventilated_stays

KEY = "patientunitstayid"
DAY = 1440


def _near(col: str) -> Column:
    return F.col(col).between(-DAY, DAY)


def _given(col: str) -> Column:
    return F.col(col).between(-120, DAY)


# The cut-offs of the score ladders in this module; each ladder takes its first rung that holds.

# --------------------------------------------------------------------------- one row per stay and source


def aperiodic_minima(vitalaperiodic: DataFrame) -> DataFrame:
    rows = vitalaperiodic.filter(_near("observationoffset"))
    return rows.groupBy(KEY).agg(F.min("noninvasivemean").alias("map_cuff"))


def periodic_minima(vitalperiodic: DataFrame) -> DataFrame:
    rows = vitalperiodic.filter(_near("observationoffset"))
    return rows.groupBy(KEY).agg(F.min("systemicmean").alias("map_line"), F.min("sao2").alias("sao2"))


def infusion_maxima(infusiondrug: DataFrame) -> DataFrame:
    """Highest dopamine and norepinephrine rates in mcg/kg/min (80 kg assumed) and any dobutamine."""
    name, rate = F.lower("drugname"), to_number("drugrate")
    rows = infusiondrug.filter(_given("infusionoffset")).select(
        KEY, name.alias("drug"), rate.alias("rate"), F.col("drugrate").alias("text")
    )
    drug, r = F.col("drug"), F.col("rate")
    per_hour, per_kg, per_min = (drug.like(p) for p in ("%(ml/hr)%", "%(mcg/kg/min)%", "%(mcg/min)%"))

    def per_kg_min(divisor: int) -> Column:
        # Decimal, so that a rate halfway between two thousandths rounds up as exact arithmetic has it.
        return F.round(r.cast("decimal(28,8)") / divisor, 3).cast("double")

    dopa = F.when(drug.like("%dopamine%"), F.when(per_hour, per_kg_min(3)).when(per_kg, r))
    norepi = F.when(
        drug.like("%norepinephrine%"),
        F.when(per_hour, per_kg_min(300)).when(per_min, per_kg_min(80)).when(per_kg, r),
    )
    dobu = F.when(drug.like("%dobutamin%") & r.isNotNull() & (F.col("text") != "0"), 1)
    return (
        rows.filter(r.isNotNull())
        .groupBy(KEY)
        .agg(F.max(dopa).alias("dopa"), F.max(norepi).alias("norepi"), F.max(dobu).alias("dobu"))
    )


def charted_oxygen(respcharting: DataFrame) -> DataFrame:
    """Highest numeric respiratory chart value, kept above 20 (lower ones are litres per minute)."""
    rows = respcharting.filter(_given("respchartoffset"))
    return rows.groupBy(KEY).agg(F.max(to_number("respchartvalue")).alias("rcfio2")).filter(F.col("rcfio2") > 20)


def nursing_extremes(nursecharting: DataFrame) -> DataFrame:
    """Highest charted inspired oxygen and lowest coma score total."""
    number = to_number("nursingchartvalue")
    fio2 = F.lower("nursingchartcelltypevallabel").like("%fio2%") & _given("nursingchartentryoffset")
    gcs = F.lower("nursingchartcelltypevalname").like("%gcs total%") & _near("nursingchartoffset")
    return (
        nursecharting.filter(fio2 | gcs)
        .groupBy(KEY)
        .agg(F.max(F.when(fio2, number)).alias("ncfio2"), F.min(F.when(gcs, number)).alias("gcs"))
    )


def examined_coma_score(physicalexam: DataFrame) -> DataFrame:
    """Coma score as the sum of its eye, verbal and motor parts."""
    path = F.lower("physicalexampath")
    part = path.like("%gcs/eyes%") | path.like("%gcs/verbal%") | path.like("%gcs/motor%")
    rows = physicalexam.filter(part & _near("physicalexamoffset"))
    return rows.groupBy(KEY).agg(F.sum(to_number("physicalexamvalue")).alias("gcs"))


def lab_extremes(lab: DataFrame) -> DataFrame:
    name, value = F.lower("labname"), F.col("labresult")

    def when_like(pattern: str) -> Column:
        return F.when(name.like(pattern), value)

    return (
        lab.filter(_near("labresultoffset"))
        .groupBy(KEY)
        .agg(
            F.min(when_like("pao2%")).alias("pao2"),
            F.max(when_like("creatin%")).alias("creat"),
            F.max(when_like("total bili%")).alias("bili"),
            F.min(when_like("platelet%")).alias("plt"),
        )
    )


def day_urine(intakeoutput: DataFrame) -> DataFrame:
    """First-day urine: repeated (time, total) rows of a stay count once."""
    return sum_distinct_rows(intakeoutput, [KEY], "intakeoutputoffset", "outputtotal", 0, DAY).withColumnRenamed(
        "outputtotal", "uo"
    )


# --------------------------------------------------------------------------- ladders

def cardio_ladder() -> Column:
    dopa, norepi, c = F.col("dopa"), F.col("norepi"), F.col
    return ladder(
        [
            ((dopa >= 15) | (norepi > 0.1), 4),
            ((dopa > 5) | ((norepi > 0) & (norepi <= 0.1)), 3),
            ((dopa <= 5) | (c("dobu") > 0), 2),
            (c("map") < 70, 1),
        ],
        0,
    )


def oxygen_percent() -> Column:
    rc, nc = F.col("rcfio2"), F.col("ncfio2")
    return ladder([(rc > 20, rc), (nc > 20, nc), (nc == 1, F.lit(100.0))], None)


def respiratory_ladder(pf: Column, sf: Column) -> Column:
    """Oxygen is in percent, so the ratios are a hundredth of the usual ones; the rung order settles borders."""
    return ladder(
        [
            ((pf < 1) | (sf < 0.67), 4),
            (pf.between(1, 2) | sf.between(0.67, 1.41), 3),
            (pf.between(2, 3) | sf.between(1.42, 2.2), 2),
            (pf.between(3, 4) | sf.between(2.21, 3.01), 1),
        ],
        0,
    )


def renal_ladder() -> Column:
    uo, creat = F.col("uo"), F.col("creat")
    return ladder(
        [
            ((uo < 200) | (creat > 5), 4),
            ((uo < 500) | (creat > 3.5), 3),
            (creat.between(2, 3.5), 2),
            (creat.between(1.2, 2), 1),
        ],
        0,
    )


def _rungs(col: str, tests: Sequence[tuple[float, int]], below: bool) -> Column:
    c = F.col(col)
    return ladder([((c < t) if below else (c > t), s) for t, s in tests], 0)


def coagulation_ladder() -> Column:
    return _rungs("plt", ((20, 4), (50, 3), (100, 2), (150, 1)), below=True)


def liver_ladder() -> Column:
    return _rungs("bili", ((12, 4), (6, 3), (2, 2), (1.2, 1)), below=False)


def coma_ladder() -> Column:
    gcs = F.col("gcs")
    return ladder([(gcs == 15, 0), (gcs >= 13, 1), (gcs >= 10, 2), (gcs >= 6, 3), (gcs >= 3, 4)], 0)


# --------------------------------------------------------------------------- scores


def _with_cardio(df: DataFrame) -> DataFrame:
    return df.withColumn("map", F.coalesce("map_cuff", "map_line")).withColumn("sofa_cv", cardio_ladder())


def _with_respiratory(df: DataFrame) -> DataFrame:
    percent = F.coalesce(F.nullif(F.col("fio2"), F.lit(0.0)), F.lit(21.0))
    return (
        df.withColumn("fio2", oxygen_percent())
        .withColumn("pf", F.coalesce(F.col("pao2"), F.lit(100.0)) / percent)
        .withColumn("sf", F.coalesce(F.col("sao2"), F.lit(100.0)) / percent)
        .withColumn("sofa_respi", respiratory_ladder(F.col("pf"), F.col("sf")))
    )


def _with_others(df: DataFrame) -> DataFrame:
    return df.withColumns({"sofacoag": coagulation_ladder(), "sofaliver": liver_ladder(), "sofacns": coma_ladder()})


def cardio_score(patient, vitalaperiodic, vitalperiodic, infusiondrug) -> DataFrame:
    arms = [aperiodic_minima(vitalaperiodic), periodic_minima(vitalperiodic), infusion_maxima(infusiondrug)]
    out = _with_cardio(enrich(patient.select(KEY), [(a, KEY) for a in arms]))
    return out.select(KEY, "map", "dopa", "norepi", "dobu", "sofa_cv")


def respiratory_score(patient, respcharting, nursecharting, vitalperiodic, lab, respcare, treatment) -> DataFrame:
    arms = [
        charted_oxygen(respcharting),
        nursing_extremes(nursecharting),
        periodic_minima(vitalperiodic),
        lab_extremes(lab),
        ventilated_stays(respcare, respcharting, treatment),
    ]
    out = _with_respiratory(enrich(patient.select(KEY), [(a, KEY) for a in arms]))
    return out.select(KEY, "fio2", "pao2", "sao2", "mechvent", "pf", "sf", "sofa_respi")


def renal_score(patient, lab, intakeoutput) -> DataFrame:
    out = enrich(patient.select(KEY), [(lab_extremes(lab), KEY), (day_urine(intakeoutput), KEY)])
    return out.withColumn("sofarenal", renal_ladder()).select(KEY, "creat", "uo", "sofarenal")


def other_scores(patient, nursecharting, lab, physicalexam=None) -> DataFrame:
    """Coagulation, liver and coma scores; with ``physicalexam`` the coma score is summed from its parts."""
    gcs = examined_coma_score(physicalexam) if physicalexam is not None else nursing_extremes(nursecharting)
    out = _with_others(enrich(patient.select(KEY), [(gcs.select(KEY, "gcs"), KEY), (lab_extremes(lab), KEY)]))
    return out.select(KEY, "gcs", "bili", "plt", "sofacoag", "sofaliver", "sofacns")


def total_score(
    patient, vitalaperiodic, vitalperiodic, infusiondrug, respcharting, nursecharting, lab, intakeoutput
) -> DataFrame:
    """All six sub-scores and their sum: every source is scanned and reduced once."""
    arms = [
        aperiodic_minima(vitalaperiodic),
        periodic_minima(vitalperiodic),
        infusion_maxima(infusiondrug),
        charted_oxygen(respcharting),
        nursing_extremes(nursecharting),
        lab_extremes(lab),
        day_urine(intakeoutput),
    ]
    wide = enrich(patient.select(KEY), [(a, KEY) for a in arms])
    scored = _with_others(_with_respiratory(_with_cardio(wide))).withColumn("sofarenal", renal_ladder())
    parts = ["sofa_cv", "sofa_respi", "sofarenal", "sofacoag", "sofaliver", "sofacns"]
    return scored.select(KEY, *parts, sum((F.col(p) for p in parts[1:]), F.col(parts[0])).alias("sofatotal"))
