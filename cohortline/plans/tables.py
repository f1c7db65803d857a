"""Wide analysis tables: one row per stay of the cohort, every arm reduced to one row per key first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.functions.exprs import flag, to_number
from cohortline.operators.intervals import sum_duration
from cohortline.operators.joins import enrich
from cohortline.operators.select import dedupe, select_as
from cohortline.plans import fluids, history, meds

KEY = "patientunitstayid"

DEMOGRAPHICS = {
    "age": "age",
    "gender": "gender",
    "ethnicity": "ethnicity",
    "unittype": "unittype",
    "admissionheight": "admissionheight",
    "admissionweight": "admissionweight",
    "dischargeweight": "dischargeweight",
}
OUTCOMES = {
    "icu_mort": "actualicumortality",
    "icu_los": "actualiculos",
    "hosp_mort": "actualhospitalmortality",
    "hosp_los": "actualhospitallos",
    "ventilation_duration_days": "unabridgedactualventdays",
}


def offset_table(
    cohort: DataFrame,
    patient: DataFrame,
    results: DataFrame,
    intakeoutput: DataFrame,
    diagnosis: DataFrame,
    treatment: DataFrame,
    infusiondrug: DataFrame,
    aki: DataFrame,
    detail: DataFrame,
    result_version: str = "apacheversion",
) -> DataFrame:
    """Analysis table of the offset layout: demographics, outcomes, fluid, history, sepsis, drugs, AKI.

    A stay may have several result versions; the first one by version is used.
    """
    outcomes = dedupe(results, [KEY], [result_version])
    arms = [
        (select_as(outcomes, {KEY: KEY, **OUTCOMES}), KEY),
        (select_as(patient, {KEY: KEY, **DEMOGRAPHICS}), KEY),
        (fluids.last_net_total(intakeoutput), KEY),
        (history.history_flags(diagnosis), KEY),
        (history.sepsis_flag(patient), KEY),
        (meds.vasopressor_stays(treatment), KEY),
        (meds.infusion_flags(infusiondrug, per_stay=True).withColumnRenamed("vasopressin", "vaso_infusion"), KEY),
        (aki.select(KEY, F.col("aki").alias("aki_creat")), KEY),
        (detail.select(KEY, "apache_iv"), KEY),
    ]
    return enrich(cohort.select(KEY).distinct(), arms)


def timed_table(
    detail: DataFrame,
    stays: DataFrame,
    patients: DataFrame,
    size: DataFrame,
    ventilation: DataFrame,
    balance: DataFrame,
    comorbidity: DataFrame,
    diagnoses: DataFrame,
    sepsis: DataFrame,
    aki: DataFrame,
    pressors: DataFrame,
    vasopressin: DataFrame,
    severity: DataFrame,
    sofa: DataFrame,
) -> DataFrame:
    """Analysis table of the timestamp layout for first stays of first admissions."""
    first = detail.filter((F.col("first_hosp_stay") == "Y") & (F.col("first_icu_stay") == "Y"))
    diabetes = F.col("diabetes_uncomplicated") + F.col("diabetes_complicated") >= 1
    arms = [
        (stays.select("icustay_id", "first_careunit"), "icustay_id"),
        (sofa.select("icustay_id", "sofa"), "icustay_id"),
        (patients.select("subject_id", "dod"), "subject_id"),
        (size.select("icustay_id", "weight_first", "weight_last", "height_first", "height_last"), "icustay_id"),
        (sum_duration(ventilation, ["icustay_id"], "duration_hours", "vent_duration_days"), "icustay_id"),
        (balance.select("icustay_id", "nettotal"), "icustay_id"),
        (
            comorbidity.select("hadm_id", "hypertension", "congestive_heart_failure", flag(diabetes).alias("diabetes")),
            "hadm_id",
        ),
        (history.comorbidity_flags(diagnoses), "hadm_id"),
        (sepsis.select("hadm_id", F.col("angus").alias("sepsis")), "hadm_id"),
        (aki.select("icustay_id", "aki_48hr"), "icustay_id"),
        (pressors.groupBy("icustay_id").agg(F.min("vasonum").alias("vaspor")), "icustay_id"),
        (vasopressin.groupBy("icustay_id").agg(F.min("vasonum").alias("vaspin")), "icustay_id"),
        (severity.select("icustay_id", "apsiii", "apsiii_prob"), "icustay_id"),
    ]
    wide = enrich(first, arms)
    return wide.withColumn("icu_mortality", flag(F.col("dod") <= F.col("outtime"))).drop("dod")


def archive_table(
    cohort: DataFrame,
    arms: Sequence[DataFrame],
    key: str = KEY,
    age: str = "age",
    age_range: tuple[int, int] = (17, 89),
    group: str = "apachedxgroup",
) -> DataFrame:
    """Earlier cohort table: star of arms, one row per stay, adults by guarded age text, sepsis by group.

    Rows are made unique per arm before the joins, so a stay is never multiplied.
    """
    unique = [dedupe(a, [key], [c for c in a.columns if c != key]) for a in arms]
    wide = enrich(cohort.select(key).distinct(), [(a, key) for a in unique])
    years = to_number(age, r"^[0-9]+$")
    return wide.filter((years > age_range[0]) & (years < age_range[1])).withColumn(
        "sepsis_binary", flag(F.col(group) == "Sepsis")
    )


def cohort_infusion_hours(infusions: DataFrame, key: str = KEY) -> DataFrame:
    """Whole span of infusion entries per stay in hours."""
    return infusions.groupBy(key).agg(((F.max("infusionoffset") - F.min("infusionoffset")) / 60.0).alias("duration_hour"))
