"""Kidney injury from creatinine peaks against a baseline, and from a charted urine flag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.functions import vocab
from cohortline.functions.exprs import flag, like_any
from cohortline.operators.joins import exclude, restrict
from cohortline.operators.select import first_by, peak_by
from cohortline.operators.timeseries import any_in_window

KEY = "patientunitstayid"
HALF_DAY, TWO_DAYS, WEEK = 720, 2880, 10080


def baseline_creatinine(lab: DataFrame, key: str = KEY) -> DataFrame:
    """First creatinine within half a day of admission, with its time."""
    near = lab.filter((F.col("labname") == "creatinine") & F.col("labresultoffset").between(-HALF_DAY, HALF_DAY))
    return first_by(near, [key, "labname"], "labresultoffset", ["labresult"]).select(
        key, F.col("labresult").alias("creat1"), F.col("labresultoffset").alias("creat1offset")
    )


def peak_creatinine(lab: DataFrame, horizon: int, name: str, key: str = KEY) -> DataFrame:
    """Highest creatinine from admission to the horizon, with its time."""
    rows = lab.filter(F.col("labname").like("creatinine%"))
    return peak_by(rows, [key], "labresult", "labresultoffset", 0, horizon).select(
        key, F.col("labresult").alias(name), F.col("labresultoffset").alias(f"{name}_offset")
    )


def peak_to_discharge(lab: DataFrame, patient: DataFrame, horizon: int = WEEK, key: str = KEY) -> DataFrame:
    """Every stay with its peak, the peak's time and the gap from there to discharge."""
    peak = peak_creatinine(lab, horizon, "peakcreat7d", key)
    return (
        patient.select(key, "unitdischargeoffset")
        .join(peak, key, "left")
        .withColumn("peakcreat7d_to_discharge_offsetgap", F.col("unitdischargeoffset") - F.col("peakcreat7d_offset"))
        .drop("unitdischargeoffset")
    )


def chronic_dialysis(treatment: DataFrame, key: str = KEY) -> DataFrame:
    text = F.lower("treatmentstring")
    listed = treatment.withColumn("_t", text).filter(
        like_any("_t", vocab.RENAL_REPLACEMENT_PATTERNS) & F.col("_t").like("%chronic%")
    )
    return listed.select(key).distinct()


def creatinine_aki(lab: DataFrame, treatment: DataFrame, key: str = KEY) -> DataFrame:
    """Flag per stay with a baseline and a later peak: more than 1.5 times it within 7 days, or more than
    0.3 above it within 48 hours. Stays on chronic dialysis are left out.

    Baseline and both peaks come from one grouping of the creatinine rows.
    """
    t, v = F.col("labresultoffset"), F.col("labresult")
    base = (F.col("labname") == "creatinine") & t.between(-HALF_DAY, HALF_DAY)
    per_stay = (
        lab.filter(F.col("labname").like("creatinine%") & t.between(-HALF_DAY, WEEK))
        .groupBy(key)
        .agg(
            F.count_if(base).alias("n_base"),
            F.min_by(v, F.when(base, F.struct(t, v))).alias("creat1"),
            F.max(F.when(t.between(0, WEEK), v)).alias("peakcreat7d"),
            F.max(F.when(t.between(0, TWO_DAYS), v)).alias("peakcreat48h"),
        )
        .filter((F.col("n_base") > 0) & (F.col("peakcreat7d").isNotNull() | F.col("peakcreat48h").isNotNull()))
    )
    rose = F.col("peakcreat7d") / F.nullif(F.col("creat1"), F.lit(0.0)) > 1.5
    jumped = F.col("peakcreat48h") - F.col("creat1") > 0.3
    flagged = per_stay.select(
        key, "creat1", "peakcreat7d", "peakcreat48h", flag(rose).alias("c_7d"), flag(jumped).alias("c_48h")
    ).withColumn("aki", F.greatest("c_7d", "c_48h"))
    return exclude(flagged, chronic_dialysis(treatment, key), key)


def urine_aki_7d(series: DataFrame, recorded: DataFrame, key: str = KEY) -> DataFrame:
    """Any urine-based flag between 6 hours and 7 days, for stays that have urine records."""
    kept = restrict(series, recorded, key)
    return any_in_window(kept, [key], "chartoffset", "AKI", {"AKI_uo7day": (360, WEEK)})


def either_aki(stays: DataFrame, creatinine: DataFrame, urine: DataFrame, key: str = KEY) -> DataFrame:
    """Both flags beside each stay, absent ones as 0, and their maximum."""
    return (
        stays.select(key)
        .join(creatinine.select(key, F.col("aki").alias("aki_creat")), key, "left")
        .join(urine.select(key, "AKI_uo7day"), key, "left")
        .fillna(0, ["aki_creat", "AKI_uo7day"])
        .withColumn("AKI_7d", F.greatest("aki_creat", "AKI_uo7day"))
    )
