"""Fluid balance, heights and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.functions import vocab
from cohortline.functions.exprs import convert, epoch_micros, in_list, not_error
from cohortline.operators.joins import band_join, enrich, lookup_join
from cohortline.operators.select import first_last_min_max, last_by
from cohortline.operators.timeseries import net_balance

DAY_US = 86_400_000_000
INCH = 2.54


def last_net_total(intakeoutput: DataFrame, key: str = "patientunitstayid") -> DataFrame:
    """Net fluid total on the last intake/output row of a stay."""
    return last_by(intakeoutput, [key], "intakeoutputoffset", ["nettotal"]).select(key, "nettotal")


def fluid_balance(bolus: DataFrame, rate: DataFrame, urine: DataFrame, distinct: bool = False) -> DataFrame:
    """All fluids of both charting systems in ml, minus urine, per stay with any input."""
    unit = F.col("amountuom")
    poured = bolus.filter(
        in_list("itemid", vocab.FLUID_ITEMS_BOLUS) & unit.rlike("(?i)ml") & (F.col("amount") > 0)
    ).select("icustay_id", "amount")
    pumped = rate.filter(
        in_list("itemid", vocab.FLUID_ITEMS_RATE)
        & unit.rlike("(?i)ml|l")
        & (F.col("starttime") <= F.col("endtime"))
        & (F.col("amount") > 0)
    ).select("icustay_id", convert("amount", [(unit.isin("l", "L"), F.col("amount") * 1000)]).alias("amount"))
    given = urine.select("icustay_id", F.col("value").alias("amount"))
    return net_balance([poured, pumped], given, "icustay_id", distinct)


def charted_heights(chartevents: DataFrame, patients: DataFrame) -> DataFrame:
    """Heights in cm from charts, NULL where implausible for an infant or an adult."""
    rows = chartevents.filter(
        in_list("itemid", [*vocab.HEIGHT_INCH_ITEMS, *vocab.HEIGHT_CM_ITEMS])
        & F.col("valuenum").isNotNull()
        & (F.col("valuenum") != 0)
        & not_error("error")
    )
    cm = convert("valuenum", [(in_list("itemid", vocab.HEIGHT_INCH_ITEMS), F.col("valuenum") * INCH)])
    h = F.col("height")
    grown = F.col("charttime") > F.col("dob") + F.expr("INTERVAL '1' YEAR")
    plausible = F.when(~grown & (h < 80), h).when(grown & (h > 120) & (h < 230), h)
    charted = rows.select("subject_id", "icustay_id", "charttime", cm.alias("height"))
    dated = lookup_join(charted, patients.select("subject_id", "dob"), ["subject_id"])
    return dated.select("icustay_id", "charttime", plausible.alias("height"))


def body_size(
    stays: DataFrame, weights: DataFrame, chartevents: DataFrame, patients: DataFrame, keep_null: bool = False
) -> DataFrame:
    """First, last, smallest and largest weight and height per stay, to two decimals."""
    w = first_last_min_max(weights, ["icustay_id"], "starttime", "weight", ["weight"], keep_null=True)
    heights = charted_heights(chartevents, patients)
    h = first_last_min_max(heights, ["icustay_id"], "charttime", "height", ["height"], keep_null=keep_null)
    wide = enrich(stays.select("icustay_id"), [(w, "icustay_id"), (h, "icustay_id")])
    return wide.select("icustay_id", *[F.round(c, 2).alias(c) for c in wide.columns if c != "icustay_id"])


def admission_height(stays: DataFrame, patients: DataFrame, chartevents: DataFrame, echo: DataFrame) -> DataFrame:
    """Adult height near admission: the chart average, else the average over echo notes, with both parts.

    The chart counts within a day of admission. Echo notes count up to a day after the person's last
    admission; since a note that qualifies for one admission qualifies for every later one, the
    notes are compared with one time per person and no pairs are formed.
    """
    admitted = stays.select("icustay_id", "subject_id", epoch_micros("intime").alias("in_us"))
    cm = convert("valuenum", [(in_list("itemid", vocab.HEIGHT_INCH_ITEMS), F.col("valuenum") * INCH)])
    charted = chartevents.filter(
        in_list("itemid", [*vocab.HEIGHT_INCH_ITEMS, *vocab.HEIGHT_CM_ITEMS])
        & F.col("valuenum").isNotNull()
        & (F.col("valuenum") != 0)
        & not_error("error")
    ).select("icustay_id", epoch_micros("charttime").alias("t_us"), cm.alias("height"))
    near = band_join(admitted, charted, "icustay_id", "in_us", "t_us", -DAY_US + 1, DAY_US)
    chart = near.filter(F.col("height") > 100).groupBy("icustay_id").agg(F.avg("height").alias("height_chart"))
    last_admission = admitted.groupBy("subject_id").agg(F.max("in_us").alias("last_us"))
    notes = echo.select("subject_id", epoch_micros("charttime").alias("t_us"), "height")
    noted = (
        lookup_join(notes, last_admission, ["subject_id"])
        .filter((F.col("t_us") < F.col("last_us") + DAY_US) & (F.col("height") * INCH > 100))
        .groupBy("subject_id")
        .agg((F.avg("height") * INCH).alias("height_echo"))
    )
    adults = (
        stays.select("icustay_id", "subject_id", "intime")
        .join(patients.select("subject_id", "dob"), "subject_id")
        .filter(F.col("intime") > F.col("dob") + F.expr("INTERVAL '1' YEAR"))
        .select("icustay_id", "subject_id")
    )
    wide = enrich(adults, [(chart, "icustay_id"), (noted, "subject_id")])
    return wide.select(
        "icustay_id", F.coalesce("height_chart", "height_echo").alias("height"), "height_chart", "height_echo"
    )
