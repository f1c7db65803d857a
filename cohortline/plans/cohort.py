"""Which stays have enough invasive pressure readings, and which stay of a person counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.functions import vocab
from cohortline.functions.exprs import flag, minutes_between
from cohortline.operators.joins import restrict
from cohortline.operators.select import first_stay, reading_ordinals

DAY = 1440


def pressure_spans(
    readings: DataFrame,
    key: str = "patientunitstayid",
    time: str = "chartoffset",
    systolic: str = "ibp_systolic",
    diastolic: str = "ibp_diastolic",
    mean: str = "ibp_mean",
    window: int = DAY,
) -> DataFrame:
    """Per stay, in one grouping: first and last time with any pressure, and what lies in the first window."""
    t = F.col(time)
    s, d, m = F.col(systolic), F.col(diastolic), F.col(mean)
    present = F.when(F.coalesce(s, d, m).isNotNull(), t)
    early = t <= window
    return readings.groupBy(key).agg(
        F.min(present).alias("min_offset"),
        F.max(present).alias("max_offset"),
        F.count_if(early & (t >= 0) & F.coalesce(s, m).isNotNull()).alias("n_early"),
        F.coalesce(F.max(flag(early & (m.isNotNull() | (s.isNotNull() & d.isNotNull())))), F.lit(0)).alias("usable"),
    )


def pressure_cohort(
    readings: DataFrame,
    key: str = "patientunitstayid",
    time: str = "chartoffset",
    systolic: str = "ibp_systolic",
    diastolic: str = "ibp_diastolic",
    mean: str = "ibp_mean",
    window: int = DAY,
    min_readings: int = 12,
    span_only: bool = False,
    by_position: bool = False,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Stays whose readings start in the first window, last at least that long, number enough in it,
    and include a mean or a full systolic/diastolic pair there.

    ``span_only`` applies the first criterion alone. ``by_position`` tests the ordinal of the last
    present reading among all rows up to the window's end instead of counting present ones; ``ties`` order rows of
    one time.
    """
    spans = pressure_spans(readings, key, time, systolic, diastolic, mean, window)
    lasting = (F.col("min_offset") <= window) & (F.col("max_offset") - F.col("min_offset") >= window)
    if span_only:
        return spans.filter(lasting).select(key, "min_offset", "max_offset")
    usable = spans.filter(lasting & (F.col("usable") == 1))
    if by_position:
        early = readings.filter(F.col(time) <= window)
        enough = reading_ordinals(early, [key], time, [systolic, mean], ties).filter(F.col("max_pos") >= min_readings)
        return restrict(usable, enough, key).select(key, "min_offset", "max_offset")
    return usable.filter(F.col("n_early") >= min_readings).select(key, "min_offset", "max_offset")


def charted_pressure_cohort(
    chartevents: DataFrame,
    stays: DataFrame,
    items: dict[str, tuple[tuple, float, float]] = vocab.COHORT_ITEMS,
    window: int = DAY,
    min_readings: int = 12,
) -> DataFrame:
    """The same idea on entity-attribute-value charts with wall-clock times: counts per series."""
    first = stays.filter((F.col("first_hosp_stay") == "Y") & (F.col("first_icu_stay") == "Y"))
    value = F.col("valuenum")
    kind = None
    for name, (codes, low, high) in items.items():
        test = F.col("itemid").isin(list(codes)) & (value > low) & (value < high)
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    typed = chartevents.select("icustay_id", "charttime", kind.alias("series")).filter(F.col("series").isNotNull())
    # Ends and counts are reduced before the stay's start is joined on.
    per_stay = typed.groupBy("icustay_id").agg(
        F.min("charttime").alias("first_time"),
        F.max("charttime").alias("last_time"),
        *[F.count_if(F.col("series") == name).alias(f"{name}counts") for name in items],
    )
    joined = per_stay.join(first.select("icustay_id", "intime"), "icustay_id")
    starts = minutes_between("intime", "first_time") <= window
    lasts = minutes_between("first_time", "last_time") >= window
    s, d, m = [F.col(f"{n}counts") >= min_readings for n in ("sbp", "dbp", "mbp")]
    return joined.filter(starts & lasts & (m | (s & d))).select("icustay_id", *[f"{n}counts" for n in items])


def first_stay_cohort(
    stays: DataFrame,
    cohort: DataFrame,
    person: tuple[str, ...] = ("uniquepid", "patienthealthsystemstayid"),
    visit: str = "unitvisitnumber",
    key: str = "patientunitstayid",
) -> DataFrame:
    """First stay of each person and admission, if it is in the cohort."""
    return restrict(first_stay(stays, list(person), visit, [key]), cohort, key)
