"""Drugs, ventilation evidence, urine cells and vasopressor time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions import vocab
from cohortline.functions.exprs import any_of, categorize, flag, hours_between, in_list, like_any, nullif_zero
from cohortline.operators.intervals import clean_intervals, clipped_duration, covered_time, merge_intervals
from cohortline.operators.joins import lookup_join

KEY = "patientunitstayid"
DAY = 1440


# --------------------------------------------------------------------------- ventilation


def ventilated_stays(
    respcare: DataFrame, respcharting: DataFrame, treatment: DataFrame, loose_window: bool = False
) -> DataFrame:
    """Stays with any of three kinds of evidence near admission: airway, charted word, treatment.

    ``loose_window`` applies the time window of charted words to the last pattern only.
    """
    words = [F.col("respchartvalue").like(p) for p in vocab.VENTILATOR_PATTERNS]
    in_time = F.col("respchartoffset").between(-DAY, DAY)
    charted = any_of([*words[:-1], words[-1] & in_time]) if loose_window else any_of(words) & in_time
    hits = [
        respcare.filter(
            in_list("airwaytype", vocab.INVASIVE_AIRWAYS) & F.col("respcarestatusoffset").between(-DAY, DAY)
        ),
        respcharting.filter(charted),
        treatment.filter(
            in_list("treatmentstring", vocab.VENTILATION_TREATMENTS) & F.col("treatmentoffset").between(-DAY, DAY)
        ),
    ]
    stacked = hits[0].select(KEY).unionByName(hits[1].select(KEY)).unionByName(hits[2].select(KEY))
    return stacked.distinct().withColumn("mechvent", F.lit(1))


def ventilation_evidence(respcare: DataFrame, respcharting: DataFrame, treatment: DataFrame) -> DataFrame:
    """Each piece of evidence with its time: one row per (stay, source, time), not their combinations."""
    airway = respcare.filter(
        in_list("airwaytype", vocab.INVASIVE_AIRWAYS) & F.col("respcarestatusoffset").between(-DAY, DAY)
    ).select(KEY, "respcarestatusoffset")
    charted = respcharting.filter(
        like_any("respchartvalue", vocab.VENTILATOR_PATTERNS, ci=True) & F.col("respchartoffset").between(0, DAY)
    ).select(KEY, "respchartoffset")
    treated = treatment.filter(
        in_list("treatmentstring", vocab.VENTILATION_TREATMENTS) & F.col("treatmentoffset").between(0, DAY)
    ).select(KEY, "treatmentoffset")
    rows = airway.unionByName(charted, allowMissingColumns=True).unionByName(treated, allowMissingColumns=True)
    return rows.distinct().withColumn("mechvent", F.lit(1))


# --------------------------------------------------------------------------- urine cells


def is_urine_cell(path: str = "cellpath") -> Column:
    cell, prefix = F.col(path), vocab.URINE_PREFIX
    listed = in_list(cell, [prefix + c for c in vocab.URINE_CELLS])
    catheter = cell.ilike(prefix + vocab.URINE_CATHETER_PREFIX)
    for p in vocab.URINE_CATHETER_NOT:
        catheter = catheter & ~F.lower(cell).like(p)
    return cell.like(prefix + "%") & (listed | catheter | like_any(cell, [prefix + p for p in vocab.URINE_PATTERNS]))


def urine_output(intakeoutput: DataFrame) -> DataFrame:
    """Urine per stay and time from recognised cells."""
    rows = intakeoutput.filter(is_urine_cell() & F.col("cellvaluenumeric").isNotNull())
    return rows.groupBy(KEY, F.col("intakeoutputoffset").alias("chartoffset")).agg(
        F.max("outputtotal").alias("outputtotal"), F.sum("cellvaluenumeric").alias("urineoutput")
    )


# --------------------------------------------------------------------------- drugs


def ordered_drug(code: str = "drughiclseqno", name: str = "drugname") -> Column:
    """Drug of an order: by code, or by name where the code is missing."""
    by_code = [(in_list(code, codes), drug) for drug, codes in vocab.ORDER_CODES.items()]
    missing, text = F.col(code).isNull(), F.lower(name)
    by_name = [(missing & text.like(p), drug) for p, drug in vocab.ORDER_NAMES]
    return categorize(by_code + by_name)


def medication_flags(medication: DataFrame) -> DataFrame:
    """One row per order window of a stay with a 0/1 column per drug.

    Only orders with a dosage, not cancelled, with a start; times of 0 mean missing.
    """
    orders = medication.filter(F.col("dosage").isNotNull() & (F.col("drugordercancelled") == "No")).select(
        KEY,
        nullif_zero("drugorderoffset").alias("drugorderoffset"),
        nullif_zero("drugstartoffset").alias("chartoffset"),
        nullif_zero("drugstopoffset").alias("drugstopoffset"),
        ordered_drug().alias("drug"),
    )
    return (
        orders.filter(F.col("chartoffset").isNotNull())
        .groupBy(KEY, "drugorderoffset", "chartoffset", "drugstopoffset")
        .agg(*[F.max(flag(F.col("drug") == d)).cast("short").alias(d) for d in vocab.ORDER_DRUGS])
    )


def infusion_tests(name: str = "drugname") -> dict[str, Column]:
    tests = {d: in_list(name, names) for d, names in vocab.INFUSION_NAMES.items()}
    tests["dobutamine"] = F.lower(name).like(vocab.DOBUTAMINE_PATTERN)
    return {d: tests[d] for d in vocab.INFUSION_DRUGS}


def infusion_flags(infusiondrug: DataFrame, per_stay: bool = False) -> DataFrame:
    """0/1 column per drug, per stay and time (or per stay), for rows with at least one of the drugs."""
    tests = infusion_tests()
    known = infusiondrug.filter(any_of(list(tests.values())))
    keys = [F.col(KEY)] if per_stay else [F.col(KEY), F.col("infusionoffset").alias("chartoffset")]
    return known.groupBy(*keys).agg(*[F.max(flag(t)).cast("short").alias(d) for d, t in tests.items()])


def vasopressor_stays(treatment: DataFrame) -> DataFrame:
    """Stays with any vasopressor treatment entry."""
    rows = treatment.filter(in_list("treatmentstring", vocab.VASOPRESSOR_TREATMENTS))
    return rows.select(KEY).distinct().withColumn("vasopressor", F.lit(1).cast("short"))


def vasopressor_orders(flags: DataFrame, drugs: Sequence[str] = vocab.VASOPRESSORS) -> DataFrame:
    """Order windows with at least one vasopressor."""
    given = F.greatest(*[F.col(d) for d in drugs]) > 0
    return flags.filter(given).select(KEY, "chartoffset", "drugstopoffset")


def vasopressor_hours(
    orders: DataFrame,
    key: str = KEY,
    start: str = "chartoffset",
    end: str = "drugstopoffset",
    horizons: Mapping[str, float] | None = None,
    mode: str = "union",
    pieces: int | None = None,
) -> DataFrame:
    """Hours under vasopressors up to each horizon, overlaps counted once (offset layout, minutes)."""
    horizons = horizons or {f"{h}hrs": h * 60 for h in vocab.HORIZONS_HOURS}
    merged = merge_intervals(clean_intervals(orders, start, end), [key], start, end, mode, pieces)
    covered = covered_time(merged, [key], horizons)
    return covered.select(key, *[F.bround(F.col(h) / 60.0, 2).alias(f"{h}_hr") for h in horizons])


def vasopressor_hours_timed(stays: DataFrame, durations: DataFrame, horizons: Sequence[int] = vocab.HORIZONS_HOURS) -> DataFrame:
    """Hours and number of vasopressor periods in the first hours of a stay (timestamp layout)."""
    timed = lookup_join(durations, stays.select("icustay_id", "intime"), ["icustay_id"])
    out = clipped_duration(
        timed,
        ["icustay_id"],
        hours_between("intime", "starttime"),
        hours_between("intime", "endtime"),
        {f"first_{h}": float(h) for h in horizons},
    )
    names = {f"first_{h}_length": f"first_{h}_vasso_hours" for h in horizons}
    return out.withColumnsRenamed({**names, **{f"first_{h}_count": f"first_{h}_vasso_counts" for h in horizons}})
