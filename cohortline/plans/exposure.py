"""Reading tables, pressure medians and time in range."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.functions import vocab
from cohortline.functions.exprs import complement, in_list, mask_range, not_error
from cohortline.operators.joins import restrict
from cohortline.operators.timeseries import Band, median_in_window, pivot_readings, range_share, with_offset, within_span


def cohort_readings(
    readings: DataFrame, first_stays: DataFrame, spans: DataFrame, key: str = "patientunitstayid", time: str = "chartoffset"
) -> DataFrame:
    """Readings of first stays that are in the pressure cohort, inside each stay's own validity span."""
    chosen = restrict(spans, first_stays, key)
    return within_span(readings, chosen, key, time, "min_offset", "max_offset")


def charted_vitals(chartevents: DataFrame) -> DataFrame:
    """Plausible charted vitals, one row per stay and time, averaged over charts of one series."""
    item, value = F.col("itemid"), F.col("valuenum")
    series = {
        name: F.when(in_list(item, items), mask_range(value, low, high))
        for name, (items, low, high) in vocab.VITAL_ITEMS.items()
    }
    fahrenheit = mask_range(value, *vocab.TEMP_F_RANGE)
    series["tempc"] = F.when(in_list(item, vocab.TEMP_F_ITEMS), (fahrenheit - 32) / 1.8).when(
        in_list(item, vocab.TEMP_C_ITEMS), mask_range(value, *vocab.TEMP_C_RANGE)
    )
    series["spo2"] = F.when(in_list(item, vocab.SPO2_ITEMS), mask_range(value, *vocab.SPO2_RANGE, high_closed=True))
    items = [i for group, _, _ in vocab.VITAL_ITEMS.values() for i in group]
    items += [*vocab.TEMP_F_ITEMS, *vocab.TEMP_C_ITEMS, *vocab.SPO2_ITEMS]
    kept = chartevents.filter(not_error("error") & in_list(item, items))
    return pivot_readings(kept, ["icustay_id", "charttime"], series)


def charted_readings(chartevents: DataFrame, stays: DataFrame) -> DataFrame:
    """Charted vitals of first stays with minutes from admission."""
    first = stays.filter((F.col("first_hosp_stay") == "Y") & (F.col("first_icu_stay") == "Y"))
    return with_offset(charted_vitals(chartevents), first, "icustay_id", "charttime", "intime")


def pressure_medians(
    readings: DataFrame,
    key: str = "patientunitstayid",
    time: str = "chartoffset",
    values: Sequence[str] = ("ibp_systolic", "ibp_diastolic", "ibp_mean"),
    horizons: Mapping[str, float] | None = None,
    pieces: int | None = None,
) -> DataFrame:
    """Exact medians per stay for each pressure and horizon, strictly inside ``(0, T)``."""
    horizons = horizons or {f"{h}h": h * 60 for h in vocab.HORIZONS_HOURS}
    return median_in_window(readings, [key], time, values, horizons, pieces=pieces)


def time_in_range(
    readings: DataFrame,
    key: str = "patientunitstayid",
    time: str = "chartoffset",
    bands: Mapping[str, tuple[str, float, float]] = vocab.PRESSURE_BANDS,
    horizons: Mapping[str, float] | None = None,
) -> DataFrame:
    """Share of readings below, above and in each band, per stay, for all horizons in one grouping.

    ``propBelow_<band>_<horizon>``, ``propAbove_…``, ``prop_…`` (in range) and ``prop_…_AKI``
    (not below, the one-sided range).
    """
    horizons = horizons or {str(h): h * 60 for h in vocab.HORIZONS_HOURS}
    specs = [
        Band(f"{band}_{label}", column, low, high, 0, end)
        for label, end in horizons.items()
        for band, (column, low, high) in bands.items()
    ]
    shares = range_share(readings, [key], time, specs)
    out = [F.col(key)]
    for b in specs:
        out += [
            F.col(f"{b.name}_below").alias(f"propBelow_{b.name}"),
            F.col(f"{b.name}_above").alias(f"propAbove_{b.name}"),
            F.col(f"{b.name}_in").alias(f"prop_{b.name}"),
            complement(f"{b.name}_below").alias(f"prop_{b.name}_AKI"),
        ]
    return shares.select(*out)
