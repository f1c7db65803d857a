"""Comorbidity flags and admission diagnosis groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions import vocab
from cohortline.functions.exprs import flag, in_list, starts_with_any
from cohortline.operators.joins import lookup_join

KEY = "patientunitstayid"


def flag_pivot(df: DataFrame, keys: Sequence[str], tests: Mapping[str, Column]) -> DataFrame:
    """One 0/1 column per test and one row per key: 1 if any row of the key passes."""
    return df.groupBy(*keys).agg(*[F.max(flag(t)).alias(name) for name, t in tests.items()])


def history_flags(diagnosis: DataFrame) -> DataFrame:
    """Ten flags by code fragment, per stay (a cell may list several codes)."""
    tests = {n: F.col("icd9code").contains(f) for n, f in vocab.HISTORY_FRAGMENTS.items()}
    return flag_pivot(diagnosis, [KEY], tests)


def comorbidity_flags(diagnoses: DataFrame, key: str = "hadm_id", code: str = "icd9_code") -> DataFrame:
    """Seven flags by code prefix, list or three-digit group, per admission; padding blanks are ignored."""
    c = F.rtrim(F.col(code))
    tests = {n: starts_with_any(c, p) for n, p in vocab.COMORBID_PREFIXES.items()}
    tests.update({n: in_list(c, codes) for n, codes in vocab.COMORBID_CODES.items()})
    tests["cancer"] = in_list(F.substring(c, 1, 3), vocab.CANCER_GROUPS)
    return flag_pivot(diagnoses, [key], tests)


def sepsis_flag(patient: DataFrame) -> DataFrame:
    return patient.select(KEY, flag(F.lower("apacheadmissiondx").contains("sepsis")).alias("sepsis_binary")).distinct()


def diagnosis_group(
    df: DataFrame,
    text: str,
    mapping: DataFrame | None = None,
    default: str = vocab.OTHER_DIAGNOSIS,
    name: str = "apachedxgroup",
) -> DataFrame:
    """Category of an exact diagnosis text, by the fixed vocabulary or a ``(text, category, priority)`` frame.

    In a frame the lowest priority wins.
    """
    if mapping is None:
        pairs = [F.lit(x) for group, texts in vocab.DIAGNOSIS_GROUPS.items() for t in texts for x in (t, group)]
        known = F.try_element_at(F.create_map(*pairs), F.col(text))
        return df.withColumn(name, F.coalesce(known, F.lit(default)))
    best = mapping.groupBy(F.col("text").alias(text)).agg(F.min_by("category", "priority").alias("_category"))
    return lookup_join(df, best, [text], "left").withColumn(name, F.coalesce("_category", F.lit(default))).drop("_category")
