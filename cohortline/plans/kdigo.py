"""Kidney injury stages 0-3 from trailing creatinine minima and trailing urine rates (timestamp layout)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.functions import vocab
from cohortline.functions.exprs import epoch_micros, flag, ladder
from cohortline.operators.joins import align_series, asof_interval, band_join, enrich, lookup_join
from cohortline.operators.select import worst_by
from cohortline.operators.timeseries import Trailing, trailing_agg

KEY = "icustay_id"
HOUR = 3_600_000_000
DAY = 24 * HOUR


def stay_creatinine(stays: DataFrame, labevents: DataFrame) -> DataFrame:
    """Creatinine from 7 days before to 3 days after admission, by person, with times as microseconds."""
    admitted = stays.select(KEY, "subject_id", epoch_micros("intime").alias("in_us"))
    results = labevents.filter((F.col("itemid") == vocab.CREATININE_ITEM) & F.col("valuenum").isNotNull()).select(
        "subject_id", epoch_micros("charttime").alias("t_us"), F.col("valuenum").alias("creat")
    )
    return band_join(admitted, results, "subject_id", "in_us", "t_us", -7 * DAY, 3 * DAY).select(KEY, "t_us", "creat")


def creatinine_stages(creatinine: DataFrame, week_from_72h: bool = False) -> DataFrame:
    """Stage per distinct (stay, time, value) against the lowest value strictly before it.

    ``week_from_72h`` uses the 72 hour minimum where the rule speaks of 7 days.
    """
    windows = [Trailing(f"low_{n}", "min", w * HOUR) for n, w in (("24h", 24), ("48h", 48), ("72h", 72), ("7d", 168))]
    lows = trailing_agg(creatinine.select(KEY, "t_us", "creat").distinct(), KEY, "t_us", "creat", windows)
    cr, two_days = F.col("creat"), F.col("low_48h")
    week = F.col("low_72h" if week_from_72h else "low_7d")
    stage = ladder(
        [
            (cr >= week * 3.0, 3),
            ((cr >= 4) & ((two_days <= 3.7) | (cr >= 1.5 * week)), 3),
            (cr >= week * 2.0, 2),
            (cr >= two_days + 0.3, 1),
            (cr >= week * 1.5, 1),
        ],
        0,
    )
    return lows.withColumn("aki_stage_creat", stage)


def urine_rates(urine: DataFrame, weights: DataFrame) -> DataFrame:
    """Trailing 6/12/24 hour urine per kg and hour. ``urine``: stay, ``t_us``, ``value``; ``weights``:
    stay, ``start_us``, ``end_us``, ``weight``.

    A row stands for the hour before it, so the windows reach 5, 11 and 23 hours back and one hour is
    added to the hours covered. Rows of one time are added up first.
    """
    hours = (("6hr", 5), ("12hr", 11), ("24hr", 23))
    summed = urine.groupBy(KEY, "t_us").agg(F.sum("value").alias("value"))
    windows = [Trailing(f"uo_{n}", "sum", h * HOUR, True) for n, h in hours]
    windows += [Trailing(f"from_{n}", "min_time", h * HOUR, True) for n, h in hours]
    trailing = trailing_agg(summed, KEY, "t_us", "value", windows)
    covered = trailing.withColumns(
        {f"uo_tm_{n}": F.round((F.col("t_us") - F.col(f"from_{n}")) / HOUR, 4) for n, _ in hours}
    )
    weighed = asof_interval(covered, weights, KEY, "t_us", "start_us", "end_us")
    kg = F.nullif(F.col("weight"), F.lit(0.0))
    return weighed.withColumns(
        {f"uo_rt_{n}": F.round(F.col(f"uo_{n}") / kg / (F.col(f"uo_tm_{n}") + 1), 4) for n, _ in hours}
    ).select(KEY, "t_us", "weight", *[f"{p}_{n}" for p in ("uo", "uo_tm", "uo_rt") for n, _ in hours])


def urine_stages(rates: DataFrame, stays: DataFrame) -> DataFrame:
    admitted = stays.select(KEY, epoch_micros("intime").alias("in_us"))
    c = F.col
    stage = ladder(
        [
            (c("uo_rt_6hr").isNull(), F.lit(None).cast("int")),
            (c("t_us") <= c("in_us") + 6 * HOUR, 0),
            ((c("uo_tm_24hr") >= 11) & (c("uo_rt_24hr") < 0.3), 3),
            ((c("uo_tm_12hr") >= 5) & (c("uo_rt_12hr") == 0), 3),
            ((c("uo_tm_12hr") >= 5) & (c("uo_rt_12hr") < 0.5), 2),
            ((c("uo_tm_6hr") >= 2) & (c("uo_rt_6hr") < 0.5), 1),
        ],
        0,
    )
    return lookup_join(rates, admitted, [KEY]).withColumn("aki_stage_uo", stage).drop("in_us")


def combined_stages(creatinine: DataFrame, urine: DataFrame) -> DataFrame:
    """All documented times of a stay with both stages and the larger of them."""
    cr = creatinine.groupBy(KEY, "t_us").agg(
        F.max("creat").alias("creat"), F.max("aki_stage_creat").alias("aki_stage_creat")
    )
    uo = urine.select(KEY, "t_us", "uo_rt_6hr", "uo_rt_12hr", "uo_rt_24hr", "aki_stage_uo")
    uo = uo.groupBy(KEY, "t_us").agg(*[F.max(c).alias(c) for c in uo.columns if c not in (KEY, "t_us")])
    return align_series([cr, uo], [KEY, "t_us"]).withColumn("aki_stage", F.greatest("aki_stage_creat", "aki_stage_uo"))


def worst_stage(creatinine: DataFrame, urine: DataFrame, stays: DataFrame) -> DataFrame:
    """Worst creatinine and urine stage in ``(admission - 6 h, admission + 48 h]`` per stay and the flag."""
    admitted = stays.select(KEY, epoch_micros("intime").alias("in_us"))
    near = (F.col("t_us") > F.col("in_us") - 6 * HOUR) & (F.col("t_us") <= F.col("in_us") + 48 * HOUR)
    cr = lookup_join(creatinine.filter(F.col("aki_stage_creat").isNotNull()), admitted, [KEY]).filter(near)
    uo = lookup_join(urine.filter(F.col("aki_stage_uo").isNotNull()), admitted, [KEY]).filter(near)
    rates = ["uo_rt_24hr", "uo_rt_12hr", "uo_rt_6hr"]
    worst_cr = worst_by(cr, [KEY], ["aki_stage_creat", "creat"], ["t_us"]).select(
        KEY, F.col("t_us").alias("t_us_creat"), "creat", "aki_stage_creat"
    )
    worst_uo = worst_by(uo, [KEY], ["aki_stage_uo", *rates], ["t_us"]).select(
        KEY, F.col("t_us").alias("t_us_uo"), *rates, "aki_stage_uo"
    )
    stage = F.greatest("aki_stage_creat", "aki_stage_uo")
    return enrich(stays.select(KEY), [(worst_cr, KEY), (worst_uo, KEY)]).withColumns(
        {"aki_stage_48hr": stage, "aki_48hr": flag(stage > 0)}
    )
