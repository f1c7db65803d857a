"""Pipelines on hand-made frames with the columns of the clinical tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortline.functions import vocab
from cohortline.plans import aki, cleaning, cohort, exposure, fluids, history, kdigo, meds, severity, tables

K = "patientunitstayid"


def test_creatinine_aki_borders(spark, rows):
    lab = spark.createDataFrame(
        [
            (1, "creatinine", -10, 1.0), (1, "creatinine", 4000, 1.5),  # ratio exactly 1.5
            (2, "creatinine", 0, 2.0), (2, "creatinine", 2880, 2.25), (2, "creatinine", 2881, 9.0),  # 4.5 times after 48 h
            (3, "creatinine", 5, 0.0), (3, "creatinine", 50, 0.25),  # baseline zero
            (4, "creatinine", 800, 1.0),  # no baseline
            (5, "creatinine", 10, 1.0), (5, "creatinine", 20, 5.0),  # chronic
            (6, "creatinine", -20, 1.0),  # no peak
            (7, "creatinine", 0, 1.0), (7, "creatinine", 100, 1.375),
        ],
        f"{K} long, labname string, labresultoffset long, labresult double",
    )
    treatment = spark.createDataFrame([(5, "renal|CRRT for Chronic failure"), (7, "dialysis")], f"{K} long, treatmentstring string")
    got = rows(aki.creatinine_aki(lab, treatment), K, "c_7d", "c_48h", "aki")
    assert got == [(1, 0, 0, 0), (2, 1, 0, 1), (3, 0, 0, 0), (7, 0, 1, 1)]
    out = aki.either_aki(
        spark.createDataFrame([(1,), (2,), (9,)], f"{K} long"),
        aki.creatinine_aki(lab, treatment),
        aki.urine_aki_7d(
            spark.createDataFrame([(1, 359, 1), (1, 360, 0), (9, 400, 1)], f"{K} long, chartoffset long, AKI int"),
            spark.createDataFrame([(1,), (9,)], f"{K} long"),
        ),
    )
    assert rows(out) == [(1, 0, 0, 0), (2, 1, 0, 1), (9, 0, 1, 1)]


def test_peak_to_discharge(spark, rows):
    lab = spark.createDataFrame([(1, "creatinine", 60, 2.0), (1, "creatinine", 90, 2.0)], f"{K} long, labname string, labresultoffset long, labresult double")
    patient = spark.createDataFrame([(1, 500), (2, 700)], f"{K} long, unitdischargeoffset long")
    assert rows(aki.peak_to_discharge(lab, patient)) == [(1, 2.0, 60, 440), (2, None, None, None)]


def test_pressure_cohort_needs_twelve(spark, rows):
    data = []
    for stay, n in ((1, 12), (2, 11)):
        data += [(stay, 10 * i, 120.0, 60.0, None) for i in range(n)] + [(stay, 2000, None, None, 80.0)]
    data += [(3, 10 * i, None, 60.0, None) for i in range(20)] + [(3, 3000, None, 60.0, None)]  # diastolic only
    data += [(4, 1441 + i, 1.0, 1.0, 1.0) for i in range(3000)]  # starts too late
    df = spark.createDataFrame(data, f"{K} long, chartoffset long, ibp_systolic double, ibp_diastolic double, ibp_mean double")
    assert rows(cohort.pressure_cohort(df)) == [(1, 0, 2000)]
    assert rows(cohort.pressure_cohort(df, span_only=True), K) == [(1,), (2,), (3,)]


def test_cardio_ladder_borders(spark):
    cases = [
        ((None, None, None, None), 0), ((15.0, None, None, 90.0), 4), ((None, 0.11, None, 90.0), 4), ((5.1, None, None, None), 3),
        ((None, 0.1, None, None), 3), ((5.0, None, None, None), 2), ((None, None, 1, 60.0), 2), ((None, None, None, 69.9), 1),
        ((None, None, None, 70.0), 0), ((1.0, 0.05, None, 60.0), 3),
    ]
    df = spark.createDataFrame([c[0] for c in cases], "dopa double, norepi double, dobu int, map double")
    assert [r[0] for r in df.select(severity.cardio_ladder()).collect()] == [c[1] for c in cases]


def test_respiratory_ladder_borders(spark):
    cases = [(0.99, 9, 4), (1.0, 9, 3), (2.0, 9, 3), (2.5, 9, 2), (3.0, 9, 2), (4.0, 9, 1), (4.1, 9, 0), (9, 0.66, 4), (9, 0.67, 3),
             (9, 1.415, 0), (9, 1.42, 2), (9, 2.205, 0), (9, 2.21, 1), (9, 3.01, 1), (9, 3.02, 0), (3.5, 1.0, 3)]
    df = spark.createDataFrame([(float(a), float(b)) for a, b, _ in cases], "pf double, sf double")
    got = [r[0] for r in df.select(severity.respiratory_ladder(F.col("pf"), F.col("sf"))).collect()]
    assert got == [c[2] for c in cases]


def test_oxygen_default_and_zero(spark):
    df = spark.createDataFrame([(None, None), (21.0, 40.0), (None, 40.0), (None, 1.0), (None, 0.0)], "rcfio2 double, ncfio2 double")
    assert [r[0] for r in df.select(severity.oxygen_percent()).collect()] == [None, 21.0, 40.0, 100.0, None]


def test_other_ladders(spark):
    plt = spark.createDataFrame([(19.0,), (20.0,), (50.0,), (100.0,), (150.0,), (None,)], "plt double")
    assert [r[0] for r in plt.select(severity.coagulation_ladder()).collect()] == [4, 3, 2, 1, 0, 0]
    bili = spark.createDataFrame([(12.1,), (12.0,), (6.0,), (2.0,), (1.2,)], "bili double")
    assert [r[0] for r in bili.select(severity.liver_ladder()).collect()] == [4, 3, 2, 1, 0]
    gcs = spark.createDataFrame([(15.0,), (13.0,), (10.0,), (6.0,), (3.0,), (2.0,), (None,)], "gcs double")
    assert [r[0] for r in gcs.select(severity.coma_ladder()).collect()] == [0, 1, 2, 3, 4, 0, 0]
    renal = spark.createDataFrame([(199.0, 1.0), (200.0, None), (None, 5.1), (None, 3.5), (None, 2.0), (600.0, 1.2), (None, None)], "uo double, creat double")
    assert [r[0] for r in renal.select(severity.renal_ladder()).collect()] == [4, 3, 4, 2, 2, 1, 0]


def test_day_urine_counts_repeated_rows_once(spark, rows):
    io = spark.createDataFrame([(1, 0, 5.0), (1, 0, 5.0), (1, 1440, 7.0), (1, -60, 9.0), (1, 1441, 9.0)], f"{K} long, intakeoutputoffset long, outputtotal double")
    assert rows(severity.day_urine(io)) == [(1, 12.0)]


def test_infusion_rates(spark, rows):
    df = spark.createDataFrame(
        [(1, 0, "Dopamine (ml/hr)", "30"), (1, 0, "dopamine (mcg/kg/min)", "4"), (1, 0, "Norepinephrine (mcg/min)", "6.6"),
         (1, 0, "Dobutamine (ml/hr)", "0"), (2, 0, "DOBUTAMINE", "2"), (2, 0, "Dopamine (ml/hr)", "OFF"), (3, 1441, "Dopamine (ml/hr)", "9")],
        f"{K} long, infusionoffset long, drugname string, drugrate string",
    )
    assert rows(severity.infusion_maxima(df)) == [(1, 10.0, 0.083, None), (2, None, None, 1)]


def test_medication_flags(spark):
    df = spark.createDataFrame(
        [(1, 5, 10, 0, 2051, "x", "d", "No"), (1, 5, 10, 0, None, "Neosynephrine", "d", "No"), (1, 5, 0, 9, 2051, "x", "d", "No"),
         (1, 5, 11, 9, 2051, "x", None, "No"), (1, 5, 12, 9, 2051, "x", "d", "Yes"), (1, 0, 13, 9, 8, "heparin", "d", "No")],
        f"{K} long, drugorderoffset long, drugstartoffset long, drugstopoffset long, drughiclseqno int, drugname string, dosage string, drugordercancelled string",
    )
    out = {r["chartoffset"]: r for r in meds.medication_flags(df).collect()}
    assert set(out) == {10, 13}
    assert (out[10]["norepinephrine"], out[10]["phenylephrine"], out[10]["drugstopoffset"]) == (1, 1, None)
    assert out[13]["drugorderoffset"] is None and out[13]["heparin"] == 0  # the code is there, so the name does not count
    assert meds.vasopressor_orders(meds.medication_flags(df)).count() == 1


def test_urine_cells(spark):
    p = vocab.URINE_PREFIX
    cases = {p + "Urine": 1, p + "URINE": 1, p + "Foley": 1, p + "foley OR": 0, p + "Foley PACU": 0, p + "Stool": 0, "x|Urine": 0,
             p + "Output 2 Urethral Catheter": 1, p + "Urine Output (mL) x": 1, p + "Straight Cath'd": 1}
    df = spark.createDataFrame([(c,) for c in cases], "cellpath string")
    got = {r[0]: r[1] for r in df.select("cellpath", F.when(meds.is_urine_cell(), 1).otherwise(0)).collect()}
    assert got == cases


def test_infusion_vocabulary(spark):
    for drug, names in vocab.INFUSION_NAMES.items():
        df = spark.createDataFrame([(1, 0, n) for n in names], f"{K} long, infusionoffset long, drugname string")
        row = meds.infusion_flags(df).first()
        assert row[drug] == 1 and sum(row[d] for d in vocab.INFUSION_DRUGS) == 1


def test_comorbidity_ignores_padding(spark, rows):
    df = spark.createDataFrame([(1, "490  "), (1, "42731"), (2, "1730"), (3, "1749"), (3, "43301"), (4, "5854")], "hadm_id long, icd9_code string")
    got = {r["hadm_id"]: r.asDict() for r in history.comorbidity_flags(df).collect()}
    assert got[1]["copd"] == 1 and got[1]["afib"] == 1 and got[2]["cancer"] == 0
    assert got[3]["cancer"] == 1 and got[3]["cereb"] == 1 and got[4]["ckd"] == 1


H = dt.timedelta(hours=1)
T0 = dt.datetime(2100, 1, 1)
EPOCH = dt.datetime(1970, 1, 1)


def us(t):
    return int((t - EPOCH) / dt.timedelta(microseconds=1))


def test_creatinine_stages(spark, rows):
    data = [(1, T0, 1.0), (1, T0 + 10 * H, 1.3), (1, T0 + 20 * H, 2.0), (1, T0 + 30 * H, 3.0), (1, T0 + 100 * H, 1.5), (2, T0, 3.7), (2, T0 + 5 * H, 4.0)]
    df = spark.createDataFrame([(k, us(t), v) for k, t, v in data], "icustay_id long, t_us long, creat double")
    got = rows(kdigo.creatinine_stages(df), "icustay_id", "creat", "aki_stage_creat")
    assert got == [(1, 1.0, 0), (1, 1.3, 1), (1, 1.5, 1), (1, 2.0, 2), (1, 3.0, 3), (2, 3.7, 0), (2, 4.0, 3)]


def test_band_of_creatinine_and_worst_stage(spark, rows):
    stays = spark.createDataFrame([(1, 7, T0), (2, 8, T0)], "icustay_id long, subject_id long, intime timestamp_ntz")
    labs = spark.createDataFrame(
        [(7, 50912, T0 - 168 * H, 1.0), (7, 50912, T0 - 169 * H, 9.0), (7, 50912, T0 + 72 * H, 2.0), (7, 50912, T0 + 73 * H, 9.0),
         (7, 1, T0, 9.0), (7, 50912, T0 + 48 * H, 1.5)],
        "subject_id long, itemid int, charttime timestamp_ntz, valuenum double",
    )
    cr = kdigo.stay_creatinine(stays, labs)
    assert rows(cr, "icustay_id", "creat") == [(1, 1.0), (1, 1.5), (1, 2.0)]
    urine = spark.createDataFrame([(1, us(T0 + i * H), 1.0) for i in range(30)], "icustay_id long, t_us long, value double")
    weights = spark.createDataFrame([(1, us(T0), us(T0 + 100 * H), 50.0)], "icustay_id long, start_us long, end_us long, weight double")
    rates = kdigo.urine_rates(urine, weights)
    last = rates.orderBy(F.col("t_us").desc()).first()
    assert (last["uo_6hr"], last["uo_tm_6hr"], last["uo_rt_6hr"], last["uo_24hr"]) == (6.0, 5.0, 0.02, 24.0)
    stages = kdigo.urine_stages(rates, stays)
    by_hour = {(r["t_us"] - us(T0)) // 3_600_000_000: r["aki_stage_uo"] for r in stages.collect()}
    assert (by_hour[6], by_hour[7], by_hour[11]) == (0, 2, 3)
    worst = {r["icustay_id"]: r for r in kdigo.worst_stage(kdigo.creatinine_stages(cr), stages, stays).collect()}
    assert (worst[1]["aki_stage_creat"], worst[1]["aki_stage_uo"], worst[1]["aki_48hr"]) == (0, 3, 1)
    assert (worst[2]["aki_stage_48hr"], worst[2]["aki_48hr"]) == (None, 0)
    both = kdigo.combined_stages(kdigo.creatinine_stages(cr), stages)
    assert both.count() == 33 and both.filter("aki_stage is null").count() == 0


def test_vasopressor_hours(spark, rows):
    orders = spark.createDataFrame([(1, -60, 60), (1, 30, 90), (1, 1400, 1500), (1, 900, 800), (2, 5000, 6000)], f"{K} long, chartoffset long, drugstopoffset long")
    assert rows(meds.vasopressor_hours(orders)) == [(1, 2.17, 3.17, 3.17), (2, 0.0, 0.0, 0.0)]


def test_heights(spark, rows):
    people = spark.createDataFrame([(1, T0 - 20000 * H), (2, T0 - 100 * H)], "subject_id long, dob timestamp_ntz")
    charts = spark.createDataFrame(
        [(1, 10, T0, 920, 70.0, None), (1, 10, T0 + H, 3485, 500.0, 0), (1, 10, T0 + H, 3485, 150.0, 1), (2, 20, T0, 3485, 60.0, 0), (2, 20, T0, 3485, 150.0, 0)],
        "subject_id long, icustay_id long, charttime timestamp_ntz, itemid int, valuenum double, error int",
    )
    got = rows(fluids.charted_heights(charts, people), "icustay_id", "height")
    assert [(k, None if v is None else round(v, 4)) for k, v in got] == [(10, 177.8), (10, None), (20, 60.0), (20, None)]


def test_archive_age_guard(spark, rows):
    demo = spark.createDataFrame([(1, "17", "Sepsis"), (2, "18", "Sepsis"), (3, "> 89", "Sepsis"), (4, None, "CHF"), (5, "88", "CHF"), (5, "88", "Zzz")], f"{K} long, age string, apachedxgroup string")
    out = tables.archive_table(demo, [demo])
    assert rows(out, K, "apachedxgroup", "sepsis_binary") == [(2, "Sepsis", 1), (5, "CHF", 0)]


def test_exclusions_and_outcome(spark, rows):
    df = spark.createDataFrame([(1, True, None, 8.0), (2, False, None, 7.0), (3, None, True, 9.0), (4, None, None, None)], "k int, a boolean, b boolean, los double")
    assert rows(cleaning.apply_exclusions(df, ["a", "b"]), "k") == [(2,), (4,)]
    assert rows(cleaning.apply_exclusions(df, ["a", "b"], excluded=True), "k") == [(1,), (3,)]
    outcome = cleaning.week_outcome("los", F.lit("EXPIRED"), "ALIVE")
    assert rows(df.select("k", outcome)) == [(1, "ALIVE"), (2, "EXPIRED"), (3, "ALIVE"), (4, None)]


def test_time_in_range_parts_add_up(spark):
    df = spark.createDataFrame([(1, i, float(60 + i % 40), 100.0 + i, 50.0) for i in range(0, 4000, 7)], f"{K} long, chartoffset long, ibp_mean double, ibp_systolic double, ibp_diastolic double")
    row = exposure.time_in_range(df).first()
    for band in ("map", "asp", "adp"):
        for h in (24, 48, 72):
            parts = [row[f"{p}_{band}_{h}"] for p in ("propBelow", "propAbove", "prop")]
            assert sum(parts) == pytest.approx(1.0) and row[f"prop_{band}_{h}_AKI"] == pytest.approx(1 - parts[0])


def test_charted_vitals(spark):
    charts = spark.createDataFrame(
        [(1, T0, 51, 120.0, None), (1, T0, 6701, 130.0, 0), (1, T0, 51, 500.0, 0), (1, T0, 678, 98.6, 0), (1, T0, 646, 100.0, 0), (1, T0, 52, 80.0, 1)],
        "icustay_id long, charttime timestamp_ntz, itemid int, valuenum double, error int",
    )
    row = exposure.charted_vitals(charts).first()
    assert row["sysbp"] == 125.0 and row["meanbp"] is None and row["spo2"] == 100.0 and row["tempc"] == pytest.approx(37.0)
