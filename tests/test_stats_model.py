import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortline.operators import model, stats


def test_iqr_fence_is_strict(spark, rows):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 8.0, None]  # q1 2.25, q3 4.75, fences -1.5 and 8.5
    df = spark.createDataFrame([(v,) for v in values] + [(8.5,)], "v double")
    q = np.quantile([v for v in values if v is not None] + [8.5], [0.25, 0.75])
    high = q[1] + 1.5 * (q[1] - q[0])
    got = {r["v"]: r["v_outlier"] for r in stats.iqr_fence(df, ["v"]).collect()}
    assert got == {v: bool(v is not None and v > high) for v in [*values, 8.5]}
    on_fence = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (3.0,), (4.0,)], "v double")
    edge = stats.iqr_fence(on_fence, ["v"], k=0.5)  # fences 0 and 4
    assert not any(r["v_outlier"] for r in edge.collect())
    assert rows(stats.fences(on_fence, ["v"], k=0.5)) == [("v", 0.0, 4.0)]


def test_iqr_fence_same_for_large_tables(spark, rows):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, rng.gauss(0, 1) ** 3) for i in range(500)], "i long, v double")
    assert rows(stats.iqr_fence(df, ["v"], pieces=10)) == rows(stats.iqr_fence(df, ["v"]))


def test_odds_ratio_borders_nulls_and_zero_cells(spark):
    data = [(0.05, 1), (0.15, 0), (0.15, 0), (0.35, 1), (0.45, 1), (0.40, 0), (None, 1), (0.2, 1), (0.1, None)]
    df = spark.createDataFrame(data, "x double, y int")
    r = stats.odds_ratio(df, "x", (0.05, 0.15), (0.35, 0.45), "y").first()
    assert (r["a"], r["b"], r["c"], r["d"]) == (1, 2, 2, 1)
    assert r["odds_ratio"] == pytest.approx(0.25)
    se = math.sqrt(1 + 0.5 + 0.5 + 1)
    assert r["ci_low"] == pytest.approx(math.exp(math.log(0.25) - 1.96 * se))
    chi2 = 6 * (1 * 1 - 2 * 2) ** 2 / (3 * 3 * 3 * 3)
    assert r["chi2"] == pytest.approx(chi2) and r["p_value"] == pytest.approx(math.erfc(math.sqrt(chi2 / 2)), abs=1e-6)
    none = stats.odds_ratio(df, "x", (5, 6), (0.35, 0.45), "y").first()
    assert none["odds_ratio"] is None and none["ci_low"] is None and none["risk_exposed"] is None


def test_odds_ratio_table_equals_single_calls(spark):
    rng = random.Random(4)
    data = [(rng.random(), rng.random(), rng.randint(0, 1), rng.randint(20, 90)) for _ in range(400)]
    df = spark.createDataFrame(data, "x double, z double, y int, age int")
    criteria = {"old": F.col("age") >= 65, "young": F.col("age") < 65, "all": F.lit(True)}
    metrics = {"x": ("x", (0.1, 0.3), (0.3, 0.5)), "z": ("z", (0.0, 0.5), (0.5, 1.0))}
    table = {(r["criterion"], r["metric"]): r for r in stats.odds_ratio_table(df, criteria, metrics, "y").collect()}
    assert len(table) == 6
    for (c, m), row in table.items():
        col, exposed, control = metrics[m]
        one = stats.odds_ratio(df.filter(criteria[c]), col, exposed, control, "y").first()
        assert all(row[k] == pytest.approx(one[k]) for k in one.asDict())


def test_table_one(spark):
    df = spark.createDataFrame([("F", 1.0, 5.0), ("M", 3.0, None), ("F", 5.0, 7.0), (None, 7.0, 9.0)], "g string, a double, b double")
    out = {(r["variable"], r["level"], r["stat"]): r["value"] for r in stats.table_one(df, ["a", "b"], ["g"], ["b"]).collect()}
    assert out[("n", "", "n")] == 4 and out[("a", "", "mean")] == 4.0 and out[("b", "", "median")] == 7.0
    assert out[("g", "F", "n")] == 2 and out[("g", "F", "percent")] == pytest.approx(200 / 3)


def test_null_report_and_value_counts(spark, rows):
    df = spark.createDataFrame([(None, "a"), (1, "a"), (2, None)], "x int, s string")
    assert rows(stats.null_report(df)) == [("s", 1, 1 / 3), ("x", 1, 1 / 3)]
    assert rows(stats.value_counts(df, "s")) == [("a", 2), (None, 1)]
    assert stats.distinct_count(df, "x").first()[0] == 2


def test_one_hot_levels(spark, rows):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "i int, s string")
    out = model.one_hot(df, ["s"])
    assert out.columns == ["i", "s_a", "s_b"] and rows(out) == [(1, 0, 1), (2, 0, 0), (3, 1, 0)]
    with pytest.raises(ValueError):
        model.one_hot(df, ["s"], max_levels=1)
    numbers = spark.createDataFrame([(10,), (9,), (None,)], "n int")
    assert model.one_hot(numbers, ["n"]).columns == ["n_9", "n_10"]


def test_sparse_encoding_of_many_levels(spark, rows):
    """A column with 100,000 levels, one that holds a third of the rows, and one of another type."""
    n = F.col("id")
    df = spark.range(150_000).select(
        "id",
        F.when(n < 50_000, F.lit("hot")).otherwise(F.format_string("level %06d", n)).alias("s"),
        F.when(n % 7 != 0, (n % 3).cast("int")).alias("k"),
    )
    numbered = model.number_levels(df, ["s", "k"])
    want = sorted(["hot", *[f"level {i:06d}" for i in range(50_000, 150_000)]])
    got = numbered.orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(100_004))
    assert [(r["column"], r["level"]) for r in got] == [*[("s", v) for v in want], ("k", "0"), ("k", "1"), ("k", "2")]
    place = {v: i for i, v in enumerate(want)}
    out = model.encode_levels(df, ["s", "k"], numbered)
    assert out.columns == ["id", "positions"] and out.count() == 150_000
    for r in out.filter("id % 4999 = 1").collect():
        level = "hot" if r["id"] < 50_000 else f"level {r['id']:06d}"
        assert r["positions"] == [place[level], *([100_001 + r["id"] % 3] if r["id"] % 7 else [])]
    unseen = spark.createDataFrame([(1, "new", 1), (2, None, None)], "id long, s string, k int")
    assert rows(model.encode_levels(unseen, ["s", "k"], numbered).select("id", F.size("positions"))) == [(1, 1), (2, 0)]
    assert model.encode_levels(unseen.limit(0), ["s", "k"]).count() == 0


def chained_by_rows(x, y, rounds, ridge):
    """The same chained regressions, row by row on standardised columns."""
    mx, sx, my, sy = x.mean(0), x.std(0), np.nanmean(y, 0), np.nanstd(y, 0)
    zx, zy = (x - mx) / sx, (y - my) / sy
    hole, now = np.isnan(zy), np.nan_to_num(zy)
    for _ in range(rounds):
        for t in range(y.shape[1]):
            u = np.hstack([np.ones((len(x), 1)), zx, np.delete(now, t, axis=1)])
            seen = ~hole[:, t]
            system = u[seen].T @ u[seen] + ridge * seen.sum() * np.diag([0.0] + [1.0] * (u.shape[1] - 1))
            weights = np.linalg.lstsq(system, u[seen].T @ now[seen, t], rcond=None)[0]
            now[~seen, t] = u[~seen] @ weights
    return my + sy * now


@pytest.mark.parametrize("targets", [2, 3, 11])
def test_impute_chained_equals_row_iteration(spark, targets):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 3)) * [1, 5, 0.2] + [0, 40, 3]
    y = x @ rng.normal(size=(3, targets)) + rng.normal(size=(300, targets)) * 0.3
    y[rng.random(y.shape) < 0.25] = np.nan
    y[0] = np.nan
    names = [f"y{t}" for t in range(targets)]
    data = [(i, *map(float, x[i]), *[None if np.isnan(v) else float(v) for v in y[i]]) for i in range(300)]
    df = spark.createDataFrame(data, "i int, a double, b double, c double, " + ", ".join(f"{n} double" for n in names))
    out = model.impute_chained(df, names, ["a", "b", "c"], rounds=7).orderBy("i").toPandas()
    want = chained_by_rows(x, y, 7, 1e-6)
    assert np.allclose(out[[f"{n}_impute" for n in names]].to_numpy(float), want)


def test_impute_chained_with_tasks_without_rows(spark):
    df = spark.createDataFrame([(i, float(i), None if i % 3 == 0 else 2.0 * i + 1) for i in range(9)], "i int, a double, y double")
    filled = model.impute_chained(df.repartitionByRange(40, "i").filter("i <> 4"), ["y"], ["a"], rounds=1, ridge=0.0).orderBy("i").collect()
    assert [r["i"] for r in filled] == [0, 1, 2, 3, 5, 6, 7, 8]
    assert np.allclose([r["y_impute"] for r in filled], [2 * r["i"] + 1 for r in filled])
    assert model.impute_chained(df.limit(0), ["y"], ["a"]).count() == 0


def test_basis_is_a_partition_of_unity():
    s = model.Smooth("x", -1.0, 4.0, 6)
    x = np.linspace(-1.0, 4.0, 50)
    assert np.allclose(s.raw(x).sum(axis=1), 1.0) and s.raw(x).min() >= -1e-12


def test_smooth_logit_recovers_a_curve(spark):
    rng = np.random.default_rng(1)
    n = 6000
    x, age, sex = rng.uniform(40, 110, n), rng.normal(60, 12, n), rng.integers(0, 2, n)
    eta = -1.5 + ((x - 75) / 18) ** 2 + 0.03 * (age - 60) + 0.4 * sex
    y = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(int)
    df = spark.createDataFrame(
        [tuple(map(float, r)) for r in zip(x, age, sex, y)], "x double, age double, sex double, y double"
    )
    fit = model.fit_smooth_logit(df, "y", ["x", "age"], ["sex"])
    assert fit.n == n and 3 < fit.edf < 15
    assert abs(fit.beta[-1] - 0.4) < 4 * math.sqrt(fit.cov[-1, -1])
    curve = model.effect_curve(fit, df, "x", at={"sex": 0}, grid=F.round("x"))
    c = curve.filter((F.col("x") > 45) & (F.col("x") < 105)).toPandas().sort_values("x")
    truth = -1.5 + ((c["x"] - 75) / 18) ** 2 + 0.03 * (fit.medians["age"] - 60)
    assert np.abs(c["fit"] - truth).max() < 0.35
    assert ((c["fit"] - truth).abs() < 3.5 * c["se"] + 0.05).mean() > 0.9
    assert (c["lcl"] < c["prob"]).all() and (c["prob"] < c["ucl"]).all()
    flat = model.plateau(model.curve_slope(curve, "x", "fit", scale=1.0), 0.03, 50, 100).first()
    assert 66 <= flat["plateau_low"] <= 76 and 73 <= flat["plateau_high"] <= 84


def test_curve_slope_and_plateau_bounds(spark, rows):
    df = spark.createDataFrame([(1.0, 0.10), (1.4, 0.9), (2.0, 0.20), (4.0, 0.20), (5.0, 0.10)], "x double, y double")
    slopes = model.curve_slope(df, "x", "y")
    assert [(a, r, round(b, 9)) for a, r, b in rows(slopes)] == [(1.0, 2.0, 10.0), (2.0, 4.0, 0.0), (4.0, 5.0, -10.0)]
    assert rows(model.plateau(slopes, 0.1, 1.0, 4.0)) == [(2.0, 2.0)]
    assert rows(model.plateau(slopes, 0.1, 2.0, 4.0)) == [(None, None)]


def walked(points, step):
    """The study's walk over one curve: anchor to the next point at least a step on."""
    points, out, j = sorted(points), [], 0
    for i in range(1, len(points)):
        if points[i][0] - points[j][0] >= step:
            out.append((points[j][0], points[i][0], (points[i][1] - points[j][1]) / (points[i][0] - points[j][0])))
            j = i
    return out


@pytest.mark.parametrize("step", [1.0, 0.1, 3.0])
def test_the_anchor_walk_is_exact(spark, step):
    """Points much closer than step / 64, wide gaps, one-point curves, decimals whose difference rounds below the step."""
    rng = np.random.default_rng(2)
    curves = {
        "dense": rng.uniform(60, 64, 3000),
        "gaps": np.concatenate([rng.uniform(a, a + 0.01, 200) for a in (-50, -3, 0, 2.5, 90)]),
        "decimals": np.round(rng.uniform(60, 90, 900), 2),
        "steps": np.arange(40) * step,
        "one": np.array([5.0]),
        "two": np.array([72.35, 73.35, 72.35 + step]),
    }
    data = [(n, float(a), float(np.sin(a))) for n, xs in curves.items() for a in dict.fromkeys(xs)]
    df = spark.createDataFrame([*data, (None, 1.0, 2.0), (None, 9.0, 3.0), ("dense", None, 1.0), ("dense", 61.0, None)], "c string, x double, y double")
    got = sorted(tuple(r) for r in model.curve_slope(df, "x", "y", step, 1.0, ["c"]).filter("c is not null").collect())
    want = sorted((n, *r) for n in curves for r in walked({(a, b) for c, a, b in data if c == n}, step))
    assert got == want
    assert model.curve_slope(df, "x", "y", step, 1.0, ["c"]).filter("c is null").count() == 1
    assert model.curve_slope(df.limit(0), "x", "y", step).count() == 0


@pytest.mark.parametrize("smoothing", [None, 0.001])
def test_smooth_logit_settles_where_an_end_has_one_outcome(spark, smoothing):
    """Few rows at the ends of the range, all with one outcome: full steps overshoot there and never come back."""
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(50, 6, 2000), [0.0, 1.0, 99.0, 100.0]])
    y = np.where(np.abs(x - 50) > 20, 0.0, (rng.random(len(x)) < 0.98).astype(float))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    fitted = model.fit_smooth_logits(df, {"m": model.Formula("y", ("x",))}, smoothing=smoothing, tol=1e-10)
    assert max(abs(r["score"]) for r in model.score_equations(df, fitted).collect()) < 1e-5
    assert fitted["m"].deviance < 500


def test_models_fitted_together_equal_models_fitted_alone(spark):
    rng = np.random.default_rng(9)
    n = 1500
    x, z, s = rng.uniform(0, 10, n), rng.normal(0, 1, n), rng.integers(0, 2, n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(np.sin(x) + 0.5 * z - 0.5)))).astype(float)
    w = (rng.random(n) < 0.3).astype(float)
    data = [tuple(float(v) for v in r) for r in zip(x, z, s, y, w)]
    data = [(None if i % 17 == 0 else r[0], *r[1:]) for i, r in enumerate(data)]
    df = spark.createDataFrame(data, "x double, z double, s double, y double, w double")
    both = model.fit_smooth_logits(
        df, {"a": model.Formula("y", ("x", "z"), ("s",)), "b": model.Formula("w", ("z",))}
    )
    alone = model.fit_smooth_logit(df, "y", ["x", "z"], ["s"])
    assert both["a"].n == alone.n == n - len(range(0, n, 17)) and both["b"].n == n
    assert np.allclose(both["a"].beta, alone.beta, atol=1e-6) and both["a"].lambdas == alone.lambdas
    other = model.fit_smooth_logit(df, "w", ["z"])
    assert np.allclose(both["b"].beta, other.beta, atol=1e-6)


def test_two_sided_p_against_a_table(spark):
    """Values of the normal distribution as printed in tables."""
    from cohortline.functions.exprs import two_sided_p

    table = [(0.0, 1.0), (0.674490, 0.5), (1.644854, 0.1), (1.959964, 0.05), (2.575829, 0.01), (3.290527, 0.001), (3.890592, 0.0001)]
    got = spark.createDataFrame([(z,) for z, _ in table], "z double").select("z", two_sided_p(F.col("z")).alias("p")).collect()
    for row, (_, p) in zip(sorted(got), table, strict=True):
        assert abs(row.p - p) < 1e-6


def test_models_fit_where_workers_cannot_import_the_package(tmp_path):
    """Started from another folder, with a path that only the driver knows."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
import __spark_entry__
from cohortline.session import local_session
spark = local_session("2", 2, "2g")
print(__spark_entry__.queries()["smooth_logit_plateau"](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.stdout.strip().endswith("1"), out.stderr[-2000:]


def test_a_model_that_has_not_converged_is_an_error(spark):
    from cohortline.operators.model import fit_smooth_logit

    df = spark.range(400).select((F.col("id") % 2).alias("y"), (F.col("id") * 7 % 31).alias("x"))
    with pytest.raises(ArithmeticError):
        fit_smooth_logit(df, "y", ["x"], max_passes=1)


def test_roughness_of_large_coefficients_on_a_line():
    """Coefficients on a straight line have no roughness; by the matrix, rounding leaves more than the fit tolerates."""
    term = model.Smooth("x", 0.0, 1.0, 10)
    line = 96.0 * np.arange(1, term.width + 1) / 7
    m = model.SmoothLogit("y", [term], [], np.r_[0.0, line], [1e5], 10)
    assert abs(m.roughness(m.beta, m.lambdas) - 1e-8 * (m.beta @ m.beta)) < 1e-12
    bent = np.r_[2.0, line + np.sin(np.arange(term.width))]
    assert np.isclose(m.roughness(bent, m.lambdas), bent @ m.penalty(m.lambdas) @ bent, rtol=1e-6)
