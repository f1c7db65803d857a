"""Summaries, fences, contingency tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions.exprs import two_sided_p
from cohortline.operators.quantiles import exact_quantiles


def share(df: DataFrame, predicate: Column, name: str = "share") -> DataFrame:
    """Share of all rows for which the predicate is true (unknown counts as not true)."""
    return df.agg(F.avg(F.when(predicate, 1.0).otherwise(0.0)).alias(name))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def distinct_count(df: DataFrame, col: str) -> DataFrame:
    """Two-level count: the distinct values are spread over tasks before they are counted."""
    return df.select(col).distinct().agg(F.count(col).alias("n_distinct"))


def _stack(wide: DataFrame, cells: Sequence[tuple[Sequence[object], Column]], names: Sequence[str]) -> DataFrame:
    """One-row frame to long format: each cell is ``(labels, value)``."""
    rows = [F.struct(*[F.lit(x).alias(n) for n, x in zip(names, labels)], v.cast("double").alias("value")) for labels, v in cells]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def null_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows with NULL per column, from one aggregation: ``column, n_null, share``."""
    cols = list(cols or df.columns)
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    rows = [
        F.struct(
            F.lit(c).alias("column"), F.col(c).alias("n_null"), (F.col(c) / F.nullif(F.col("_n"), F.lit(0))).alias("share")
        )
        for c in cols
    ]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def describe(df: DataFrame, cols: Sequence[str], pieces: int | None = None) -> DataFrame:
    """``variable, stat, value`` with count, mean, sd, min, quartiles and max."""
    moments = df.agg(
        *[
            f(c).cast("double").alias(f"{c}__{n}")
            for c in cols
            for n, f in (("count", F.count), ("mean", F.avg), ("sd", F.stddev_samp), ("min", F.min), ("max", F.max))
        ]
    )
    quart = exact_quantiles(df, [], {c: F.col(c) for c in cols}, [0.25, 0.5, 0.75], pieces)
    names = ["variable", "stat"]
    a = _stack(moments, [((c, n), F.col(f"{c}__{n}")) for c in cols for n in ("count", "mean", "sd", "min", "max")], names)
    b = _stack(quart, [((c, n), F.col(c)[i]) for c in cols for i, n in enumerate(("p25", "p50", "p75"))], names)
    return a.unionByName(b)


def iqr_fence(df: DataFrame, cols: Sequence[str], k: float = 1.5, pieces: int | None = None) -> DataFrame:
    """Adds ``<col>_outlier``: strictly outside ``[q1 - k*iqr, q3 + k*iqr]``. NULL is never an outlier.

    The fences are one row, handed to the scan as a scalar subquery.
    """
    q = exact_quantiles(df, [], {c: F.col(c) for c in cols}, [0.25, 0.75], pieces)
    pair = lambda c: F.struct(
        (F.col(c)[0] - k * (F.col(c)[1] - F.col(c)[0])).alias("lo"),
        (F.col(c)[1] + k * (F.col(c)[1] - F.col(c)[0])).alias("hi"),
    )
    fences = q.select(F.struct(*[pair(c).alias(c) for c in cols]).alias("f")).scalar()
    flagged = df.withColumn("_f", fences)
    out = flagged.withColumns(
        {
            f"{c}_outlier": F.coalesce((F.col(c) > F.col("_f")[c]["hi"]) | (F.col(c) < F.col("_f")[c]["lo"]), F.lit(False))
            for c in cols
        }
    )
    return out.drop("_f")


def fences(df: DataFrame, cols: Sequence[str], k: float = 1.5, pieces: int | None = None) -> DataFrame:
    """The fence values themselves: ``variable, low, high``."""
    q = exact_quantiles(df, [], {c: F.col(c) for c in cols}, [0.25, 0.75], pieces)
    rows = [
        F.struct(
            F.lit(c).alias("variable"),
            (F.col(c)[0] - k * (F.col(c)[1] - F.col(c)[0])).alias("low"),
            (F.col(c)[1] + k * (F.col(c)[1] - F.col(c)[0])).alias("high"),
        )
        for c in cols
    ]
    return q.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def table_one(
    df: DataFrame,
    continuous: Sequence[str],
    categorical: Sequence[str],
    nonnormal: Sequence[str] = (),
    pieces: int | None = None,
) -> DataFrame:
    """Cohort summary, long: ``variable, level, stat, value``.

    Continuous variables give mean and sd, or median and quartiles where named in ``nonnormal``;
    categorical ones give n and percent of the present values per level.
    """
    normal = [c for c in continuous if c not in nonnormal]
    head = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[f(c).alias(f"{c}__{n}") for c in normal for n, f in (("mean", F.avg), ("sd", F.stddev_samp))],
    )
    names = ["variable", "level", "stat"]
    parts = [
        _stack(
            head,
            [(("n", "", "n"), F.col("_n"))] + [((c, "", n), F.col(f"{c}__{n}")) for c in normal for n in ("mean", "sd")],
            names,
        )
    ]
    if nonnormal:
        q = exact_quantiles(df, [], {c: F.col(c) for c in nonnormal}, [0.25, 0.5, 0.75], pieces)
        parts.append(
            _stack(q, [((c, "", n), F.col(c)[i]) for c in nonnormal for i, n in enumerate(("p25", "median", "p75"))], names)
        )
    if categorical:
        pairs = [F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")) for c in categorical]
        levels = (
            df.select(F.explode(F.array(*pairs)).alias("p"))
            .select("p.*")
            .filter(F.col("level").isNotNull())
            .groupBy("variable", "level")
            .agg(F.count(F.lit(1)).cast("double").alias("n"))
        )
        totals = levels.groupBy("variable").agg(F.sum("n").alias("_t"))
        rows = F.array(
            F.struct(F.lit("n").alias("stat"), F.col("n").alias("value")),
            F.struct(F.lit("percent").alias("stat"), (100.0 * F.col("n") / F.col("_t")).alias("value")),
        )
        parts.append(
            levels.join(totals, "variable")
            .select("variable", "level", F.explode(rows).alias("r"))
            .select("variable", "level", "r.stat", "r.value")
        )
    return reduce(lambda a, b: a.unionByName(b), parts)


def _ratio_columns() -> list[Column]:
    """From counts a, b, c, d (exposed events, control events, exposed non-events, control non-events)."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    z = F.lit(0.0)
    odds = F.when(b * c > 0, a * d / (b * c))
    positive = (a > 0) & (b > 0) & (c > 0) & (d > 0)
    se = F.when(positive, F.sqrt(1.0 / a + 1.0 / b + 1.0 / c + 1.0 / d))
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    chi2 = F.when(margins > 0, (a + b + c + d) * F.pow(a * d - b * c, F.lit(2.0)) / margins)
    return [
        (a / F.nullif(a + c, z)).alias("risk_exposed"),
        (b / F.nullif(b + d, z)).alias("risk_control"),
        odds.alias("odds_ratio"),
        F.when(positive, F.exp(F.log(a * d / F.nullif(b * c, z)) - 1.96 * se)).alias("ci_low"),
        F.when(positive, F.exp(F.log(a * d / F.nullif(b * c, z)) + 1.96 * se)).alias("ci_high"),
        chi2.alias("chi2"),
        two_sided_p(F.sqrt(chi2)).alias("p_value"),
    ]


def _cells(exposure: Column, exposed: tuple[float, float], control: tuple[float, float], outcome: Column) -> list[Column]:
    low, high = exposure.between(*exposed), exposure.between(*control)
    return [
        F.count_if(low & (outcome == 1)).alias("a"),
        F.count_if(high & (outcome == 1)).alias("b"),
        F.count_if(low & (outcome == 0)).alias("c"),
        F.count_if(high & (outcome == 0)).alias("d"),
    ]


def odds_ratio(
    df: DataFrame, exposure: str, exposed: tuple[float, float], control: tuple[float, float], outcome: str
) -> DataFrame:
    """2x2 counts of two exposure bands (closed; a shared border counts in both), risks, odds ratio,
    Wald interval on the log scale, Pearson chi-square and its p-value. NULL exposure is left out."""
    counts = df.agg(*_cells(F.col(exposure), exposed, control, F.col(outcome)))
    return counts.select("a", "b", "c", "d", *_ratio_columns())


def odds_ratio_table(
    df: DataFrame,
    criteria: Mapping[str, Column],
    metrics: Mapping[str, tuple[str, tuple[float, float], tuple[float, float]]],
    outcome: str,
) -> DataFrame:
    """The same for every subgroup and exposure metric in one pass over the data.

    ``criteria`` are predicates on the same rows; ``metrics`` are ``{name: (column, exposed, control)}``. Rows are not
    copied: one aggregation counts all cells, and its single row becomes one row per criterion and metric.
    """
    y = F.col(outcome)
    cells, rows = [], []
    for i, (criterion, met) in enumerate(criteria.items()):
        for j, (metric, (column, exposed, control)) in enumerate(metrics.items()):
            bands = {"a": (exposed, 1), "b": (control, 1), "c": (exposed, 0), "d": (control, 0)}
            cells += [
                F.count_if(met & F.col(column).between(*band) & (y == value)).alias(f"{n}_{i}_{j}")
                for n, (band, value) in bands.items()
            ]
            touched = F.count_if(met & (F.col(column).between(*exposed) | F.col(column).between(*control)))
            cells.append(touched.alias(f"t_{i}_{j}"))
            counts = [F.col(f"{n}_{i}_{j}").alias(n) for n in "abcdt"]
            rows.append(F.struct(F.lit(criterion).alias("criterion"), F.lit(metric).alias("metric"), *counts))
    counted = df.agg(*cells).select(F.explode(F.array(*rows)).alias("r")).select("r.*").filter("t > 0")
    return counted.select("criterion", "metric", "a", "b", "c", "d", *_ratio_columns())
