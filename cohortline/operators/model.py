"""Encoding, imputation, smooth logistic models and what is read off their curves."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortline.functions.exprs import logistic
from cohortline.operators.joins import lookup_join
from cohortline.operators.quantiles import exact_quantiles
from cohortline.session import cut_lineage, remove_scratch, write_scratch

MAX_LEVELS = 200


def _distinct_levels(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct values of all columns in one pass: number of the column ``_c``, ``level`` as a string. NULL is no level."""
    each = [F.struct(F.lit(i).alias("c"), F.col(c).cast("string").alias("level")) for i, c in enumerate(cols)]
    cells = df.select(F.explode(F.array(*each)).alias("x")).select(F.col("x.c").alias("_c"), "x.level")
    return cells.filter(F.col("level").isNotNull()).distinct()


def one_hot(df: DataFrame, cols: Sequence[str], max_levels: int = MAX_LEVELS) -> DataFrame:
    """Replace each categorical column by one 0/1 column ``<col>_<level>`` per level; NULL gives all zeros.

    The levels of all columns are found in one pass. Every level is a column of the frame, so a column with more than
    ``max_levels`` is an error; ``encode_levels`` takes any number.
    """
    if not cols:
        return df
    found = cut_lineage(_distinct_levels(df, cols))
    many = found.groupBy("_c").count().filter(F.col("count") > max_levels).collect()  # at most one row per column
    if many:
        raise ValueError(f"more than {max_levels} levels in {', '.join(cols[r['_c']] for r in many)}; use encode_levels")
    levels: list[list[str]] = [[] for _ in cols]
    for row in found.collect():  # at most max_levels per column
        levels[row["_c"]].append(row["level"])
    made = {}
    for c, own in zip(cols, levels):
        numeric = isinstance(df.schema[c].dataType, T.NumericType)
        for v in sorted(own, key=float if numeric else str):
            made[f"{c}_{v}"] = F.when(F.col(c).cast("string") == v, 1).otherwise(0)
    return df.withColumns(made).drop(*cols)


def number_levels(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """All levels of the columns with their position in an encoded row: ``column, level, position`` from 0 on.

    Positions follow the order of the columns, then of the levels as strings. The levels are dealt by a range
    partitioning, numbered within their tile and moved on by the size of the tiles before it, so a column may have any
    number of them.
    """
    spread = _distinct_levels(df, cols).repartitionByRange("_c", "level")
    dealt = cut_lineage(spread.withColumn("_tile", F.spark_partition_id()))
    earlier = Window.orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)  # over one row per tile
    tiles = dealt.groupBy("_tile").agg(F.count(F.lit(1)).alias("_n"))
    tiles = tiles.select("_tile", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_skip"))
    in_tile = F.row_number().over(Window.partitionBy("_tile").orderBy("_c", "level"))
    names = F.array(*[F.lit(c) for c in cols])
    numbered = dealt.withColumn("_i", in_tile).join(cut_lineage(tiles), "_tile")
    return numbered.select(names[F.col("_c")].alias("column"), "level", (F.col("_skip") + F.col("_i") - 1).alias("position"))


def encode_levels(df: DataFrame, cols: Sequence[str], numbered: DataFrame | None = None, name: str = "positions") -> DataFrame:
    """One-hot rows in sparse form: the columns give way to ``name``, the rising positions of the ones as an array<long>.

    ``numbered`` is what ``number_levels`` gave, for the same frame unless it is passed; a NULL and a level that is not in it have
    no position. Levels are looked up by joins and never meet on the driver.
    """
    numbered = cut_lineage(number_levels(df, cols) if numbered is None else numbered)
    for i, c in enumerate(cols):
        own = numbered.filter(F.col("column") == c).select(F.col("level").alias(f"_level_{i}"), F.col("position").alias(f"_at_{i}"))
        df = lookup_join(df.withColumn(f"_level_{i}", F.col(c).cast("string")), own, [f"_level_{i}"], "left").drop(f"_level_{i}")
    found = F.array_sort(F.array_compact(F.array(*[F.col(f"_at_{i}") for i in range(len(cols))])))
    return df.withColumn(name, found).drop(*cols, *[f"_at_{i}" for i in range(len(cols))])


def impute_chained(
    df: DataFrame,
    targets: Sequence[str],
    features: Sequence[str],
    rounds: int = 10,
    ridge: float = 1e-6,
    suffix: str = "_impute",
) -> DataFrame:
    """Chained-equation imputation of the targets by linear regression on features and other targets.

    Starts from the column means; each round refits every target on the rows where it was observed and
    replaces the missing ones by the prediction. Missing features count as their mean. Adds
    ``<target><suffix>``.

    Rows that miss the same targets are all filled by one linear map of their observed columns, so the
    second moments per missing pattern hold all a round needs: the data is read twice (means, moments)
    however many rounds are run. Patterns are those that occur, found by grouping; the maps go back to the rows by
    a lookup of the pattern.
    """
    cols = [*features, *targets]
    first = df.agg(
        *[f(c).alias(f"{c}__{n}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    ).first()
    mean = {c: float(first[f"{c}__m"] or 0.0) for c in cols}
    sd = {c: float(first[f"{c}__s"] or 0.0) or 1.0 for c in cols}
    scaled = df.select(*[((F.col(c).cast("double") - mean[c]) / sd[c]).alias(f"z{i}") for i, c in enumerate(cols)])
    n_features, width = len(features), 1 + len(cols)
    moments = _pattern_moments(scaled, n_features, width)
    # fill[p] maps the observed columns of a row of pattern p to all columns; the mean fill is zero here.
    fill = {p: np.eye(width) for p in moments}
    for _ in range(rounds):
        for t in range(len(targets)):
            at = 1 + n_features + t
            others = [i for i in range(width) if i != at]
            full = sum((fill[p] @ moments[p] @ fill[p].T for p in moments if p[t] == "0"), np.zeros((width, width)))
            system = full[np.ix_(others, others)] + ridge * max(full[0, 0], 1.0) * np.diag([0.0] + [1.0] * (width - 2))
            weights = np.linalg.lstsq(system, full[others, at], rcond=None)[0]
            for p in moments:
                if p[t] == "1":
                    fill[p][at] = weights @ fill[p][others]

    maps = [(p, [fill[p][1 + n_features + t].tolist() if p[t] == "1" else None for t in range(len(targets))]) for p in moments]
    table = df.sparkSession.createDataFrame(maps, "_pattern string, _maps array<array<double>>")
    observed = F.array(F.lit(1.0), *[F.coalesce((F.col(c).cast("double") - mean[c]) / sd[c], F.lit(0.0)) for c in cols])
    out = {}
    for t, name in enumerate(targets):
        terms = F.zip_with(F.col("_maps")[t], observed, lambda w, v: w * v)
        predicted = mean[name] + sd[name] * F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)
        out[name + suffix] = F.when(F.col(name).isNull(), predicted).otherwise(F.col(name).cast("double"))
    pattern = F.concat(*[F.when(F.col(t).isNull(), "1").otherwise("0") for t in targets])
    filled = lookup_join(df.withColumn("_pattern", pattern), table, ["_pattern"], "left").withColumns(out)
    return filled.select(*df.columns, *out)


def _pattern_moments(scaled: DataFrame, n_features: int, width: int) -> dict[str, np.ndarray]:
    """Second moments of the rows of each missing pattern that occurs, named by a 0 or 1 per target.

    Each task adds up its own patterns; what it has is regrouped by pattern and added again.
    """
    schema = "pattern string, v binary"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            z = batch.to_numpy(float)
            u = np.hstack([np.ones((len(z), 1)), np.nan_to_num(z)])
            kinds, kind = np.unique(np.isnan(z[:, n_features:]), axis=0, return_inverse=True)
            for i, missing in enumerate(kinds):
                rows = u[kind.ravel() == i]
                name = "".join("1" if m else "0" for m in missing)
                held[name] = held.get(name, 0.0) + rows.T @ rows
        if held:  # a task without rows has no matrix; Spark cannot take a frame without rows for binary columns
            yield pd.DataFrame({"pattern": list(held), "v": [m.tobytes() for m in held.values()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, v in zip(batch["pattern"], batch["v"]):
                held[name] = held.get(name, 0.0) + np.frombuffer(v)
        if held:
            yield pd.DataFrame({"pattern": list(held), "v": [m.tobytes() for m in held.values()]})

    sums = scaled.mapInPandas(partial, schema).repartition("pattern").mapInPandas(add, schema)
    # Patterns that occur, each with a matrix of the model's size; sorted, so that sums over them do not depend on the tasks.
    found = {r["pattern"]: np.frombuffer(r["v"]).reshape(width, width) for r in sums.toLocalIterator()}
    return dict(sorted(found.items()))


# --------------------------------------------------------------------------- smooth logistic model


@dataclass(frozen=True)
class Smooth:
    """Cubic B-spline basis on equal knots over the observed range, centred over the data."""

    column: str
    low: float
    high: float
    segments: int = 8
    centre: tuple[float, ...] = ()

    def raw(self, x: np.ndarray) -> np.ndarray:
        step = (self.high - self.low) / self.segments
        knots = self.low + step * np.arange(-3, self.segments + 4)
        x = np.clip(x, self.low, self.high - 1e-9 * step)
        basis = ((x[:, None] >= knots[:-1]) & (x[:, None] < knots[1:])).astype(float)
        for degree in (1, 2, 3):
            left = (x[:, None] - knots[: -degree - 1]) / (degree * step)
            right = (knots[degree + 1 :] - x[:, None]) / (degree * step)
            count = basis.shape[1] - 1
            basis = left[:, :count] * basis[:, :count] + right[:, :count] * basis[:, 1:]
        return basis

    def design(self, x: np.ndarray) -> np.ndarray:
        # Centring makes the term sum to zero over the data; one column is dropped as it then depends on the rest.
        return (self.raw(x) - np.asarray(self.centre))[:, 1:]

    @property
    def width(self) -> int:
        return self.segments + 2

    def second(self) -> np.ndarray:
        return np.diff(np.eye(self.segments + 3), n=2, axis=0)[:, 1:]

    def penalty(self) -> np.ndarray:
        return self.second().T @ self.second()


@dataclass(frozen=True)
class Formula:
    """``outcome ~ smooth terms + linear terms`` by column name."""

    outcome: str
    smooths: tuple[str, ...]
    linear: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return [self.outcome, *self.smooths, *self.linear]


@dataclass
class SmoothLogit:
    outcome: str
    smooths: list[Smooth]
    linear: list[str]
    beta: np.ndarray
    lambdas: list[float]
    n: int
    medians: dict[str, float] = field(default_factory=dict)
    cov: np.ndarray | None = None
    edf: float = float("nan")
    deviance: float = float("inf")
    passes: int = 0

    @property
    def size(self) -> int:
        return len(self.beta)

    def penalty(self, lambdas: Sequence[float]) -> np.ndarray:
        s, at = 1e-8 * np.eye(self.size), 1
        for term, lam in zip(self.smooths, lambdas):
            s[at : at + term.width, at : at + term.width] += lam * term.penalty()
            at += term.width
        return s

    def roughness(self, beta: np.ndarray, lambdas: Sequence[float]) -> float:
        """``beta' S beta`` as a sum of squared differences: the matrix would lose a small one between large coefficients."""
        total, at = 1e-8 * (beta @ beta), 1
        for term, lam in zip(self.smooths, lambdas):
            total += lam * ((term.second() @ beta[at : at + term.width]) ** 2).sum()
            at += term.width
        return float(total)


def _design(frame: pd.DataFrame, smooths: Sequence[Smooth], linear: Sequence[str]) -> np.ndarray:
    parts = [np.ones((len(frame), 1))]
    parts += [s.design(frame[s.column].to_numpy(float)) for s in smooths]
    parts += [frame[c].to_numpy(float)[:, None] for c in linear]
    return np.hstack(parts)


# Partial vectors meet in so many tasks before the driver adds up one vector from each.
TREE_WIDTH = 32


def _sum_over_rows(df: DataFrame, statistic, size: int) -> np.ndarray:
    """Add up a fixed-length vector computed per Arrow batch: per task, then per group of tasks, then on the driver."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for batch in batches:
            if len(batch):
                total += statistic(batch)
        yield pd.DataFrame({"v": [total.tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for batch in batches:
            for v in batch["v"]:
                total += np.frombuffer(v)
        yield pd.DataFrame({"v": [total.tobytes()]})

    tasks = df.mapInPandas(partial, "v binary")
    sums = tasks.repartition(TREE_WIDTH).mapInPandas(add, "v binary")
    out = np.zeros(size)
    for row in sums.collect():  # at most TREE_WIDTH rows
        out += np.frombuffer(row["v"])
    return out


def _working_moments(batch: pd.DataFrame, m: SmoothLogit) -> np.ndarray:
    """X'WX, X'Wz, z'Wz and the deviance of the rows that are complete for the model."""
    frame = batch[[m.outcome, *[t.column for t in m.smooths], *m.linear]].dropna()
    if frame.empty:
        return np.zeros(m.size * m.size + m.size + 2)
    x, y = _design(frame, m.smooths, m.linear), frame[m.outcome].to_numpy(float)
    eta = np.clip(x @ m.beta, -30, 30)
    mu = 1 / (1 + np.exp(-eta))
    w = np.maximum(mu * (1 - mu), 1e-9)
    z = eta + (y - mu) / w
    dev = -2 * np.sum(y * np.log(np.maximum(mu, 1e-15)) + (1 - y) * np.log(np.maximum(1 - mu, 1e-15)))
    return np.concatenate([(x.T @ (w[:, None] * x)).ravel(), x.T @ (w * z), [np.sum(w * z * z), dev]])


def _moments(data: DataFrame, models: Sequence[SmoothLogit]) -> list[tuple[np.ndarray, np.ndarray, float, float]]:
    """The working moments of all models in one pass over the data."""
    sizes = [m.size * m.size + m.size + 2 for m in models]
    total = _sum_over_rows(data, lambda b: np.concatenate([_working_moments(b, m) for m in models]), sum(sizes))
    out = []
    for m, part in zip(models, np.split(total, np.cumsum(sizes)[:-1])):
        k = m.size
        out.append((part[: k * k].reshape(k, k), part[k * k : -2], part[-2], part[-1]))
    return out


def _choose_smoothing(m: SmoothLogit, gram: np.ndarray, rhs: np.ndarray, zz: float) -> None:
    """One sweep per term over a grid, by the un-biased risk criterion of the working linear model."""

    def risk(lambdas: Sequence[float]) -> float:
        system = gram + m.penalty(lambdas)
        b = np.linalg.solve(system, rhs)
        edf = np.trace(np.linalg.solve(system, gram))
        return (zz - 2 * b @ rhs + b @ gram @ b + 2 * edf) / m.n

    grid = 10.0 ** np.arange(-3, 6)
    for _ in range(2):
        for i in range(len(m.lambdas)):
            tries = [risk([*m.lambdas[:i], lam, *m.lambdas[i + 1 :]]) for lam in grid]
            m.lambdas[i] = float(grid[int(np.argmin(tries))])


# Parts of a step that raised the penalised deviance, tried together in the next pass.
SHORTER = tuple(0.5**k for k in range(1, 9))


@dataclass(frozen=True)
class _Path:
    """From where and to where a model's next step goes, the penalised deviance at its start, and the parts of it to try."""

    start: np.ndarray
    end: np.ndarray
    value: float = float("inf")
    lengths: Sequence[float] = (1.0,)

    def at(self, length: float) -> np.ndarray:
        return self.end if length == 1.0 else self.start + length * (self.end - self.start)


def fit_smooth_logits(
    df: DataFrame,
    formulas: Mapping[str, Formula],
    segments: int = 8,
    max_passes: int = 25,
    tol: float = 1e-6,
    smoothing: float | None = None,
) -> dict[str, SmoothLogit]:
    """Penalised logistic regressions with smooth terms, any number of them over the same rows.

    P-splines (Eilers & Marx 1996) fitted by penalised IRLS. A pass over the data adds up the small
    matrices X'WX and X'Wz of every model that has not converged yet, so a study of many formulas
    reads the data as often as its slowest model. The driver only solves systems of that size. A step that would
    raise a model's penalised deviance, as happens where an outcome is the same for all rows at an end of the range, is
    shortened: the next pass tries several parts of it.
    Each model uses the rows complete in its own columns. A model that has not settled within
    ``max_passes`` is an error. ``smoothing`` holds the weight of every roughness penalty instead of choosing it.
    """
    columns = list(dict.fromkeys(c for f in formulas.values() for c in f.columns))
    # Read once per pass, so the narrow numeric frame is written once instead of rebuilt every time.
    spark = df.sparkSession
    path = write_scratch(df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna("all"))
    try:
        return _fit(spark.read.parquet(path), formulas, segments, max_passes, tol, smoothing)
    finally:
        remove_scratch(spark, path)


def _fit(
    data: DataFrame, formulas: Mapping[str, Formula], segments: int, max_passes: int, tol: float, smoothing: float | None
) -> dict[str, SmoothLogit]:

    def complete(f: Formula, col: str) -> Column:
        return F.when(F.greatest(*[F.col(c).isNull() for c in f.columns]), None).otherwise(F.col(col))

    spread = data.agg(
        *[F.count(complete(f, f.outcome)).alias(f"{n}__n") for n, f in formulas.items()],
        *[F.avg(complete(f, f.outcome)).alias(f"{n}__rate") for n, f in formulas.items()],
        *[
            g(complete(f, c)).alias(f"{n}__{c}__{e}")
            for n, f in formulas.items()
            for c in f.smooths
            for e, g in (("lo", F.min), ("hi", F.max))
        ],
    ).first()
    models: dict[str, SmoothLogit] = {}
    for n, f in formulas.items():
        if not spread[f"{n}__n"]:
            raise ValueError(f"no complete rows for {n}")
        terms = []
        for c in f.smooths:
            low, high = spread[f"{n}__{c}__lo"], spread[f"{n}__{c}__hi"]
            terms.append(Smooth(c, low, max(high, low + 1e-9), segments))
        rate = min(max(spread[f"{n}__rate"], 1e-6), 1 - 1e-6)
        beta = np.zeros(1 + sum(t.width for t in terms) + len(f.linear))
        beta[0] = np.log(rate / (1 - rate))
        start = [1.0 if smoothing is None else float(smoothing)] * len(terms)
        models[n] = SmoothLogit(f.outcome, terms, list(f.linear), beta, start, int(spread[f"{n}__n"]))

    _centre(data, list(models.values()), segments + 3)
    measures = {
        f"{n}__{c}": complete(f, c) for n, f in formulas.items() for c in (*f.smooths, *f.linear)
    }
    medians = exact_quantiles(data, [], measures, [0.5]).first()
    for n, f in formulas.items():
        models[n].medians = {c: float(medians[f"{n}__{c}"][0]) for c in (*f.smooths, *f.linear)}

    active = list(models.values())
    paths = [_Path(m.beta, m.beta) for m in active]
    for turn in range(1, max_passes + 1):
        trials = [(p, length, replace(m, beta=p.at(length))) for m, p in zip(active, paths) for length in p.lengths]
        results: dict[int, list[tuple]] = {}
        for (p, length, trial), found in zip(trials, _moments(data, [trial for _, _, trial in trials])):
            value = found[3] + trial.roughness(trial.beta, trial.lambdas)
            results.setdefault(id(p), []).append((value, length, trial.beta, found))
        going = []
        for m, path in zip(active, paths):
            value, length, reached, (gram, rhs, zz, dev) = min(results[id(path)], key=lambda r: r[0])
            m.passes = turn
            if value > path.value + 1e-9 * (abs(path.value) + 0.1):  # a step too far: the same way again, but not as far
                going.append((m, replace(path, lengths=[length * s for s in SHORTER])))
                continue
            # The search settles in the first passes; holding it afterwards lets the coefficients converge.
            if turn <= 8 and smoothing is None:
                _choose_smoothing(m, gram, rhs, zz)
            system = gram + m.penalty(m.lambdas)
            m.beta = np.linalg.solve(system, rhs)
            m.cov = np.linalg.inv(system)
            m.edf = float(np.trace(m.cov @ gram))
            settled, m.deviance = length == 1.0 and abs(m.deviance - dev) < tol * (abs(dev) + 0.1), float(dev)
            if not settled:
                going.append((m, _Path(reached, m.beta, float(dev + m.roughness(reached, m.lambdas)))))
        active, paths = [m for m, _ in going], [path for _, path in going]
        if not active:
            break
    if active:
        names = [n for n, m in models.items() if any(m is other for other in active)]
        raise ArithmeticError(f"not converged after {max_passes} passes: {', '.join(names)}")
    return models


def score_equations(df: DataFrame, models: Mapping[str, SmoothLogit]) -> DataFrame:
    """What the fit makes zero, per model and coefficient: ``model, position, score``.

    The score is the gradient of the penalised log likelihood, X'(y - mu) - S beta, over the number of rows.
    """
    spark, names = df.sparkSession, list(models)
    columns = list(dict.fromkeys(c for m in models.values() for c in (m.outcome, *[t.column for t in m.smooths], *m.linear)))
    data = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    rows = []
    for n, (gram, rhs, _, _) in zip(names, _moments(data, [models[n] for n in names])):
        m = models[n]
        scores = (rhs - gram @ m.beta - m.penalty(m.lambdas) @ m.beta) / m.n
        rows += [(n, i, float(s)) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "model string, position int, score double")


def _centre(data: DataFrame, models: Sequence[SmoothLogit], basis_size: int) -> None:
    """Mean of every basis column over the rows each model uses, in one pass."""

    def sums(batch: pd.DataFrame) -> np.ndarray:
        out = []
        for m in models:
            frame = batch[[m.outcome, *[t.column for t in m.smooths], *m.linear]].dropna()
            out += [t.raw(frame[t.column].to_numpy(float)).sum(axis=0) for t in m.smooths]
        return np.concatenate(out) if out else np.zeros(0)

    total = _sum_over_rows(data, sums, basis_size * sum(len(m.smooths) for m in models))
    at = 0
    for m in models:
        for i, t in enumerate(m.smooths):
            centre = total[at : at + basis_size] / m.n
            m.smooths[i] = Smooth(t.column, t.low, t.high, t.segments, tuple(centre))
            at += basis_size


def fit_smooth_logit(
    df: DataFrame, outcome: str, smooths: Sequence[str], linear: Sequence[str] = (), **options
) -> SmoothLogit:
    """One model; see ``fit_smooth_logits``."""
    return fit_smooth_logits(df, {"m": Formula(outcome, tuple(smooths), tuple(linear))}, **options)["m"]


def effect_curves(
    models: Mapping[str, SmoothLogit],
    df: DataFrame,
    columns: Mapping[str, str],
    at: Mapping[str, float] | None = None,
    grid: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Predicted curve of every model over the distinct observed values of its column, the others held at their median.

    ``columns`` names the column of each model. ``at`` overrides held values (the reference level of a 0/1 column is
    0). ``grid`` replaces the values of a column by an expression, such as a rounded value. The data is read once for all
    models. Gives ``model, x, fit, se, lcl, prob, ucl``.
    """
    held = {n: {**m.medians, **(at or {})} for n, m in models.items()}
    parts = {n: (m.smooths, m.linear, m.beta, m.cov) for n, m in models.items()}

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, own in batch.groupby("model"):
                smooths, linear, beta, cov = parts[name]
                frame = pd.DataFrame({c: np.full(len(own), v) for c, v in held[name].items()})
                frame[columns[name]] = own["x"].to_numpy(float)
                x = _design(frame, smooths, linear)
                se = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", x, cov, x), 0))
                yield pd.DataFrame({"model": name, "x": own["x"].to_numpy(float), "fit": x @ beta, "se": se})

    values = {c: F.col(c) if grid is None or c not in grid else grid[c] for c in columns.values()}
    points = [F.struct(F.lit(n).alias("model"), values[c].cast("double").alias("x")) for n, c in columns.items()]
    xs = df.select(F.explode(F.array(*points)).alias("p")).select("p.model", "p.x").dropna().distinct()
    return xs.mapInPandas(score, "model string, x double, fit double, se double").select(
        "model",
        "x",
        "fit",
        "se",
        logistic(F.col("fit") - 1.96 * F.col("se")).alias("lcl"),
        logistic("fit").alias("prob"),
        logistic(F.col("fit") + 1.96 * F.col("se")).alias("ucl"),
    )


def effect_curve(
    model: SmoothLogit, df: DataFrame, column: str, at: Mapping[str, float] | None = None, grid: Column | None = None
) -> DataFrame:
    """The curve of one model; see ``effect_curves``. Gives ``x, fit, se, lcl, prob, ucl``."""
    return effect_curves({"m": model}, df, {"m": column}, at, None if grid is None else {column: grid}).drop("model")


def curve_slope(
    curve: DataFrame, x: str, y: str, step: float = 1.0, scale: float = 100.0, by: Sequence[str] = ()
) -> DataFrame:
    """Slopes between anchors along each curve: ``x`` is the left anchor, ``right`` the next, ``slope`` per unit of x.

    The first point is an anchor, and after each anchor the next point whose x less the anchor's is at least ``step``.
    ``by`` names the curves. Of points with one x the lowest stands. Every point counts: each gets its successor, and
    the anchors are found from the first point by doubling the jumps, so a curve of m anchors takes log2(m) joins on
    (curve, x) however many points it has.
    """
    name = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("all"))
    points = (
        curve.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(name.alias("_curve"), F.col(x).cast("double").alias("_x"))
        .agg(F.min(F.col(y).cast("double")).alias("_y"))
    )
    jumps = cut_lineage(_successors(points, step))
    ahead = jumps.filter(F.col("_to").isNotNull()).select("_curve", "_x", "_to")
    anchors = cut_lineage(jumps.groupBy("_curve").agg(F.min("_x").alias("_x")))
    while not ahead.isEmpty():
        further = anchors.join(ahead, ["_curve", "_x"]).select("_curve", F.col("_to").alias("_x"))
        anchors = cut_lineage(anchors.unionByName(further))
        then = ahead.select("_curve", F.col("_x").alias("_to"), F.col("_to").alias("_then"))
        ahead = cut_lineage(ahead.join(then, ["_curve", "_to"]).select("_curve", "_x", F.col("_then").alias("_to")))
    left = jumps.join(anchors, ["_curve", "_x"]).filter(F.col("_to").isNotNull())
    right = jumps.select("_curve", F.col("_x").alias("_to"), F.col("_y").alias("_then"))
    rise, run = F.col("_then") - F.col("_y"), F.col("_to") - F.col("_x")
    return left.join(right, ["_curve", "_to"]).select(
        *[F.col("_curve")[c].alias(c) for c in by], F.col("_x").alias("x"), F.col("_to").alias("right"), (scale * rise / run).alias("slope")
    )


def _successors(points: DataFrame, step: float) -> DataFrame:
    """Points ``_curve, _x, _y`` with ``_to``, the first x of the curve with ``_to - _x >= step``.

    The axis is cut into cells of one step. Each point asks in the cell where it would land: one scan of the cell from
    the right, points and questions together, knows the nearest point so far. Where a cell has none, the first point
    of the next filled cell answers, read off a frame with a few rows per cell. A question is asked a few units in the last
    place early, and the difference itself decides between the answer and the point after it.
    """

    def cell_of(at: Column) -> Column:
        return F.floor(at / F.lit(float(step)))

    in_cell = Window.partitionBy("_curve", "_cell").orderBy("_x")
    placed = cut_lineage(points.withColumn("_cell", cell_of(F.col("_x"))).withColumn("_next", F.lead("_x").over(in_cell)))
    own = placed.groupBy("_curve", "_cell").agg(F.min(F.struct("_x", "_next")).alias("_own"))
    none = F.lit(None).cast(own.schema["_own"].dataType)
    near = [F.struct((F.col("_cell") + i).alias("cell"), (F.col("_own") if i == 0 else none).alias("own")) for i in (0, 1, 2)]
    cells = own.select("_curve", F.explode(F.array(*near)).alias("c")).groupBy("_curve", F.col("c.cell").alias("_cell"))
    after = Window.partitionBy("_curve").orderBy(F.col("_cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
    filled = F.when(
        F.col("_own").isNotNull(),
        F.struct(F.col("_own._x").alias("_x"), F.coalesce("_own._next", "_later_x").alias("_next")),
    )
    cells = (
        cells.agg(F.max("c.own").alias("_own"))
        .withColumn("_later_x", F.last("_own._x", True).over(after))
        .withColumn("_later", F.last(filled, True).over(after))
        .select("_curve", "_cell", "_later_x", "_later")
    )
    asked = F.col("_x") + step - (F.abs("_x") + step) * 2.0**-50
    here = F.struct(F.col("_x").alias("_x"), F.col("_next").alias("_next"))
    kept = placed.select("_curve", "_cell", F.col("_x").alias("_at"), here.alias("_here"), F.lit(None).cast("double").alias("_x"), F.lit(None).cast("double").alias("_y"))
    asks = placed.select("_curve", cell_of(asked).alias("_cell"), asked.alias("_at"), F.lit(None).cast(kept.schema["_here"].dataType).alias("_here"), "_x", "_y")
    from_right = (
        Window.partitionBy("_curve", "_cell")
        .orderBy(F.col("_at").desc(), F.col("_here").isNull())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    answered = kept.unionByName(asks).withColumn("_found", F.last("_here", True).over(from_right)).filter(F.col("_x").isNotNull())
    found = F.col("_found").isNotNull()
    first = F.when(found, F.col("_found._x")).otherwise(F.col("_later._x"))
    second = F.when(found, F.coalesce("_found._next", "_later_x")).otherwise(F.col("_later._next"))
    reached = F.when(first - F.col("_x") >= step, first).otherwise(second)
    return answered.join(cut_lineage(cells), ["_curve", "_cell"], "left").select("_curve", "_x", "_y", reached.alias("_to"))


def plateau(
    slopes: DataFrame, eps: float, low: float, high: float, by: Sequence[str] = (), at: str = "x"
) -> DataFrame:
    """Smallest and largest anchor strictly inside ``(low, high)`` whose slope is strictly within ``eps`` of zero.

    ``at`` is the end of a step that stands for it: ``x`` (left) or ``right``.
    """
    flat = F.when((F.abs("slope") < eps) & (F.col(at) > low) & (F.col(at) < high), F.col(at))
    return slopes.groupBy(*by).agg(F.min(flat).alias("plateau_low"), F.max(flat).alias("plateau_high"))
