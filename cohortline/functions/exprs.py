"""Column builders. Nothing here touches data: every function returns a ``Column``."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what counts as numeric text.
NUMERIC_TEXT = r"^-?[0-9]+\.?[0-9]*$"
INTEGER_TEXT = r"^[0-9]{0,5}$"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ladder(rungs: Sequence[tuple[Column, object]], otherwise: object = None) -> Column:
    """Ordered CASE: the first rung whose predicate is true gives the value."""
    predicate, value = rungs[0]
    out = F.when(predicate, value)
    for predicate, value in rungs[1:]:
        out = out.when(predicate, value)
    return out.otherwise(otherwise)


def flag(predicate: Column) -> Column:
    """1 where true, 0 where false or unknown."""
    return F.when(predicate, 1).otherwise(0)


def any_of(predicates: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, predicates)


def all_of(predicates: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates)


def in_list(col: Column | str, values: Sequence) -> Column:
    """Membership in a literal list. Spark hashes lists above ten entries, so no join is needed."""
    return _c(col).isin(list(values))


def is_numeric(col: Column | str, pattern: str = NUMERIC_TEXT) -> Column:
    return _c(col).rlike(pattern)


def to_number(col: Column | str, pattern: str = NUMERIC_TEXT) -> Column:
    """Numeric text as double, NULL for anything else (safe under ANSI mode)."""
    return F.when(is_numeric(col, pattern), _c(col).try_cast("double"))


def like_any(col: Column | str, patterns: Sequence[str], ci: bool = False) -> Column:
    target = _c(col)
    return any_of([target.ilike(p) if ci else target.like(p) for p in patterns])


def starts_with_any(col: Column | str, prefixes: Sequence[str]) -> Column:
    return any_of([_c(col).startswith(p) for p in prefixes])


def categorize(rules: Sequence[tuple[Column, str]], default: str | None = None) -> Column:
    """First matching rule names the category."""
    return ladder([(p, F.lit(v)) for p, v in rules], F.lit(default))


def mask_range(
    value: Column | str,
    low: float | None = None,
    high: float | None = None,
    low_closed: bool = False,
    high_closed: bool = False,
) -> Column:
    """The value where it is plausible, NULL elsewhere."""
    v = _c(value)
    tests = []
    if low is not None:
        tests.append(v >= low if low_closed else v > low)
    if high is not None:
        tests.append(v <= high if high_closed else v < high)
    return F.when(all_of(tests), v) if tests else v


def mask_by_item(item: Column | str, value: Column | str, ranges: Mapping) -> Column:
    """Per-item plausibility: ``{item: (low, high)}``, both ends open; other items give NULL."""
    out = None
    for key, (low, high) in ranges.items():
        test = (_c(item) == key) & (_c(value) > low) & (_c(value) < high)
        out = F.when(test, _c(value)) if out is None else out.when(test, _c(value))
    return out


def convert(value: Column | str, rules: Sequence[tuple[Column, Column]]) -> Column:
    """Unit conversion: the first rule that applies, else the value unchanged."""
    return ladder(rules, _c(value))


def nullif_zero(col: Column | str) -> Column:
    return F.nullif(_c(col), F.lit(0))


def not_error(col: Column | str) -> Column:
    """Rows not marked as error; a missing mark is fine."""
    return F.coalesce(_c(col), F.lit(0)) == 0


def complement(col: Column | str) -> Column:
    return F.lit(1) - _c(col)


def logistic(col: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(col)))


def body_mass_index(weight: Column | str, height_cm: Column | str) -> Column:
    return _c(weight) / F.pow(F.nullif(_c(height_cm), F.lit(0.0)) / 100.0, F.lit(2.0))


def micros_between(start: Column | str, end: Column | str) -> Column:
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end))


def minutes_between(start: Column | str, end: Column | str) -> Column:
    return micros_between(start, end) / F.lit(60_000_000.0)


def hours_between(start: Column | str, end: Column | str) -> Column:
    return micros_between(start, end) / F.lit(3_600_000_000.0)


def epoch_micros(ts: Column | str) -> Column:
    """Zone-less timestamp as a long, usable in RANGE frames."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), _c(ts).cast("timestamp_ntz"))


def floor_div(value: Column, width: int | Column) -> Column:
    """Integer floor division that also floors below zero."""
    w = F.lit(width) if isinstance(width, int) else width
    return F.floor((value - F.pmod(value, w)) / w).cast("long")


def two_sided_p(z: Column) -> Column:
    """Two-sided normal tail, rational approximation 26.2.17 of Abramowitz & Stegun (error < 7.5e-8)."""
    a = F.abs(z)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.lit(2.0) * F.exp(-a * a / 2.0) / F.lit(2.5066282746310002) * poly
