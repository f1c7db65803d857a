"""From the raw analysis table to the frame the models read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions import vocab
from cohortline.functions.exprs import body_mass_index, categorize, flag, ladder
from cohortline.operators.model import impute_chained, one_hot
from cohortline.operators.stats import iqr_fence
from cohortline.session import cut_lineage


def set_where(df: DataFrame, predicate: Column, col: str, value: object) -> DataFrame:
    """Masked assignment; rows where the predicate is unknown keep their value."""
    v = value if isinstance(value, Column) else F.lit(value)
    return df.withColumn(col, F.when(predicate, v).otherwise(F.col(col)))


def apply_exclusions(df: DataFrame, flags: Sequence[str], excluded: bool = False) -> DataFrame:
    """Rows with every flag false, or the complement. A missing flag counts as false."""
    hit = F.greatest(*[F.coalesce(F.col(f), F.lit(False)) for f in flags]) if len(flags) > 1 else F.coalesce(
        F.col(flags[0]), F.lit(False)
    )
    return df.filter(hit if excluded else ~hit)


def ethnicity_group(col: str = "ethnicity") -> Column:
    rules = [(F.col(col).startswith(p), p) for p in vocab.ETHNICITY_PREFIXES]
    return categorize(rules, vocab.ETHNICITY_OTHER)


def week_outcome(los_days: str, stay_outcome: Column, alive: object, days: float = 7) -> Column:
    """Alive at a week if the stay was longer, else the outcome of the stay; unknown length gives NULL."""
    los = F.col(los_days)
    return ladder([(los > days, F.lit(alive)), (los <= days, stay_outcome)], None)


def clean(
    df: DataFrame,
    key: str,
    exclusions: Mapping[str, Column],
    complete: Sequence[str],
    fills: Mapping[str, object],
    fenced: Sequence[str] = ("height_impute", "weight_impute"),
    impute: tuple[Sequence[str], Sequence[str], Sequence[str]] | None = None,
    rounds: int = 10,
    pieces: int | None = None,
) -> DataFrame:
    """Exclusions, complete pressures, fills, imputation, outlier fences, body mass index.

    ``impute`` is ``(targets, numeric inputs, categorical inputs)``; the targets must end up in the
    fenced columns. Without it the fenced columns must already be there.
    """
    marked = df.withColumns({f"exclude_{n}": F.coalesce(p, F.lit(False)) for n, p in exclusions.items()})
    kept = apply_exclusions(marked, [f"exclude_{n}" for n in exclusions]).drop(*[f"exclude_{n}" for n in exclusions])
    kept = kept.dropna(subset=list(complete))
    kept = kept.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items()})
    if impute:
        targets, numeric, categorical = impute
        # The narrow model input is read several times, so it is written once.
        narrow = cut_lineage(kept.select(key, *targets, *numeric, *categorical))
        coded = one_hot(narrow, categorical)
        features = [c for c in coded.columns if c not in (key, *targets)]
        filled = impute_chained(coded, targets, features, rounds).select(key, *[f"{t}_impute" for t in targets])
        renamed = filled.withColumnsRenamed({f"{t}_impute": f for t, f in zip(targets, fenced)})
        kept = kept.join(renamed, key, "left")
    flagged = iqr_fence(kept, fenced, pieces=pieces)
    inside = apply_exclusions(flagged, [f"{c}_outlier" for c in fenced]).drop(*[f"{c}_outlier" for c in fenced])
    height, weight = fenced[0], fenced[1]
    return inside.withColumn("bmi", body_mass_index(weight, height))


def add_outcomes(
    df: DataFrame, key: str, aki: DataFrame, los: str, outcome: str, alive: object, flags: Sequence[str]
) -> DataFrame:
    """Left join of AKI flags (absent ones 0, their maximum as ``AKI_7d``) and the 7-day outcome."""
    joined = df.join(aki, key, "left")
    joined = joined.withColumns({f: F.coalesce(F.col(f), F.lit(0)) for f in flags})
    seven = F.greatest(*[F.col(f) for f in flags]) if len(flags) > 1 else F.col(flags[0])
    return joined.withColumns({"AKI_7d": seven, "mortality_7d": week_outcome(los, F.col(outcome), alive)})


def model_frame(
    clean_df: DataFrame,
    key: str,
    renames: Mapping[str, str],
    died: Mapping[str, Column],
    vasopressor_hours: str,
    in_range: DataFrame,
    survivors_only: Column | None = None,
) -> DataFrame:
    """Names and 0/1 outcomes the models expect, vasopressor use, time in range by left join."""
    df = clean_df.withColumns({c: flag(p) for c, p in died.items()}).withColumnsRenamed(dict(renames))
    df = df.withColumn("use_vasopressor", flag(F.col(vasopressor_hours) > 0))
    if survivors_only is not None:
        df = df.filter(survivors_only)
    return df.join(in_range, key, "left")
