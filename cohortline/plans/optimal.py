"""Which range of an exposure goes with the lowest risk: many smooth models, their curves and plateaus."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.operators.model import Formula, SmoothLogit, curve_slope, effect_curves, fit_smooth_logits

# Where a plateau of each pressure is looked for, and the slopes taken as flat.
PLATEAU_BOUNDS = {"ibp_mean": (60, 90), "ibp_systolic": (100, 140), "ibp_diastolic": (40, 70)}
LINK_SLOPE = 0.01
PROBABILITY_SLOPES = (0.1, 0.2)


def formulas(
    outcomes: Sequence[str], exposures: Sequence[str], adjust: Sequence[str], linear: Sequence[str] = ()
) -> dict[str, Formula]:
    """``<outcome>~<exposure>`` -> formula with the exposure and the adjusting covariates as smooth terms."""
    return {f"{o}~{e}": Formula(o, (e, *adjust), tuple(linear)) for o in outcomes for e in exposures}


def optimal_ranges(
    df: DataFrame,
    outcomes: Sequence[str],
    bounds: Mapping[str, tuple[float, float]],
    adjust: Sequence[str],
    linear: Sequence[str] = (),
    reference: Mapping[str, float] | None = None,
    step: float = 1.0,
) -> DataFrame:
    """One row per outcome, exposure and flatness limit: the plateau of the adjusted curve.

    ``bounds`` gives the exposures and where to look. All models are fitted together; their curves are
    stacked, on the link scale (slope below 0.01) and on the probability scale (below 0.1 and 0.2
    percentage points per unit), and reduced in one grouping. A step of the curve stands at its right end on the link
    scale and at its left end on the probability scale.
    """
    fitted = fit_smooth_logits(df, formulas(outcomes, list(bounds), adjust, linear))
    scales = F.array(
        F.struct(F.lit("link").alias("scale"), F.col("fit").alias("y")),
        F.struct(F.lit("probability").alias("scale"), (F.col("prob") * 100).alias("y")),
    )
    long = curves(df, fitted, reference).select("model", "x", F.explode(scales).alias("s"))
    slopes = curve_slope(long.select("model", "s.scale", "x", "s.y"), "x", "y", step, 1.0, ["model", "scale"])
    name = F.split(F.col("model"), "~")
    limits = F.when(F.col("scale") == "link", F.array(F.lit(LINK_SLOPE))).otherwise(
        F.array(*[F.lit(e) for e in PROBABILITY_SLOPES])
    )
    limited = slopes.select(
        name[0].alias("outcome"), name[1].alias("exposure"), "scale", F.explode(limits).alias("slope_below"), "slope",
        F.when(F.col("scale") == "link", F.col("right")).otherwise(F.col("x")).alias("x"),
    )
    inside = reduce(
        lambda a, b: a | b,
        [(F.col("exposure") == e) & (F.col("x") > low) & (F.col("x") < high) for e, (low, high) in bounds.items()],
    )
    flat = F.when(inside & (F.abs("slope") < F.col("slope_below")), F.col("x"))
    return limited.groupBy("outcome", "exposure", "scale", "slope_below").agg(
        F.min(flat).alias("plateau_low"), F.max(flat).alias("plateau_high")
    )


def curves(df: DataFrame, models: Mapping[str, SmoothLogit], reference: Mapping[str, float] | None = None) -> DataFrame:
    """The adjusted curve of every model's first smooth term, long: ``model, x, fit, se, lcl, prob, ucl``."""
    return effect_curves(models, df, {n: m.smooths[0].column for n, m in models.items()}, reference)
