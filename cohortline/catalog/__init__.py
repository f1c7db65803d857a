"""Every operator and pipeline run over the supplied tables, each with the SQL it must agree with."""

from cohortline.catalog import cohorts, drugs, intervals, joins, kidney, models, readings, scalars, scores, statistics, tables  # noqa: F401
from cohortline.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
