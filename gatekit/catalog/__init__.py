"""Named queries over the driver tables."""

from . import comparisons, explanations, paths_streams, preparation, reports, routes, rules_stats, scoring, selecting, sweeping  # noqa: F401
from .registry import SPARK, SQL

__all__ = ["SPARK", "SQL"]
