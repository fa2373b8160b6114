"""All registered queries over the driver's tables."""

from __future__ import annotations

from . import analysis, dataset, files, round_trips, serving
from .analysis import significance_table
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "analysis", "dataset", "files", "round_trips", "serving", "significance_table"]
