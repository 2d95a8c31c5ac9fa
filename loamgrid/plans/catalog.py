"""The registered queries and the SQL that each must agree with."""

from __future__ import annotations

from loamgrid.plans import evaluation, integrity, reports, signals, vision  # noqa: F401  (they register their queries)
from loamgrid.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
