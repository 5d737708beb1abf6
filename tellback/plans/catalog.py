"""All queries, in one place. Importing a plans module registers its queries."""

from __future__ import annotations

from tellback.plans import benchmark, delivery, facts, logs, pages, recognition, sites, texts  # noqa: F401
from tellback.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
