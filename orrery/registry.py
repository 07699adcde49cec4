"""Names of all queries, with the SQL that checks them."""

from __future__ import annotations

from orrery.plans import lenses, modules, notes, proofs, structure, surface  # noqa: F401  register their queries
from orrery.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
