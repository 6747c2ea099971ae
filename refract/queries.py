"""All registered queries of the engine; importing the plan modules fills the registry."""

from __future__ import annotations

from .plans import files, labels, media, origin, provenance, ranges, relational, rules, scalars, signal, text  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
