"""Registered queries over the driver's tables, each beside the SQL that checks it."""

from __future__ import annotations

from parcelgrid.queries.registry import ORACLES, QUERIES
from parcelgrid.queries import (  # noqa: F401  (importing registers)
    aggregates, evaluation, ingest, joins, models, scalars, text)

__all__ = ["ORACLES", "QUERIES"]
