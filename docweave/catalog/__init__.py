"""Registered queries with the SQL that checks them."""

from docweave.catalog import (  # noqa: F401
    analytics,
    events,
    extraction,
    intake,
    learning,
    prediction,
    recognition,
    relational,
    stores,
    streams,
    textprep,
)
from docweave.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
