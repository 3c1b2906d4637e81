"""All queries over the supplied tables, with their SQL: importing the plans registers them."""

from __future__ import annotations

from customsloom.plans import activity, display, documents, entities, identity, invoices, knowledge, languages, matching, places, pricing, quality, repair, rollups, sheets, shipment  # noqa: F401
from customsloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
