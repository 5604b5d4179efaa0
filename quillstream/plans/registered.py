"""All registered queries and their SQL: importing a catalogue registers its queries."""

from __future__ import annotations

from . import catalogue_bundles, catalogue_landing, catalogue_records, catalogue_reports, catalogue_tagging
from .catalogue import QUERIES, SQL

assert all(m.QUERIES is QUERIES for m in (catalogue_bundles, catalogue_landing, catalogue_records, catalogue_reports, catalogue_tagging))
__all__ = ["QUERIES", "SQL"]
