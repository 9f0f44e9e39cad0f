"""Queries over the given tables: each applies operators of this package."""

from . import alignment, analysis, formats, regions

QUERIES = alignment.QUERIES
ORACLES = alignment.ORACLES
__all__ = ["ORACLES", "QUERIES", "alignment", "analysis", "formats", "regions"]
