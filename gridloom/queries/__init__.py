"""The catalogue: every query with the SQL that gives the same rows."""

from gridloom.queries import documents, layers, likeness, shapes, structure, tiled  # noqa: F401  (adds its queries)
from gridloom.queries.catalogue import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
