"""Registered queries by name, and the SQL each is checked against."""

from . import collections, listings, relational, spatial, stored, streams, texts, tile_layers  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES

FLAGSHIP = "distance_semi_join"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
