"""All queries of the library proper, and their SQL twins."""

from __future__ import annotations

from . import cloud_queries, file_queries, layout_queries, scene_queries

_PARTS = (scene_queries, layout_queries, cloud_queries, file_queries)
QUERIES = {name: q for part in _PARTS for name, q in part.QUERIES.items()}
ORACLES = {name: q for part in _PARTS for name, q in part.ORACLES.items()}
