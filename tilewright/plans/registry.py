"""All queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from . import contour_queries, file_queries, generator_queries, geometry_queries, lookup_queries, mask_queries, region_queries, repair_queries, session_queries, tile_queries, track_queries, transform_queries

_ALL = {}
for _module in (region_queries, mask_queries, geometry_queries, track_queries, session_queries, lookup_queries, repair_queries, tile_queries, contour_queries, file_queries, transform_queries, generator_queries):
    _ALL |= _module.QUERIES

QUERIES = {name: pair[0] for name, pair in _ALL.items()}
ORACLE_SQL = {name: pair[1] for name, pair in _ALL.items() if pair[1]}
FLAGSHIP = "G10_global_regions"
