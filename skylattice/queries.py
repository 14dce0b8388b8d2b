"""All registered queries of the core library."""

from __future__ import annotations

from skylattice.plans import catalog_queries, ephemeris_queries, extended_queries, file_queries, name_queries, numeric_queries, series_queries, sky_queries, source_queries, spatial_queries, stats_queries, table_queries

_ALL = (spatial_queries, table_queries, stats_queries, series_queries, catalog_queries, extended_queries, source_queries, sky_queries, name_queries, numeric_queries, file_queries, ephemeris_queries)

QUERIES = {k: v for m in _ALL for k, v in m.R.queries.items()}
ORACLE = {k: v for m in _ALL for k, v in m.R.oracle.items()}
