"""All queries of the library (without the optional subpackage) and their SQL, by name."""

from __future__ import annotations

from tracklark.plans import cover_queries, fold_sql, lane_queries, map_queries, more_queries, pair_queries, queries, road_queries, run_queries

MODULES = [queries, more_queries, road_queries, run_queries, map_queries, lane_queries, cover_queries, pair_queries]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()} | fold_sql.SQL
