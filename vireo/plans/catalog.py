"""Named queries over the driver tables and, where SQL can express them, the same query as DuckDB SQL."""

from __future__ import annotations

from vireo.plans import image_queries, library_queries, pixel_queries, report_queries, signal_queries, source_queries, table_queries, video_queries

FLAGSHIP = "image_score"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (pixel_queries, image_queries, signal_queries, video_queries, table_queries, source_queries, report_queries, library_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
