"""Every registered query of the market-data side, with its SQL."""

from __future__ import annotations

from quaystone.plans import book_queries, crowd_queries, definition_queries, desk_queries, indicator_queries, label_queries, market_queries, more_queries, pair_queries, product_queries, report_queries, research_queries, roll_queries, segment_queries, signal_queries, store_queries, stream_queries, target_queries, window_queries

MODULES = (market_queries, store_queries, indicator_queries, window_queries, research_queries, more_queries, roll_queries, signal_queries, segment_queries, definition_queries, stream_queries, desk_queries, target_queries, pair_queries, label_queries, product_queries, book_queries, crowd_queries, report_queries)
FLAGSHIP = "ind_bbands"


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
