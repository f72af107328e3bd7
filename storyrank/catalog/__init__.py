"""Named queries, each with the SQL that must give the same rows where SQL can say it."""

from storyrank.catalog.registry import ORACLES, QUERIES  # noqa: F401


def load() -> None:
    """Import every catalog module so that its queries are registered."""
    from storyrank.catalog import (  # noqa: F401
        q_sources, q_tables, q_filters, q_text, q_signals, q_joins, q_aggregates,
 q_windows, q_render, q_jobs, q_streams, q_functions,
    )
