"""The registered queries over the driver's tables."""

from __future__ import annotations

from granula.plans import codec_queries, coding_queries, frame_queries, more_queries, playback_queries, registry, signal_queries  # noqa: F401  they register themselves

flagship = signal_queries.q_mdct18


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.SQL)
