"""Named queries: the engine's operators applied to the driver tables."""

from __future__ import annotations


def load() -> tuple[dict, dict]:
    """All queries and their SQL."""
    from gridwright.plans import chunks, facts, journal, network, registers, search  # noqa: F401
    from gridwright.plans.registry import QUERIES, SQL

    return QUERIES, SQL
