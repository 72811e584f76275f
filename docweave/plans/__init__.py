"""Registered queries over the test tables, each with its SQL equivalent."""

from __future__ import annotations


def load() -> tuple[dict, dict]:
    """All registered queries, and the SQL of those that have one."""
    from docweave.plans import more, registry, relational, scalars, search  # noqa: F401  the modules register themselves

    return registry.QUERIES, registry.ORACLE
