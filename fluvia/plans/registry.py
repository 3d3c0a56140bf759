"""All queries of the library, by name, and their SQL."""

from __future__ import annotations

from fluvia.plans import base, domain, history, relational, reports, scalars, upkeep  # noqa: F401  modules register their queries


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
