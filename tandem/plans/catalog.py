"""Every analytics query by name, with the SQL that it is held against."""

from __future__ import annotations

from tandem.plans import checks, evidence, impact, landing, rules, segments, text, timeline  # noqa: F401  (modules register their queries)
from tandem.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
