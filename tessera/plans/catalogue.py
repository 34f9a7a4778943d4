"""All named queries over the driver tables and the SQL that checks them."""

from __future__ import annotations

from tessera.plans import cards, documents, files, flows, graph, ledger, more, times  # noqa: F401
from tessera.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
