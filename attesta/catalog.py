"""All registered queries and their SQL oracles."""

from __future__ import annotations

from attesta.plans import activity, content, sites


def queries() -> dict:
    return {**content.QUERIES, **activity.QUERIES, **sites.QUERIES}


def oracle_sql() -> dict:
    return {**content.ORACLES, **activity.ORACLES, **sites.ORACLES}
