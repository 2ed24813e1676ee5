"""The query catalogue: one entry for each operator family, with its SQL where SQL can say it."""

from __future__ import annotations

from . import colour, combinations, scrape, stats

PARTS = (colour, scrape, stats, combinations)


def queries() -> dict:
    return {q.__name__: q for part in PARTS for q in part.QUERIES}


def oracle_sql() -> dict:
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}
