"""Registered queries: each reads the given tables, each with an equivalent SQL where one exists."""

from __future__ import annotations

from scenelake.queries import assets, cameras, contacts, curation, integrity, motion, pixels, scenarios, storage

GROUPS = (contacts, motion, pixels, cameras, assets, curation, scenarios, integrity, storage)


def all_queries() -> dict:
    return {name: fn for group in GROUPS for name, fn in group.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for group in GROUPS for name, sql in group.ORACLES.items()}
