"""All registered queries."""

from __future__ import annotations

from vitagrain.catalog import activity, audits, coverage, profiles, tables, texts

CATALOGS = [coverage.catalog, profiles.catalog, audits.catalog, texts.catalog,
            activity.catalog, tables.catalog]


def queries():
    return {name: fn for c in CATALOGS for name, fn in c.queries.items()}


def oracle_sql():
    return {name: sql for c in CATALOGS for name, sql in c.oracles.items()}
