"""All registered queries of the engine, and the SQL that they are held against."""

from __future__ import annotations

from .operators import curation, features, greedy, learned, library, matching, relational, search, similarity, tools

MODULES = (relational, curation, features, library, similarity, greedy, learned, search, tools, matching)


def queries():
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
