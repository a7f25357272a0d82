"""All registered queries and their SQL."""

from __future__ import annotations

from waymark.plans import estimation, evaluation, motion, reports, training

MODULES = (motion, evaluation, estimation, reports, training)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
