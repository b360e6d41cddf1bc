"""Registered queries over the given tables, with their SQL where there is one."""

from queries import analyses, forecasts, profiles

_MODULES = (profiles, analyses, forecasts)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
