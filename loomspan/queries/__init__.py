"""The driver's queries, each beside its SQL."""

from importlib import import_module

QUERIES: dict = {}
ORACLE_SQL: dict = {}
FLAGSHIP = "q45_session"

for _part in ("text", "graphs", "learning", "systems", "replies"):
    _module = import_module(f"loomspan.queries.{_part}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
