"""All core queries and their oracle SQL, gathered from the plan modules."""

from __future__ import annotations

from postmill.plans import core, more, records

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _module in (core, more, records):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
