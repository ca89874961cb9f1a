"""Every query of the library with its SQL twin."""

from __future__ import annotations

from .plans import aggregating, domain, joining, ordered, projection, statistics

MODULES = (projection, joining, aggregating, ordered, domain, statistics)


def queries() -> dict:
    return {name: case[0] for m in MODULES for name, case in m.CASES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: case[1] for m in MODULES for name, case in m.CASES.items() if case[1]}
