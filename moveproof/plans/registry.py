"""Where plan modules register a query and, if there is one, the SQL it must equal."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(plan):
        QUERIES[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return register


MODULES = (
    "profiling", "reconciling", "naming", "drifting", "loading", "running", "assessing", "streams", "discovering",
)
