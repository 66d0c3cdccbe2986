"""Where plans over the graph register under a name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from loomgraph.sources.projection import Graph

Plan = Callable[[Graph], DataFrame]


class Registry(dict):
    """name -> (plan, SQL after the graph's common tables, or None where SQL can't say it)."""

    def entry(self, name: str, sql: str | None):
        def keep(plan: Plan) -> Plan:
            self[name] = (plan, sql)
            return plan

        return keep
