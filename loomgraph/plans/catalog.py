"""All queries over the driver's tables by name, and their SQL for a second engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.plans import assembly, hierarchies, linkers, named, nominate, recovery, regions, reports, resolution, review, states, tables, validate
from loomgraph.plans.oracle import on_graph
from loomgraph.sources.projection import project

Query = Callable[[SparkSession, str], DataFrame]


GROUPS = (named, validate, nominate, reports, tables, linkers, assembly, review, regions, hierarchies, states, resolution, recovery)


def entries() -> dict:
    return {name: pair for group in GROUPS for name, pair in group.ENTRIES.items()}


def single_tables() -> dict:
    return tables.TABLES | linkers.TABLES | regions.TABLES | hierarchies.TABLES | states.TABLES | resolution.TABLES


def _graph_query(plan) -> Query:
    return lambda spark, sf_dir: plan(project(spark, sf_dir))


def queries() -> dict[str, Query]:
    found = {name: _graph_query(plan) for name, (plan, _) in entries().items()}
    return found | {name: query for name, (query, _) in single_tables().items()}


def oracle_sql() -> dict[str, str]:
    found = {name: on_graph(sql) for name, (_, sql) in entries().items() if sql}
    return found | {name: sql for name, (_, sql) in single_tables().items() if sql}
