"""What holds of a graph's tables: keys that are there and unique, edges whose ends exist."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_report(table: DataFrame, name: str, key: list[str]) -> DataFrame:
    """(name, rule, n): rows of a table without its whole key, and rows beyond the first of a key."""
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    sizes = table.groupBy(*key).count()  # a key that many rows share is counted before it is shuffled
    counts = sizes.agg(
        F.coalesce(F.sum(F.when(~whole, F.col("count"))), F.lit(0)).alias("without_key"),
        F.coalesce(F.sum(F.when(whole, F.col("count") - 1)), F.lit(0)).alias("repeated_key"))
    return _long(counts, name)


def end_report(edges: DataFrame, name: str, ends: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """(name, rule, n): edges whose end column is null or no key of the table that it names."""
    counts = None
    for end, (nodes, key) in ends.items():
        sizes = edges.groupBy(end).count()
        lost = sizes.join(nodes.select(F.col(key).alias(end)).distinct(), end, "left_anti").agg(F.coalesce(F.sum("count"), F.lit(0)).alias(f"lost_{end}"))
        counts = lost if counts is None else counts.join(lost, how="cross")  # single rows
    return _long(counts, name)


def _long(counts: DataFrame, name: str) -> DataFrame:
    rules = F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("n")) for c in counts.columns])).alias("r")
    return counts.select(F.lit(name).alias("name"), rules).select("name", "r.rule", "r.n")
