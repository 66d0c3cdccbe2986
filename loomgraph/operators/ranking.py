"""Places in an order within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.sources.snapshots import stored


def placed(rows: DataFrame, group: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """Rows with their place (from 1) in the order of their group, as row_number gives it, whatever the size of a group.

    The order must be total within a group.  Rows are cut into ranges of (group, order) and written once, so that a group
    that is a third of the table lies in a third of the ranges; a row's place is that in its range and the number of rows
    of its group in earlier ranges.  Of those numbers there are at most as many as groups and ranges together.  The
    order may use columns that rows hold under the given names; `name`, `_range` and `_before` are overwritten.  A null
    key is a group; an empty table gives none.
    """
    keys = [F.col(c) for c in group]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = stored(rows.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = kept.groupBy(*group, "_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    names = [f"_k{i}" for i in range(len(group))]
    before = before.select(*[F.col(c).alias(k) for c, k in zip(group, names, strict=True)], F.col("_range").alias("_r"), "_before")
    within = kept.withColumn(name, F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order)))
    same = F.col("_range") == F.col("_r")
    for c, k in zip(group, names, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(k))
    met = within.join(before, same)
    return met.withColumn(name, (F.col(name) + F.col("_before")).cast("int")).drop("_range", "_r", "_before", *names)
