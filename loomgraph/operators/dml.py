"""Graph mutations as pure functions from tables to new tables: a snapshot in, the next snapshot out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filled(c: str | Column) -> Column:
    """The value, with the empty text as null."""
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by key; a value of new that isn't null replaces the old one.  new has one row a key.
    `created` tells rows that old did not have."""
    hit = old.withColumn("_old", F.lit(True)).alias("o").join(new.alias("n"), [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    columns = [F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys]
    for c in old.columns:
        if c not in keys:
            columns.append((F.coalesce(f"n.{c}", f"o.{c}") if c in new.columns else F.col(f"o.{c}")).alias(c))
    return hit.select(*columns, F.col("_old").isNull().alias("created"))


def with_endpoints(edges: DataFrame, sources: DataFrame, source_key: str, targets: DataFrame, target_key: str) -> DataFrame:
    """Edges whose two ends exist."""
    return edges.join(sources.select(F.col(source_key).alias("src")), "src", "left_semi").join(
        targets.select(F.col(target_key).alias("dst")), "dst", "left_semi")


def merge_edges(edges: DataFrame, new: DataFrame, sources: DataFrame, source_key: str, targets: DataFrame, target_key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Upsert edges (src, dst, ...) and both their ends: the edges, and the two node tables with the ends that were missing
    (their other columns null)."""
    def grown(nodes, key, end):
        fresh = new.select(F.col(end).alias(key)).where(F.col(key).isNotNull()).distinct().join(nodes.select(key), key, "left_anti")
        return nodes.unionByName(fresh, allowMissingColumns=True)

    return upsert(edges, new, ["src", "dst"]), grown(sources, source_key, "src"), grown(targets, target_key, "dst")


def set_edge_properties(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Update existing edges only, by both ends."""
    fresh = new.select("src", "dst", *[F.col(c).alias(f"_{c}") for c in columns])
    out = old.join(fresh, ["src", "dst"], "left")
    return out.select("src", "dst", *[
        (F.coalesce(f"_{c}", c) if c in columns else F.col(c)).alias(c) for c in old.columns if c not in ("src", "dst")])


def in_batches(rows: DataFrame, key: str, size: int = 500) -> DataFrame:
    """Rows with the batch they are sent in: hashed by key into as many batches as hold about `size` rows each."""
    return rows.withColumn("batch", F.pmod(F.xxhash64(key), F.lit(max(1, -(-rows.count() // size)))))


def detach_delete(nodes: DataFrame, key: str, gone: DataFrame, edges: dict[str, tuple[DataFrame, str]]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Delete nodes with all their edges; edges are named (table, the end that points to the node)."""
    left = delete(nodes, gone, [key])
    return left, {name: df.join(gone.select(F.col(key).alias(end)).distinct(), end, "left_anti") for name, (df, end) in edges.items()}


def backfill(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Fill only null or empty values of old from new (one row a key)."""
    fresh = new.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    out = old.join(fresh, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(filled(c), F.col(f"_{c}"))).drop(f"_{c}")
    return out


def delete(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def set_properties(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Update existing rows only."""
    fresh = new.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    out = old.join(fresh, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return out


def clear_properties(old: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        old = old.withColumn(c, F.lit(None).cast(old.schema[c].dataType))
    return old


def archive(nodes: DataFrame, gone: DataFrame, key: str, reason: str) -> DataFrame:
    """Soft delete with a reason; what was archived before keeps its own."""
    flagged = nodes.join(gone.select(key).distinct().withColumn("_gone", F.lit(True)), key, "left")
    was = F.coalesce("archived", F.lit(False))
    hit = F.coalesce("_gone", F.lit(False)) & ~was
    return flagged.withColumn("archive_reason", F.when(hit, reason).otherwise(F.col("archive_reason"))).withColumn(
        "archived", F.when(hit, True).otherwise(F.col("archived"))).drop("_gone")


def cascade(edges: DataFrame, gone: DataFrame, key: str, end: str) -> DataFrame:
    """Edges with an `archived` flag set where their end is among the keys."""
    hit = gone.select(F.col(key).alias(end)).distinct().withColumn("archived", F.lit(True))
    return edges.join(hit, end, "left").withColumn("archived", F.coalesce("archived", F.lit(False)))


def retarget(edges: DataFrame, merged: DataFrame, value: str = "confidence") -> DataFrame:
    """Move outgoing edges of merged nodes (old, keeper) to their keepers; of edges that fall together the larger
    value stays, null counting least.  moved_from lists where the kept edge came from, smallest id on ties."""
    moved = edges.join(merged.select(F.col("old").alias("src"), "keeper"), "src", "left")
    best = F.max(F.struct(value, F.when(F.col("keeper").isNull(), 1).otherwise(0).alias("own"), (-F.col("src")).alias("least"))).alias("b")
    return moved.groupBy(F.coalesce("keeper", "src").alias("src"), "dst").agg(best).select(
        "src", "dst", F.col(f"b.{value}").alias(value), F.when(F.col("b.own") == 0, -F.col("b.least")).alias("moved_from"))


def alias_union(nodes: DataFrame, group: list[str], name: str) -> DataFrame:
    """The other names of each group besides its keeper (the smallest name), sorted."""
    names = F.array_sort(F.collect_set(name))
    return nodes.groupBy(*group).agg(names.alias("names")).select(
        *group, F.col("names")[0].alias("keeper"), F.array_except("names", F.array(F.col("names")[0])).alias("aliases"))


def united_aliases(nodes: DataFrame, merged: DataFrame) -> DataFrame:
    """(source_id, name, aliases, merged) of each keeper of merged (old, keeper) among nodes (source_id, name, aliases): its
    own aliases with the names and aliases of all that were merged into it, without its own name, sorted; and their number."""
    old = merged.join(nodes.withColumnRenamed("source_id", "old"), "old")
    brought = old.select("keeper", F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("name")).alias("some"), F.lit(1).alias("one"))
    own = nodes.join(merged.select("keeper").distinct(), F.col("source_id") == F.col("keeper")).select("keeper", F.col("aliases").alias("some"), F.lit(0).alias("one"))
    every = brought.unionByName(own)
    names = every.select("keeper", F.explode("some").alias("alias")).where("alias IS NOT NULL").distinct()
    sizes = every.groupBy("keeper").agg(F.sum("one").alias("merged"))
    keepers = nodes.select(F.col("source_id").alias("keeper"), "name").join(sizes, "keeper")
    found = names.join(keepers.select("keeper", "name"), "keeper").where("alias <> name").groupBy("keeper").agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    return keepers.join(found, "keeper", "left").select(F.col("keeper").alias("source_id"), "name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "merged")
