"""Graph hops as joins: the pieces that the named queries are put together from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.sources.projection import Graph, active, primary


def micro(c: Column) -> Column:
    """A number in millionths as an integer, for exact text."""
    return F.round(c * 1_000_000).cast("long")


def edge(df: DataFrame, src: str, dst: str, **columns: str) -> DataFrame:
    """An edge table with its ends, and the named columns, renamed."""
    return df.select(F.col("src").alias(src), F.col("dst").alias(dst), *[F.col(c).alias(a) for a, c in columns.items()])


def node(df: DataFrame, key: str, as_key: str, **columns: str) -> DataFrame:
    return df.select(F.col(key).alias(as_key), *[F.col(c).alias(a) for a, c in columns.items()])


def claims(g: Graph) -> DataFrame:
    """Active (source_id, source, malady, tt) claims."""
    return edge(g.treats, "source_id", "malady", tt="confidence").join(
        node(active(g.source), "source_id", "source_id", source="name"), "source_id"
    ).join(node(active(g.malady), "name", "malady"), "malady")


def source_compounds(g: Graph) -> DataFrame:
    """(compound_id, source_id, ex, ex_type)."""
    return edge(g.extracted, "compound_id", "source_id", ex="confidence", ex_type="evidence_type")


def compound_targets(g: Graph) -> DataFrame:
    return edge(g.targets, "compound_id", "target_id", tgt="confidence", tgt_type="evidence_type", pchembl="pchembl")


def target_diseases(g: Graph) -> DataFrame:
    return edge(g.relates, "target_id", "disease_id", rel="confidence", rel_type="evidence_type")


def mapped(g: Graph, strict: bool = False) -> DataFrame:
    """(malady, disease_id, mp) primary mappings."""
    return edge(primary(g.maps, strict), "malady", "disease_id", mp="confidence", mp_source="mapping_source")


def closed_paths(g: Graph) -> DataFrame:
    """Claims joined with the paths that end in the claim's primary disease: the cycle closes on two keys.

    Claims and mappings meet first, then the compounds of their sources: so each compound asks for the diseases it is
    wanted for, and only these meet what its targets relate to.  No path is built that closes no loop.
    """
    wanted = claims(g).join(mapped(g), "malady").join(
        node(active(g.disease), "disease_id", "disease_id", disease="name"), "disease_id")
    asked = source_compounds(g).join(wanted, "source_id")
    return asked.join(compound_diseases(g), ["compound_id", "disease_id"])


def compound_diseases(g: Graph) -> DataFrame:
    """(compound_id, disease_id) by way of a target, with both edges."""
    return compound_targets(g).join(target_diseases(g), "target_id")


def with_compound(g: Graph, df: DataFrame, **columns: str) -> DataFrame:
    return df.join(node(g.compound, "compound_id", "compound_id", **(columns or {"compound": "name"})), "compound_id")


def with_target(g: Graph, df: DataFrame, **columns: str) -> DataFrame:
    return df.join(node(g.target, "target_id", "target_id", **(columns or {"target": "name"})), "target_id")


def degree(g: Graph, label: str) -> DataFrame:
    """(id, degree) over all edges at the nodes of a label, in either direction, archived or not."""
    frames = {"source": [(g.extracted, "dst"), (g.treats, "src"), (g.prepared, "src")], "malady": [(g.treats, "dst"), (g.maps, "src")],
              "compound": [(g.extracted, "src"), (g.targets, "src"), (g.known, "src")], "target": [(g.targets, "dst"), (g.relates, "src")],
              "disease": [(g.maps, "dst"), (g.relates, "dst"), (g.known, "dst")]}[label]
    parts = [df.groupBy(F.col(c).alias("id")).agg(F.count("*").alias("n")) for df, c in frames]
    out = parts[0]
    for other in parts[1:]:
        out = out.unionByName(other)
    return out.groupBy("id").agg(F.sum("n").alias("degree"))
