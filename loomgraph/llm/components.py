"""Connected components by label passing with pointer jumping, in tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import discard, materialize, skew_join


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) for every vertex of edges (a, b); component is the smallest vertex reachable.

    Each round gives a vertex the least label among itself and its neighbours, then follows that label once.  Labels
    only fall, so it ends; a round changes some label or is the last.  A vertex with a large share of the edges, or a
    label with a large share of the vertices, is joined apart (skew_join).  Nothing but counts reaches the driver.  Loops
    (a = b) are no edges; an empty input gives an empty result.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct()
    both = materialize(both, "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree")).select(
        F.col("a").alias("vertex"), F.least("a", "m").alias("component"), "degree"), "labels")
    while True:
        near = skew_join(both, labels.withColumnRenamed("vertex", "b"), ["b"], "degree").groupBy("a").agg(F.min("component").alias("m"))
        step = materialize(labels.join(near, labels.vertex == near.a).select(
            "vertex", "degree", F.col("component").alias("old"), F.least("component", "m").alias("mid")), "steps")
        # labels that are asked for, with the number of vertices that ask
        asked = step.groupBy("mid").agg(F.count("*").alias("times"))
        jump = materialize(asked.join(step.select(F.col("vertex").alias("mid"), F.col("mid").alias("next")), "mid"), "jumps")
        found = materialize(skew_join(step, jump, ["mid"], "times").select(
            "vertex", F.least("mid", "next").alias("component"), "degree", (F.least("mid", "next") < F.col("old")).alias("changed")), "labels")
        discard(labels, step, jump)
        labels = found.select("vertex", "component", "degree")
        if not found.where("changed").limit(1).count():
            discard(both)
            return labels.select("vertex", "component")
