"""Evaluation operators: matching metrics, rank metrics, perturbation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.names import name_match
from loomgraph.operators.ranking import placed
from loomgraph.sources.snapshots import stored


def matched(predicted: DataFrame, gold: DataFrame, group: str) -> DataFrame:
    """(group, p, g): one-to-one matches of predicted names to gold names, both given as (group, pos, name); the group's
    column is called neither p nor g.

    Predictions choose in their order, each the first gold name that it matches and no earlier one took.  That is a
    stable pairing in which both sides prefer what comes first, so it is found in rounds: every free prediction asks for
    its first free match, every gold name takes the first that asks, and the rest go on.  The rounds end when none asks.
    """
    pairs = predicted.select(group, F.col("pos").alias("p"), F.col("name").alias("a")).join(
        gold.select(group, F.col("pos").alias("g"), F.col("name").alias("b")), group).where(name_match(F.col("a"), F.col("b"))).select(group, "p", "g")
    pairs = stored(pairs, "matches")
    taken = None
    while True:
        free = pairs
        if taken is not None:
            free = free.join(taken.select(group, "p"), [group, "p"], "left_anti").join(taken.select(group, "g"), [group, "g"], "left_anti")
        # a prediction settles once no earlier one can still want its first free match
        asks = free.groupBy(group, "p").agg(F.min("g").alias("g"))
        wanted = free.groupBy(group, "g").agg(F.min("p").alias("first"))
        now = stored(asks.join(wanted, [group, "g"]).where("p = first").select(group, "p", "g"), "taken")
        if now.isEmpty():
            return taken if taken is not None else now
        taken = now if taken is None else stored(taken.union(now), "taken")


def precision_recall(predicted: DataFrame, gold: DataFrame, group: str) -> DataFrame:
    """Per group: predicted and gold names, true positives, precision, recall and F1 of one-to-one matching in order.

    predicted and gold hold (group, pos, name).  Without predictions precision is 0; without gold recall is 0.
    """
    def size(df, name):
        return df.where("name IS NOT NULL").groupBy(group).agg(F.count("*").alias(name))

    tp = matched(predicted, gold, group).groupBy(group).agg(F.count("*").alias("tp"))
    rows = size(predicted, "predicted").join(size(gold, "gold"), group, "full").join(tp, group, "left").fillna(0, ["predicted", "gold", "tp"])
    precision, recall = (F.when(F.col(n) > 0, F.col("tp") / F.col(n)).otherwise(0.0) for n in ("predicted", "gold"))
    return rows.select(
        group, "predicted", "gold", "tp", precision.alias("precision"), recall.alias("recall"),
        F.when(F.col("tp") > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("f1"))


def spearman(rows: DataFrame, group: str, a: str, b: str, tie: str) -> DataFrame:
    """Rank correlation a group by the difference formula on ordinal ranks, ties broken by a key; 0 under two rows."""
    points = rows.select(group, a, b, tie)
    first = placed(points, [group], [F.col(a), F.col(tie)], "ra")
    ranked = placed(first, [group], [F.col(b), F.col(tie)], "rb")
    d, n = (F.col("ra") - F.col("rb")).cast("long"), F.count("*").cast("double")
    return ranked.groupBy(group).agg(
        F.count("*").alias("n"), F.when(n < 2, 0.0).otherwise(F.round(1 - 6 * F.sum(d * d) / F.nullif(n * (n * n - 1), F.lit(0.0)), 6)).alias("rho"))


def perturb(edges: DataFrame, percent: int, seed: str, buckets: int = 64) -> DataFrame:
    """Edges (src, dst) with the dst of exactly round(percent * n / 100) of them dealt anew among themselves: both degree
    multisets stay.

    The edges with the least hashes of seed and edge move, and their ends turn by one along the order of hashes.  The
    order is cut into `buckets` ranges of the hash, which grow with the data if the caller says so: counts of ranges give
    each its first place, and a range's last edge takes its end from the first of the next.
    """
    n = edges.count()
    k = round(percent * n / 100)
    keyed = edges.withColumn("h", F.md5(F.concat_ws("|", F.lit(seed), F.col("src").cast("string"), F.col("dst").cast("string")).cast("binary")))
    part = F.floor(F.conv(F.substring("h", 1, 6), 16, 10).cast("long") * buckets / 16**6).cast("int")
    keyed = keyed.withColumn("part", part)
    sizes = keyed.groupBy("part").agg(F.count("*").alias("size"))  # `buckets` rows
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = keyed.join(F.broadcast(sizes.select("part", before.alias("before"))), "part")
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("h", "src", "dst"))
    placed = placed.select("src", "dst", place.alias("place"))
    ends = placed.where(F.col("place") <= k).select((F.pmod(F.col("place") - 2, F.lit(max(k, 1))) + 1).alias("place"), F.col("dst").alias("new"))
    out = placed.join(ends, "place", "left")
    return out.select("src", F.coalesce("new", "dst").alias("dst"), (F.col("place") <= k).alias("moved"))


