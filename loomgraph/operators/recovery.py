"""What an arm of an experiment recovers of a region's known sources and compounds, as one row of measures a region."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators import metrics
from loomgraph.operators import paths as P

# fixed values: depths at which recall is taken
DEPTHS = (3, 5, 10)


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is nothing to find."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def mean_micro(value: Column) -> Column:
    """Mean over whole millionths, so that the order of addition says nothing; 0 without rows."""
    return F.coalesce(F.sum(P.micro(value)) / F.count(value) / 1_000_000, F.lit(0.0))


def first_places(predicted: DataFrame, keys: list[str], order: list[Column], deepest: int) -> DataFrame:
    """The least place of each distinct name among the first `deepest` predictions of the keys; a top-n, so no group is
    gathered whole."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return predicted.withColumn("place", nth).where(F.col("place") <= deepest)


def source_measures(named: DataFrame, gold: DataFrame, depths=DEPTHS) -> DataFrame:
    """(region, arm): precision, recall, F1 and recall at depths of sources.

    named holds (region, arm, pos, source), each source once a region and arm; gold (region, source).  A gold source is found
    at most once.  Regions or arms without predictions have no row.
    """
    known = gold.select("region", "source").distinct()
    n = known.groupBy("region").agg(F.count("*").alias("n_gold"))
    hits = named.join(known.withColumn("hit", F.lit(1)), ["region", "source"], "left").groupBy("region", "arm").agg(
        F.count("*").alias("n_named"), F.count("hit").alias("tp"), *[F.count(F.when(F.col("pos") <= k, F.col("hit"))).alias(f"h{k}") for k in depths])
    rows = hits.join(n, "region", "left").fillna(0, ["n_gold"])
    precision, recall = share(F.col("tp"), F.col("n_named")), share(F.col("tp"), F.col("n_gold"))
    return rows.select("region", "arm", precision.alias("src_precision"), recall.alias("src_recall"), f1(precision, recall).alias("src_f1"),
                       *[share(F.col(f"h{k}"), F.col("n_gold")).alias(f"src_recall_{k}") for k in depths])


def compound_measures(predicted: DataFrame, gold: DataFrame, others: DataFrame, order: list[Column], depths=DEPTHS) -> DataFrame:
    """(region, arm): recall of gold compounds and of all compounds at depths, F1 at the deepest, and recall by source.

    predicted holds (region, arm, source, compound, score, ...) in the order given, a compound maybe of several sources;
    gold and others (region, source, compound).  Recall by source looks at what an arm says of a gold source alone, and is
    the mean over the region's gold sources, those of which the arm says nothing among them.
    """
    deepest = max(depths)
    gold, known = gold.select("region", "source", "compound").distinct(), gold.select("region", "compound").distinct()
    both = known.withColumn("is_gold", F.lit(1)).unionByName(others.select("region", "compound").withColumn("is_gold", F.lit(0)))
    both = both.groupBy("region", "compound").agg(F.max("is_gold").alias("is_gold"))
    sizes = both.groupBy("region").agg(F.sum("is_gold").alias("n_gold"), F.count("*").alias("n_all"))
    tops = first_places(predicted, ["region", "arm"], order, deepest).groupBy("region", "arm", "compound").agg(F.min("place").alias("place"))
    met = tops.join(both, ["region", "compound"], "left")

    def within(k: int, test: Column) -> Column:
        return F.count_if((F.col("place") <= k) & F.coalesce(test, F.lit(False)))

    found = met.groupBy("region", "arm").agg(
        *[within(k, F.col("is_gold") == 1).alias(f"g{k}") for k in depths], *[within(k, F.col("is_gold").isNotNull()).alias(f"a{k}") for k in depths])
    attributed = first_places(predicted.join(gold.select("region", "source").distinct(), ["region", "source"], "left_semi"), ["region", "arm", "source"], order, deepest)
    attributed = attributed.groupBy("region", "arm", "source", "compound").agg(F.min("place").alias("place")).join(gold, ["region", "source", "compound"], "left_semi")
    by_source = gold.groupBy("region", "source").agg(F.count("*").alias("n"))
    strict = attributed.groupBy("region", "arm", "source").agg(*[F.count_if(F.col("place") <= k).alias(f"s{k}") for k in depths]).join(by_source, ["region", "source"])
    strict = strict.groupBy("region", "arm").agg(*[F.sum(P.micro(F.col(f"s{k}") / F.col("n"))).alias(f"s{k}") for k in depths])
    sources = by_source.groupBy("region").agg(F.count("*").alias("n_sources"))
    rows = found.join(sizes, "region", "left").join(strict, ["region", "arm"], "left").join(sources, "region", "left").fillna(0)
    recall, precision = share(F.col(f"g{deepest}"), F.col("n_gold")), F.col(f"g{deepest}") / deepest
    return rows.select(
        "region", "arm", *[share(F.col(f"g{k}"), F.col("n_gold")).alias(f"comp_recall_{k}") for k in depths], f1(precision, recall).alias(f"comp_f1_{deepest}"),
        *[share(F.col(f"a{k}"), F.col("n_all")).alias(f"comp_all_recall_{k}") for k in depths],
        *[share(F.col(f"s{k}") / 1_000_000, F.col("n_sources")).alias(f"strict_recall_{k}") for k in depths])


def brier_measures(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(region, arm): mean score, and mean squared distance of scores, forced into 0 to 1, from being gold for their source."""
    flag = gold.select("region", "source", "compound").distinct().withColumn("flag", F.lit(1.0))
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    rows = predicted.join(flag, ["region", "source", "compound"], "left")
    return rows.groupBy("region", "arm").agg(mean_micro(F.col("score")).alias("mean_score"), mean_micro(F.pow(p - F.coalesce("flag", F.lit(0.0)), 2)).alias("brier"))


def shared_rank_correlation(predicted: DataFrame, one: str, two: str) -> DataFrame:
    """(region, n_shared, spearman_shared) of the best scores that two arms give to compounds which both name."""
    best = predicted.groupBy("region", "arm", "compound").agg(F.max("score").alias("score"))
    a, b = (best.where(F.col("arm") == arm).select("region", "compound", F.col("score").alias(s)) for arm, s in ((one, "a"), (two, "b")))
    return metrics.spearman(a.join(b, ["region", "compound"]), "region", "a", "b", "compound").select("region", F.col("n").alias("n_shared"), F.col("rho").alias("spearman_shared"))


def region_rows(
    regions: DataFrame, named: DataFrame, predicted: DataFrame, gold: DataFrame, others: DataFrame, order: list[Column], arms: tuple[str, str], depths=DEPTHS
) -> DataFrame:
    """One row a region: sizes, then each measure of sources and compounds for both arms under `<arm>_<measure>`.

    regions holds (region, ...) rows that are kept as they are.  Names are compared as they stand; those to be matched loosely
    are turned into gold names by metrics.matched before.  What a region lacks counts 0.
    """
    names = gold.select("region", "compound").unionByName(others.select("region", "compound"))
    sizes = [gold.groupBy("region").agg(F.count_distinct("source").alias("n_gold_sources"), F.count_distinct("compound").alias("n_gold_compounds")),
             names.groupBy("region").agg(F.count_distinct("compound").alias("n_all_compounds"))]
    measures = [source_measures(named, gold, depths), compound_measures(predicted, gold, others, order, depths), brier_measures(predicted, gold)]
    wide = [df.select("region", *[F.when(F.col("arm") == arm, F.col(c)).alias(f"{arm}_{c}") for arm in arms for c in df.columns if c not in ("region", "arm")])
            for df in measures]
    # measures fall together by region in one aggregate, not in a join each
    parts = [*sizes, *wide, shared_rank_correlation(predicted, *arms)]
    met = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    values = [c for c in met.columns if c != "region"]
    out = regions.join(met.groupBy("region").agg(*[F.max(c).alias(c) for c in values]), "region", "left").fillna(0, values)
    delta = reduce(lambda x, y: x - y, [F.col(f"{arm}_mean_score") for arm in arms])
    return out.withColumn("n_distractor_compounds", F.col("n_all_compounds") - F.col("n_gold_compounds")).withColumn("score_delta", delta)
