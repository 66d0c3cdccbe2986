"""Operator 13: hard-negative mining by distributed radix selection."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm import common

EVERY, POSITIVES, NEGATIVES = 100, 5, 10
#: a negative's score lies between these hundredths of the positive's
LOW, HIGH = 30, 90
SCALE = 256
#: bits of a digit of the score, rows of a block, and anchors of a block
DIGIT, ROWS, ANCHORS = 8, 32_768, 256


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, v): rows that take part, each id once, components as floor(256 x)."""
    parts = F.col("embedding")
    bad = F.exists(parts, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    rows = embeddings.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(~bad)
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    size = sizes["d"] if sizes else 0
    limit = min((1 << 31) - 1, math.isqrt((1 << 62) // max(size, 1)))  # so that all scores are 64-bit integers
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    v = F.transform(parts, lambda c: F.floor(c.cast("double") * SCALE))
    rows = rows.where(F.size("embedding") == size).select("vec_id", label.cast("long").alias("label"), v.alias("v"))
    rows = rows.where(F.forall("v", lambda c: F.abs(c) <= limit)).withColumn("v", F.col("v").cast("array<int>"))
    first = F.min(F.struct("label", "v")).alias("first")
    return rows.groupBy("vec_id").agg(first).select("vec_id", "first.*")


def _packed(prefix: str):
    def make(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id")
        x = np.array(rows["v"].tolist(), "<i4")
        return pd.DataFrame({"block": rows["block"].iloc[:1].to_numpy(), f"{prefix}_ids": [rows["vec_id"].to_numpy("<i8").tobytes()],
                             f"{prefix}_labels": [rows["label"].to_numpy("<i8").tobytes()], f"{prefix}_x": [x.tobytes()]})

    return make, f"block long, {prefix}_ids binary, {prefix}_labels binary, {prefix}_x binary"


def _scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products: by floating point where no partial sum can leave the whole numbers it holds exactly."""
    most = max(1, a.shape[1]) * (int(np.abs(a.astype(np.int64)).max(initial=0)) * int(np.abs(x.astype(np.int64)).max(initial=0)))
    if most < 1 << 53:
        return (a.astype(float) @ x.astype(float).T).astype(np.int64)
    return a.astype(np.int64) @ x.astype(np.int64).T


def _opened(r) -> tuple:
    ids, anchor_ids = np.frombuffer(r.row_ids, "<i8"), np.frombuffer(r.anchor_ids, "<i8")
    x, a = (np.frombuffer(c, "<i4").reshape(n, -1) if c else np.zeros((n, 0), "<i4") for c, n in ((r.row_x, len(ids)), (r.anchor_x, len(anchor_ids))))
    return anchor_ids, np.frombuffer(r.anchor_labels, "<i8"), ids, np.frombuffer(r.row_labels, "<i8"), _scores(a, x)


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, best first; of equals the first, which have the smaller ids."""
    if len(score) > k:
        bar = np.partition(score, len(score) - k)[len(score) - k]
        above = np.flatnonzero(score > bar)
        at = np.concatenate((above, np.flatnonzero(score == bar)[: k - len(above)]))
    else:
        at = np.arange(len(score))
    return at[np.lexsort((at, -score[at]))]


def _nearest_alike(k: int):
    """The k best rows of each anchor's own label in each block."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r in (r for b in batches for r in b.itertuples()):
            anchor_ids, anchor_labels, ids, labels, scores = _opened(r)
            for i, anchor in enumerate(anchor_ids):
                at = np.flatnonzero((labels == anchor_labels[i]) & (ids != anchor))
                at = at[_best(scores[i, at], k)]
                if len(at):
                    yield pd.DataFrame({"anchor_id": anchor, "positive_id": ids[at], "positive_score": scores[i, at]})

    return find


def _windows(r, anchor_ids, anchor_labels, ids, labels, scores):
    """(place in the tile's windows, ids and scores of the rows of other labels between its bounds, by id)."""
    order = np.argsort(r.w_anchor, kind="stable")
    cut = np.searchsorted(r.w_anchor[order], [anchor_ids, anchor_ids + 1])
    for i in range(len(anchor_ids)):
        mine = order[cut[0][i] : cut[1][i]]
        if not len(mine):
            continue
        s = scores[i]
        at = np.flatnonzero((labels != anchor_labels[i]) & (s >= r.w_low[mine].min()) & (s <= r.w_high[mine].max()))
        found, who = s[at], ids[at]
        for w in mine.tolist():
            inside = (found >= r.w_low[w]) & (found <= r.w_high[w])
            if inside.any():
                yield w, who[inside], found[inside]


def _histograms(shift: int):
    """Counts of the digit `shift` of high - score of each window in a tile, from the top down to the digit at which the
    tile alone has as many as are needed: the whole table's is no lower."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r in (r for b in batches for r in b.itertuples()):
            out = []
            for w, _, score in _windows(r, *_opened(r)):
                digit, n = np.unique((r.w_high[w] - score) >> shift, return_counts=True)
                upto = int(np.searchsorted(np.cumsum(n), r.w_need[w])) + 1
                out.append(pd.DataFrame({"anchor_id": r.w_anchor[w], "positive_id": r.w_positive[w], "digit": digit[:upto], "n": n[:upto]}))
            if out:
                yield pd.concat(out)

    return count


def _gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows at or above each window's least score, no more of a tile than are needed."""
    for r in (r for b in batches for r in b.itertuples()):
        out = []
        for w, who, score in _windows(r, *_opened(r)):
            at = _best(score, int(r.w_need[w]))
            out.append(pd.DataFrame({"anchor_id": r.w_anchor[w], "positive_id": r.w_positive[w], "negative_id": who[at],
                                     "positive_score": r.w_score[w], "negative_score": score[at]}))
        if out:
            yield pd.concat(out)


def mine(embeddings: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         digit: int = DIGIT, rows_a_block: int = ROWS, anchors_a_block: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (vec_id divisible by
    `every`) and each of its first `positives` rows of the same label, the first `negatives` rows of other labels whose score
    lies between low and high hundredths of the positive's.  Scores are exact integer inner products of floor(256 x); higher
    ones come first, ties by smaller id.

    Rows and anchors meet in blocks.  For each anchor-positive window the tiles count scores by their leading digit; the
    sums say which digit holds the last score wanted, the next round counts its next digit, and so on; at last only rows at
    or above that score leave the tiles.  A window's state is a few numbers in a table, a tile's answer at most as many rows
    as are wanted, whatever the number of equal scores.

    Rows without an id, label or vector, or with null or non-finite components, take no part; nor do vectors of another
    length than most (they have no inner product), or with components so large (from 2^62 / length in square) that a score
    might pass 64 bits.  Of rows that repeat an id, the one with the smallest (label, vector) counts.  A positive with a
    negative score has an empty window, one with score 0 only rows of score 0; empty vectors score 0; an empty table, or one
    without anchors, gives no rows; other columns take no part.
    """
    spark = embeddings.sparkSession
    rows = common.materialize(whole_vectors(embeddings), "vectors")
    anchors = rows.where(F.col("vec_id") % every == 0)
    n_rows, n_anchors = rows.count(), anchors.count()
    n_blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // rows_a_block))

    def blocks(df, count, prefix):
        make, schema = _packed(prefix)
        return df.withColumn("block", F.pmod(F.xxhash64(F.lit(prefix), "vec_id"), F.lit(count))).groupBy("block").applyInPandas(make, schema)

    row_blocks = common.materialize(blocks(rows, n_blocks, "row"), "row_blocks")
    anchor_block = F.pmod(F.xxhash64(F.lit("anchor"), "anchor_id"), F.lit(-(-n_anchors // anchors_a_block) or 1))
    anchor_blocks = common.materialize(blocks(anchors, -(-n_anchors // anchors_a_block) or 1, "anchor").withColumnRenamed("block", "anchor_block"), "anchor_blocks")
    every_block = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<long>"))

    def tiles(asked):
        """Each block of rows beside each block of anchors (or windows) that asks."""
        dealt = asked.withColumn("block", every_block).repartition(n_blocks, "block")
        return row_blocks.repartition(n_blocks, "block").join(dealt, "block")

    def windows(state):
        """Anchor blocks with their windows, as arrays."""
        packed = state.groupBy(anchor_block.alias("anchor_block")).agg(F.collect_list(F.struct("anchor_id", "positive_id", "positive_score", "low", "high", "need")).alias("w"))
        names = {"w_anchor": "anchor_id", "w_positive": "positive_id", "w_score": "positive_score", "w_low": "low", "w_high": "high", "w_need": "need"}
        return anchor_blocks.join(packed, "anchor_block").select("anchor_block", "anchor_ids", "anchor_labels", "anchor_x", *(F.col(f"w.{c}").alias(n) for n, c in names.items()))

    alike = tiles(anchor_blocks).mapInPandas(_nearest_alike(positives), "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    alike = alike.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= positives).drop("nth")
    # floor and ceiling of whole hundredths, as 100 score = 30 positive_score need not be whole
    bound = lambda share: F.call_function("div", F.lit(share) * F.col("positive_score"), F.lit(100))
    state = alike.where("positive_score >= 0").select(
        "*", F.when(F.col("positive_score") * low % 100 > 0, bound(low) + 1).otherwise(bound(low)).alias("low"), bound(high).alias("high"), F.lit(negatives).cast("long").alias("need"))
    state = common.materialize(state.where("low <= high"), "pairs")
    widest = state.agg(F.max(F.col("high") - F.col("low"))).first()[0] or 0

    settled = []
    for shift in range((widest.bit_length() - 1) // digit * digit, -1, -digit):
        counted = tiles(windows(state)).mapInPandas(_histograms(shift), "anchor_id long, positive_id long, digit long, n long")
        counted = counted.groupBy("anchor_id", "positive_id", "digit").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("anchor_id", "positive_id").orderBy("digit"))
        met = counted.withColumn("upto", upto).join(state.select("anchor_id", "positive_id", "need"), ["anchor_id", "positive_id"])
        holds = met.where("upto >= need AND upto - n < need").select("anchor_id", "positive_id", "digit", (F.col("upto") - F.col("n")).alias("above"))
        step = common.materialize(state.join(holds, ["anchor_id", "positive_id"], "left"), "digits")
        # too few in the whole window: all of it counts
        settled.append(step.where("digit IS NULL").select(*state.columns))
        top = F.col("high") - F.col("digit") * (1 << shift)
        state = step.where("digit IS NOT NULL").select(
            "anchor_id", "positive_id", "positive_score", F.greatest("low", top - (1 << shift) + 1).alias("low"), top.alias("high"), (F.col("need") - F.col("above")).alias("need"))
    # from the last score on, up to the window's own bound
    last = reduce(DataFrame.unionByName, settled, state).select(
        "anchor_id", "positive_id", "positive_score", "low", bound(high).alias("high"), F.lit(negatives).cast("long").alias("need"))
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    found = tiles(windows(last)).mapInPandas(_gathered, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives between 30 and 90 hundredths of each of five positives of every hundredth vector."""
    return mine(common.table(spark, sf_dir, "embeddings"))


ORACLE_SQL = r"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(c AS DOUBLE)) FOR c IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), found AS (
  SELECT anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score
  FROM positives p JOIN scored s USING (anchor_id)
  WHERE NOT s.alike AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id)::INTEGER AS rank,
  negative_id, positive_score, negative_score
FROM found
QUALIFY rank <= 10
"""
