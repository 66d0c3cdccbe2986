"""The state of linking, key by key, from a stream of outcomes: retries, redelivery and transient failures change nothing
that should stay.

An outcome is (key, seq, outcome, edges): `ok` with the edges that were found, `miss`, or `transient`.  The state of a key
is a fold of maxima over seq, which is why it doesn't matter how often, in what batches or in what order outcomes come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

OK, MISS, TRANSIENT = "ok", "miss", "transient"


def settled(outcomes: DataFrame, miss: str = "no_targets_found") -> DataFrame:
    """(key, seq, status, edge_seq, edges) of a batch or a stream of outcomes.

    status is that of the outcome with the largest seq: `linked` where edges were found, `miss` where none were, `error`
    after a transient failure.  edges are those of the last outcome that was no transient failure: a failure never deletes
    any, a miss does.  On a stream this is one row of state a key, kept by Spark; give it out in update mode.
    """
    lasting = F.col("outcome") != TRANSIENT
    none = F.array().cast("array<string>")
    edges = F.when(F.col("outcome") == OK, F.coalesce("edges", none)).otherwise(none)
    status = F.when(~lasting, "error").when(F.size(edges) > 0, "linked").otherwise(miss)
    # of outcomes with one seq the same counts in whatever order they come
    last = F.max(F.struct("seq", "outcome", status.alias("status"))).alias("last")
    kept = F.max(F.when(lasting, F.struct("seq", "outcome", edges.alias("edges")))).alias("kept")
    rows = outcomes.where("key IS NOT NULL AND seq IS NOT NULL").groupBy("key").agg(last, kept)
    return rows.select(
        "key", F.col("last.seq").alias("seq"), F.col("last.status").alias("status"), F.col("kept.seq").alias("edge_seq"), F.coalesce("kept.edges", none).alias("edges"))


def write_batch(changed: DataFrame, path: str, batch_id: int) -> None:
    """The changed keys of a batch as its own part of the log: a batch that is run again replaces what it wrote before."""
    changed.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def follow(outcomes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the log at path up with a stream of outcomes until it is stopped or, with what is there, ends; started again
    with the same checkpoint it goes on where it was."""
    return (
        settled(outcomes).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda df, batch_id: write_batch(df, path, batch_id)).start())


def current(spark: SparkSession, path: str) -> DataFrame:
    """The state now: of each key's rows in the log the last, as seq, and for one seq what is known of edges, only grow."""
    columns = ("seq", "status", "edge_seq", "edges")
    last = F.max_by(F.struct(*columns), F.struct("seq", "batch")).alias("l")
    return spark.read.parquet(path).groupBy("key").agg(last).select("key", *(f"l.{c}" for c in columns))


def compact(spark: SparkSession, path: str, to: str) -> None:
    """The log folded into one part of a new log."""
    write_batch(current(spark, path), to, -1)


def unfinished(wanted: DataFrame, state: DataFrame, retry: tuple[str, ...] = (), force: bool = False) -> DataFrame:
    """Keys to ask for in the next run: those without a state, with `retry` those in one of its statuses too, all by force."""
    rows = wanted.select("key").distinct().join(state.select("key", "status"), "key", "left")
    return rows.where(F.lit(force) | F.col("status").isNull() | F.col("status").isin(*retry)).select("key", "status")
