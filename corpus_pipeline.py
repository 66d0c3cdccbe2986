"""The corpus pipeline: quality classifier, toxicity, n-gram Jaccard join, best-fit packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import common, ngram_join, packing, quality_classifier, toxicity

#: no stage can be said in SQL: tests hold the stages against brute force instead
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows that the classifier rejects; it is fitted on labelled rows of the stage's own input.

    Each row is judged by its own text, also where ids repeat or are null; a null text counts as empty, which gets the
    class shares.  All columns stay as they are; an empty table stays empty.
    """
    common.small_batches(spark)
    model = quality_classifier.fit_grades(docs, common.table(spark, sf_dir, "labels"))
    return docs.where(quality_classifier.tail_probability(F.col("text"), model) >= 0.5)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows that are predicted toxic.  Each row is judged by its own text; null and empty texts score 0 and stay."""
    common.small_batches(spark)
    model = toxicity.fit_toxicity(docs, common.table(spark, sf_dir, "labels"))
    return docs.where(toxicity.toxicity_score(F.col("text"), model) < 0.5)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id: once, if its row
    repeats (the one that is first as JSON), and with each of its texts, if they differ.  Rows without an id or without
    words stay; columns of any name and type are carried."""
    found = common.materialize(ngram_join.near_duplicates(docs, ngram_join.Rule(5, 80)), "classes")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    stay = docs.join(common.broadcast_if_small(gone), "doc_id", "left_anti")
    twice = found.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id")
    if twice.isEmpty():
        return stay.select(*docs.columns)
    twice = common.broadcast_if_small(twice)
    every = F.struct(*docs.columns)
    first = F.min_by(every, F.to_json(every)).alias("row")  # as text, so that columns of any type have an order
    again = stay.join(twice, "doc_id", "left_semi").groupBy("doc_id", "text").agg(first).select("row.*")
    return stay.join(twice, "doc_id", "left_anti").select(*docs.columns).union(again.select(*docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left; one row per piece.  Null texts count as empty (the end token alone); repeated rows and null ids
    are packed like any other."""
    packed = packing.pack(docs)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [
    ("quality_classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on what the one before it kept; a stage's input is deleted once its result is
    written.  One row per piece of the documents that stay: an empty table gives none, null texts are packed as empty."""
    docs = common.table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, common.materialize(stage(spark, docs, sf_dir), name)
        if at:
            common.discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
