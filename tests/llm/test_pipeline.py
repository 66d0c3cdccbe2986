"""The pipeline on a small table, each stage against a plain version of its decision."""

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from loomgraph.llm import common, packing, quality_classifier, toxicity
from tests.llm.test_join_and_packing import brute_components
from loomgraph.llm.ngram_join import Rule

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    labels = common.table(spark, SF, "labels")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "toxicity", "ngram_jaccard_join", "best_fit_packing"]
    start = {r.doc_id: r.text for r in docs.collect()}

    first = common.materialize(corpus_pipeline.quality_stage(spark, docs, SF), "t1")
    model = quality_classifier.fit_grades(docs, labels)
    make = quality_classifier.Featurizer()

    def good(text):
        ids, vals = make(text or "")
        return model.tails(np.array([model.weights[ids] @ vals]))[0, 0] >= 0.5

    kept = {r.doc_id: r.text for r in first.collect()}
    assert first.columns == columns and set(kept) == {i for i, t in start.items() if good(t)} and 0 < len(kept) < len(start)

    second = common.materialize(corpus_pipeline.toxicity_stage(spark, first, SF), "t2")
    scorer = toxicity.Scorer(toxicity.fit_toxicity(first, labels))
    clean = {i: t for i, t in kept.items() if 1 - np.prod(1 - toxicity.sigmoid(scorer(t or ""))) < 0.5}
    assert second.columns == columns and {r.doc_id for r in second.collect()} == set(clean)

    third = common.materialize(corpus_pipeline.near_duplicate_stage(spark, second, SF), "t3")
    classes = brute_components(list(clean.items()), Rule(5, 80))
    stay = {i for i, (_, c) in classes.items() if i == c}
    assert third.columns == columns and sorted(r.doc_id for r in third.collect()) == sorted(stay)

    rows = corpus_pipeline.packing_stage(spark, third, SF).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    size = {i: len(tokenizer.encode(clean[i] or "", add_special_tokens=False).ids) + 1 for i in stay}
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == size


def test_repeated_and_null_ids_in_the_duplicate_stage(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (None, "a b c d e f g"), (3, None)]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, kept_id string")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()), key=str)
    assert got == [(1, "a b c d e f g"), (3, None), (None, "a b c d e f g")]


def test_a_repeated_id_keeps_its_different_texts(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "h i j k l m n"), (2, "h i j k l m n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect())
    assert got == [(1, "a b c d e f g"), (1, "h i j k l m n")]


def test_nothing_in_and_nothing_out(spark, tmp_path):
    """Every stage on an empty table; rows with nulls pass the filters unharmed."""
    for name in ("documents", "labels"):
        common.table(spark, SF, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = common.table(spark, str(tmp_path), "documents")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    odd = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (None, "fine words here", None)], "doc_id long, text string, lang string")
    assert corpus_pipeline.toxicity_stage(spark, odd, SF).count() == 3


def test_columns_of_any_name_and_type_pass_the_duplicate_stage(spark):
    rows = [(1, "a b c d e f g", 7, {"k": 1}), (1, "a b c d e f g", 8, {"k": 2}), (1, "h i j k l m n", 9, None), (2, "h i j k l m n", 5, {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _nth int, row map<string,int>")
    got = sorted((r.doc_id, r.text, r._nth) for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect())
    assert got == [(1, "a b c d e f g", 7), (1, "h i j k l m n", 9)]


def test_stages_fit_although_the_first_labelled_text_is_very_long(spark, tmp_path):
    """Longer than all the characters that a stage may fit on together: the stages still learn."""
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    known = toxicity.learnable(labels).join(docs, "doc_id").orderBy(common.hash_order(F.col("doc_id")), "doc_id").first().doc_id
    long = F.when(F.col("doc_id") == known, F.concat("text", F.repeat(F.lit(" plain words of no note"), 1_400_000))).otherwise(F.col("text"))
    docs.withColumn("text", long).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    odd = common.table(spark, str(tmp_path), "documents")
    n = docs.count()
    for stage in (corpus_pipeline.quality_stage, corpus_pipeline.toxicity_stage):
        assert 0 < n - stage(spark, odd, str(tmp_path)).count() < n
