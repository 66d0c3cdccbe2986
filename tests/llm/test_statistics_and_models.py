import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.llm import common, quality_classifier, quality_rules, toxicity
from loomgraph.llm.trees import fit_forest

SF = "/root/testdata/sf0.01"


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in (i, i + 1, i + 2)}
    lines, before, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in before
            before.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.none(), st.text(), st.text(alphabet="ab #\n\t\x0b\x85 é<", max_size=60)))
def test_statistics_match_brute_force(text):
    assert quality_rules.statistics(text)[0] == brute_base(text)


def test_statistics_of_a_very_long_text():
    text = " ".join(f"w{i % 1000}" for i in range(200_000)) + "\n" + "x" * 100_000
    assert quality_rules.statistics(text)[0] == brute_base(text)


def test_forest_learns_and_is_monotonic():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.1 * rng.standard_normal(3000)) < 0.6).astype(float)
    forest = fit_forest(x, y, np.array([-1, 0, 0]))
    assert ((forest.probability(x) >= 0.5) == (y > 0)).mean() > 0.9
    grid = np.linspace(0, 1, 60)
    for other in rng.random((40, 2)):
        line = np.column_stack([grid, np.repeat(other[None], 60, axis=0)])
        assert (np.diff(forest.margin(line)) <= 1e-12).all()


def test_flat_arrays_equal_a_walk():
    rng = np.random.default_rng(1)
    x = rng.random((400, 4))
    forest = fit_forest(x, (x[:, 0] > x[:, 1]).astype(float), np.zeros(4, int), trees=12)

    def walk(row):
        total = forest.base
        for at in forest.roots:
            while forest.left[at] != at:
                at = forest.left[at] if row[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
            total += forest.value[at]
        return total

    assert np.allclose(forest.margin(x), [walk(r) for r in x])


def test_forest_without_two_classes():
    assert fit_forest(np.zeros((0, 2)), np.zeros(0), np.zeros(2, int)).probability(np.zeros((1, 2))).tolist() == [0.5]
    assert fit_forest(np.zeros((5, 2)), np.ones(5), np.zeros(2, int)).probability(np.zeros((1, 2)))[0] > 0.5


EDGE_ROWS = [(1, None, "x"), (1, None, "x"), (2, "", "y"), (None, "a b", "z"), (3, "word " * 60, "z"), (4, " \t\n", None)]


def edge_documents(spark):
    return spark.createDataFrame(EDGE_ROWS, "doc_id long, text string, kept string").withColumn("score", F.lit(1)).withColumn("n_words", F.lit("c"))


def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def test_edge_rows(spark):
    docs, labels = edge_documents(spark), no_labels(spark)
    rules = quality_rules.apply_rules(docs, quality_rules.fit_rules(docs, labels))
    assert rules.count() == len(EDGE_ROWS)
    assert {r.n_words for r in rules.where("doc_id IN (1, 2, 4)").collect()} == {0}
    assert not rules.where("doc_id = 1").first().kept
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()
    assert len(scored) == len(EDGE_ROWS) and all(0 <= r.score <= 1 for r in scored)
    graded = quality_classifier.classify(docs, quality_classifier.fit_grades(docs, labels)).collect()
    assert len(graded) == len(EDGE_ROWS) and all(0 <= r.expected_grade <= 2 for r in graded)


def test_null_and_repeated_labels_and_empty_tables(spark):
    docs = edge_documents(spark)
    labels = spark.createDataFrame([(3, 1, None), (3, 0, 0), (3, 0, 0), (None, 1, 1), (2, None, 1)], "doc_id long, quality int, toxic int")
    got = common.labelled_texts(docs, labels, ["quality", "toxic"], 10, 10_000).collect()
    assert [(r.doc_id, r.quality, r.toxic) for r in got] == [(3, 0, 0)]
    none = docs.limit(0)
    for out in (
        quality_rules.apply_rules(none, quality_rules.fit_rules(none, labels)),
        toxicity.score_toxicity(none, toxicity.fit_toxicity(none, labels)),
        quality_classifier.classify(none, quality_classifier.fit_grades(none, labels)),
    ):
        assert out.count() == 0


def test_fit_bounds_hold(spark):
    docs = spark.createDataFrame([(i, "x" * 10) for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, quality int")
    assert common.labelled_texts(docs, labels, ["quality"], 20, 10_000).count() == 20
    assert common.labelled_texts(docs, labels, ["quality"], 20, 55).count() == 20  # of each text one character
    assert common.labelled_texts(docs, labels, ["quality"], 50, 40).count() == 40


def test_a_very_long_text_keeps_no_other_out_of_the_fit(spark):
    """The first text in hash order is longer than all that may be fitted on: the others are fitted on all the same."""
    rng = random.Random(4)
    good, bad = [f"good{i}" for i in range(40)], [f"vile{i}" for i in range(5)]
    rows = [(i, " ".join(rng.choices(good, k=60)) + (". " + rng.choice(bad)) * (i % 2)) for i in range(60)]
    first = spark.range(60).orderBy(common.hash_order(F.col("id")), "id").first().id
    rows[first] = (first, rows[first][1] + " " + " ".join(rng.choices(good, k=3_000)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    bound = 15_000
    assert len(rows[first][1]) > bound
    assert common.labelled_texts(docs, labels, ["toxic"], 100, bound).count() >= 50
    assert (toxicity.fit_toxicity(docs, labels, fit_chars=bound).weights > 0).any()
    assert (quality_classifier.fit_grades(docs, labels, fit_chars=bound).weights != 0).any()
    assert len(quality_rules.fit_rules(docs, labels, fit_chars=bound).roots) > 0


def test_noisy_or_finds_the_offending_sentence():
    rng = random.Random(5)
    plain = [f"word{i}" for i in range(50)]
    docs, y = [], []
    for i in range(300):
        sentences = [" ".join(rng.choices(plain, k=8)) for _ in range(rng.randint(1, 12))]
        if i % 4 == 0:
            sentences.insert(rng.randrange(len(sentences) + 1), "some vileish word3 word4")
        docs.append(". ".join(sentences) + ".")
        y.append(i % 4 == 0)
    parts = [[(t, s) for s, sent in enumerate(d.split(". ")) for t in toxicity.TOKEN.findall(sent) if t[0] not in toxicity.ENDS] for d in docs]
    vocabulary = sorted({t for p in parts for t, _ in p})
    number = {t: i for i, t in enumerate(vocabulary)}
    model = toxicity.fit_noisy_or(
        vocabulary, np.array([number[t] for p in parts for t, _ in p]), np.array([i for i, p in enumerate(parts) for _ in p]),
        np.array([s for p in parts for _, s in p]), np.array(y))
    scorer = toxicity.Scorer(model)
    brute = [1 - np.prod(1 - toxicity.sigmoid(scorer(d))) for d in docs]
    assert np.allclose(brute, [-np.expm1(-toxicity.softplus(scorer(d)).sum()) for d in docs])
    assert all((p >= 0.5) == t for p, t in zip(brute, y, strict=True))
    spans = toxicity.offending(docs[0], scorer, 0.5)
    assert len(spans) == 1 and "vileish" in docs[0][spans[0][0] : spans[0][1]]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_toxicity_on_held_out_rows(spark, tables):
    rows = toxicity.op2_toxicity(spark, SF).join(tables[1], "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    hit = sum(r.predicted == r.toxic for r in rows)
    assert hit / len(rows) > 0.9


def test_rules_and_grades_follow_labels(spark, tables):
    rules = quality_rules.op1_quality_rules(spark, SF).join(tables[1], "doc_id").where("NOT base_failed").collect()
    assert sum(r.kept == bool(r.quality) for r in rules) / len(rules) > 0.95
    grades = quality_classifier.op10_quality_classifier(spark, SF).join(tables[1], "doc_id").collect()
    assert sum(r.kept == bool(r.quality) for r in grades) / len(grades) > 0.95


def test_ordinal_thresholds_rise():
    rng = np.random.default_rng(2)
    x = rng.standard_normal(2000)
    grade = np.digitize(x + 0.2 * rng.standard_normal(2000), [-0.5, 0.8])
    model = quality_classifier.fit_ordinal(np.arange(2000), np.full(2000, 3), x, grade, 3, bits=4)
    assert np.all(np.diff(model.theta) > 0)
    tails = model.tails(model.weights[3] * x)
    assert (np.diff(tails, axis=1) <= 0).all()
    assert ((tails >= 0.5).sum(axis=1) == grade).mean() > 0.8


def plain_toxicity(text, model):
    """Noisy-or over sentences, from the weights alone: no caches, no arrays, no token pattern."""
    miss = 1.0
    for sentence in re.split(r"[.!?\n]", (text or "").lower()):
        words = [w for w in re.split(r"[\W_]+", sentence) if w]
        if not words:
            continue
        z = model.bias
        for w in words:
            parts = {f"w{w}", f"s{w[-4:]}"} | {f"p{w[:n]}" for n in (3, 4, 5, 6) if len(w) >= n}
            z += sum(model.weights[zlib.crc32(p.encode()) % 2**toxicity.BITS] for p in parts)
        miss *= 1 - 1 / (1 + np.exp(-z))
    return 1 - miss


def test_registered_toxicity_matches_a_plain_scorer(spark):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    model = toxicity.fit_toxicity(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = toxicity.op2_toxicity(spark, SF).collect()
    assert len(rows) == len(texts) and any(r.predicted for r in rows)
    for r in rows:
        assert abs(r.score - plain_toxicity(texts[r.doc_id], model)) < 1e-6
        assert r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def plain_tail(text, model):
    """P(grade >= 1) from the weights alone."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    size, score = 2**quality_classifier.BITS, 0.0
    for w in words:
        form = w.decode("utf-8", "replace")
        for pattern, to in ((r"[A-ZÀ-ÖØ-Þ]+", "X"), (r"[^\W\d_X]+", "x"), (r"\d+", "9")):
            form = re.sub(pattern, to, form)
        score += (model.weights[zlib.crc32(b"w" + w.lower()) % size] + model.weights[zlib.crc32(b"s" + form[:12].encode()) % size]) / len(words)
    same = sum(zlib.crc32(b"w" + a.lower()) % size == zlib.crc32(b"w" + b.lower()) % size for a, b in zip(words, words[1:], strict=False))
    score += model.weights[zlib.crc32(b"doubled") % size] * same / max(len(words), 1)
    return 1 / (1 + np.exp(-(score - model.theta[0])))


def test_registered_classifier_matches_a_plain_scorer(spark):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    model = quality_classifier.fit_grades(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = quality_classifier.op10_quality_classifier(spark, SF).collect()
    assert len(rows) == len(texts) and {r.kept for r in rows} == {True, False}
    for r in rows:
        assert abs(r.tail_probability - plain_tail(texts[r.doc_id], model)) < 1e-6 and r.kept == (r.tail_probability >= 0.5)
