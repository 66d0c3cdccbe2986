"""Operator 10: ordinal cumulative-link regression on graded ratings over hashed text."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import common

BITS = 17
FIT_ROWS, FIT_CHARS = 12_000, 30_000_000
SHAPES = [(re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "X"), (re.compile(r"[^\W\d_X]+"), "x"), (re.compile(r"\d+"), "9")]


def shape(word: str) -> str:
    for pattern, to in SHAPES:
        word = pattern.sub(to, word)
    return word[:12]


class Featurizer:
    """Hashed term shares of a whole text: words, word shapes and doubled words, each block with unit sum.

    Feature 0 of a text without words is nothing at all: its linear score is 0.
    """

    def __init__(self, bits: int = BITS) -> None:
        self.mask = (1 << bits) - 1
        self.known: dict[bytes, tuple[int, int]] = {}

    def ids(self, word: bytes) -> tuple[int, int]:
        form = shape(word.decode("utf-8", "replace"))
        return zlib.crc32(b"w" + word.lower()) & self.mask, zlib.crc32(b"s" + form.encode()) & self.mask

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = common.words_of(text)
        if not words:
            return np.empty(0, np.int64), np.empty(0)
        if len(self.known) > common.CACHE_LIMIT:
            self.known.clear()
        for w in set(words).difference(self.known):
            self.known[w] = self.ids(w)
        at = np.array([self.known[w] for w in words], np.int64)
        n = len(words)
        flat, weight = [at[:, 0], at[:, 1]], [np.full(n, 1 / n), np.full(n, 1 / n)]
        doubled = np.count_nonzero(at[1:, 0] == at[:-1, 0]) / n
        flat.append(np.array([zlib.crc32(b"doubled") & self.mask]))
        weight.append(np.array([doubled]))
        ids, inverse = np.unique(np.concatenate(flat), return_inverse=True)
        return ids, np.bincount(inverse, np.concatenate(weight))


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade >= k) = sigmoid(w.x - theta[k-1]) with theta rising, one shared w."""

    weights: np.ndarray
    theta: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.theta[None, :], -40, 40)))


def fit_ordinal(
    row: np.ndarray, ids: np.ndarray, val: np.ndarray, grade: np.ndarray, grades: int, bits: int = BITS, steps: int = 250, ridge: float = 1e-6
) -> OrdinalModel:
    """Adam on the mean negative log likelihood of the cumulative link; gaps of theta stay positive by exp().

    row, ids and val are the features as (document number, hashed id, value) triples.
    """
    w = np.zeros(1 << bits)
    raw = np.linspace(-1, 1, grades - 1) if grades > 2 else np.zeros(max(grades - 1, 0))
    raw[1:] = np.log(np.maximum(np.diff(raw), 1e-3)) if len(raw) > 1 else raw[1:]
    if not len(grade):
        return OrdinalModel(w, _theta(raw))
    used, col = np.unique(ids, return_inverse=True)
    col = col.astype(np.int32)
    u = np.zeros(len(used))
    m, v = np.zeros(len(used) + len(raw)), np.zeros(len(used) + len(raw))
    n = len(grade)
    for step in range(1, steps + 1):
        s, theta = np.bincount(row, val * u[col], n), _theta(raw)
        bound = np.concatenate([[-np.inf], theta, [np.inf]])
        hi, lo = _sigmoid(bound[grade + 1] - s), _sigmoid(bound[grade] - s)
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        ds = (dhi - dlo) / p / n
        dtheta = np.bincount(grade, -dhi / p / n, grades)[:-1] + np.bincount(grade, dlo / p / n, grades)[1:]
        draw = np.cumsum(dtheta[::-1])[::-1].copy()
        draw[1:] *= np.exp(raw[1:])
        g = np.concatenate([np.bincount(col, val * ds[row], len(used)) + ridge * u, draw])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        u, raw = u - move[: len(used)], raw - move[len(used) :]
    w[used] = u
    return OrdinalModel(w, _theta(raw))


def _theta(raw: np.ndarray) -> np.ndarray:
    return np.concatenate([raw[:1], raw[:1] + np.cumsum(np.exp(raw[1:]))])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def grade_of_labels() -> Column:
    """Grades of the label table: 0 low quality, 1 fair prose that is toxic, 2 good; null where a label is null."""
    known = F.col("quality").isNotNull() & F.col("toxic").isNotNull()
    return F.when(known, F.when(F.col("quality") <= 0, 0).when(F.col("toxic") > 0, 1).otherwise(2))


def fit_grades(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS) -> OrdinalModel:
    """Fit on at most fit_rows labelled rows and fit_chars characters; hashed features of those go to the driver."""
    graded = labels.withColumn("grade", grade_of_labels())
    rows = common.labelled_texts(documents, graded, ["grade"], fit_rows, fit_chars)

    def features(batches):
        make = Featurizer()
        for b in batches:
            found = [make(t) for t in b.text]
            yield pd.DataFrame(
                {"doc_id": b.doc_id, "grade": b.grade.astype("int32"), "ids": [f[0].astype(np.int32) for f in found],
                 "vals": [f[1].astype(np.float32) for f in found]}
            )

    got = rows.select("doc_id", "text", "grade").mapInPandas(
        features, "doc_id long, grade int, ids array<int>, vals array<float>"
    ).toArrow()
    got = got.sort_by("doc_id").combine_chunks()
    if not len(got):
        return fit_ordinal(np.empty(0, int), np.empty(0, int), np.empty(0), np.empty(0, int), 3)
    ids, vals = got["ids"].combine_chunks(), got["vals"].combine_chunks()
    row = np.repeat(np.arange(len(got), dtype=np.int32), ids.value_lengths().to_numpy(zero_copy_only=False))
    parts = row, ids.flatten().to_numpy().copy(), vals.flatten().to_numpy().copy(), got["grade"].to_numpy().astype(np.int64)
    del got, ids, vals
    common.give_back(documents.sparkSession)
    return fit_ordinal(*parts, 3)


def classify(documents: DataFrame, model: OrdinalModel, keep_grade: int = 1, keep_at: float = 0.5) -> DataFrame:
    """One row per row of documents (doc_id, text): expected_grade, tail_probability = P(grade >= keep_grade), kept.

    kept is tail_probability >= keep_at.  A null text counts as empty; an empty text has linear score 0 and so the
    class shares that the thresholds give.  Repeated rows are scored one by one; a null doc_id is carried.
    """
    common.small_batches(documents.sparkSession)

    def score(batches):
        make = Featurizer()

        def one(b):
            s = np.zeros(len(b))
            for i, t in enumerate(b.text):
                ids, vals = make(common.as_text(t))
                s[i] = float(model.weights[ids] @ vals)
            tails = model.tails(s)
            tail = tails[:, keep_grade - 1]
            return pd.DataFrame(
                {"doc_id": b.doc_id, "expected_grade": tails.sum(axis=1), "tail_probability": tail, "kept": tail >= keep_at}
            )

        return common.frames(batches, one)

    return documents.select("doc_id", "text").mapInPandas(
        score, "doc_id long, expected_grade double, tail_probability double, kept boolean"
    )


def tail_probability(text: Column, model: OrdinalModel, keep_grade: int = 1) -> Column:
    """P(grade >= keep_grade) of a text column, row by row, for filters that keep all other columns where they are."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        make = Featurizer()
        for texts in parts:
            s = np.zeros(len(texts))
            for i, t in enumerate(texts):
                ids, vals = make(common.as_text(t))
                s[i] = float(model.weights[ids] @ vals)
            yield pd.Series(model.tails(s)[:, keep_grade - 1])

    return score(text)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expected grade of every document and whether it stays; fitted on the graded rows of the same table."""
    documents = common.table(spark, sf_dir, "documents")
    return classify(documents, fit_grades(documents, common.table(spark, sf_dir, "labels")))
